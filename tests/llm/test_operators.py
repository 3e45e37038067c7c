"""Each operator against a plain version, and on nulls, empty, long, tied and repeated rows and odd columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxmere.llm import embed, langid, lmscore, minhash, mix, packing, quality, shard, toxicity, warc
from fluxmere.llm.components import components
from fluxmere.llm.util import gapless, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the quick brown fox jumps over a lazy dog while many other small animals watch from behind old trees near some river bank".split()
DE = "der schnelle braune fuchs springt über den faulen hund während viele kleine tiere hinter alten bäumen am fluss zuschauen".split()


def make_docs(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), "x", "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def sample(n=120, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang, words = ("en", EN) if i % 3 else ("de", DE)
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(5, 60))), lang, f"src{r.randint(0, 3) if i % 2 else 0}"))
    edge = [(n, None, None, None), (n + 1, "", "en", None), (n + 2, " \n\t ", "de", "src1"), (None, "text without an id stays here now", "en", "src0"), (n + 3, "word " * 4000, "en", "src2"), (5, rows[5][1], "en", "src0"), (5, rows[5][1], "en", "src0"), (n + 4, rows[7][1], None, "src9"), (n + 5, "1234 !!", "en", "src9")]
    return rows + edge


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality_matches_plain_version(spark):
    rows = sample() + [(500, "same line\nsame line\nother #$ line\n\n", "en", "s"), (501, "a b c a b c x a b c", "en", "s")]
    docs = make_docs(spark, rows)
    got = rows_of(quality.quality(docs))
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if wins[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        m = r["quality"]["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(covered))
        assert m["lines"]["dup"] == len(lines) - len(set(lines))
    assert quality.quality(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>same</p>"), (2, None, "<p>same</p>"), (2, "u", "<p>same</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>same</p>"), (7, "u\nv", "ü" * 300_000), (1, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha", "1 AS size")
    folder = new_path(spark, "warc")
    index = warc.write_archives(pages, folder, frame_bytes=500)
    got = rows_of(warc.read_archives(index, folder))
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    same = by[base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()]
    assert [r["record_type"] for r in same].count("response") == 1 and {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {1}
    empty = by[base64.b32encode(hashlib.sha1(b"").digest()).decode()]
    assert {(r["page_id"], r["record_type"], r["payload_bytes"]) for r in empty} == {(3, "response", 0), (4, "revisit", 0)}
    some = next(r for r in rows_of(index) if r["page_id"] == 7)
    from fluxmere.llm.util import local_path

    reader = warc.BundleReader(f"{local_path(folder)}/{some['bundle']}")
    assert warc.parse(reader.get(some["record_id"]))[2] == ("ü" * 300_000).encode()
    assert warc.write_archives(pages.limit(0), new_path(spark, "warc")).count() == 0


@pytest.mark.parametrize("text", ["a b", "  two  spaces\n", "it's 12,5% <|endoftext|> «x»", "", "\n\n a", "für Straße 漢字 🙂", "x" * 3000, "tab\tend ", " " * 40_000 + "a", "a \r\n\t  \n b  \n", "don't DON'T we'll 'sup''ve", "^" * 5000, "\u2028 \u00a0\u3000x", "e\u0301a ½ ٣٤ x²"])
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    enc = packing.Encoder(packing.vocabulary())
    for t in (text, text + "<|endoftext|>", f" a <|endoftext|><|endoftext|>  {text} b"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    enc = packing.Encoder(packing.vocabulary(), special=False)
    assert np.frombuffer(enc.encode(text + "<|endoftext|> x"), "<u4").tolist() == plain.encode(text + "<|endoftext|> x", add_special_tokens=False).ids


def test_packing(spark):
    docs = make_docs(spark, sample())
    got = rows_of(packing.pack_documents(docs))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, t, *_ in sample():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for row in packing.piece_rows(ids, 1024):
            want[(i, *row)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 80)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        out = packing.fullest(counts, room)
        assert sum(k * n for k, n in out.items()) == best and all(n <= counts[k] for k, n in out.items())


def test_language_id(spark):
    docs = make_docs(spark, sample(300))
    model = langid.fit(docs)
    got = rows_of(langid.identify(docs, model, extra=("lang", "text")))
    assert len(got) == len(sample(300))
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        assert 0 <= r["score"] <= 1
    known = [r for r in got if r["lang_pred"] != "und" and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in known) >= 0.97 * len(known)
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in rows_of(langid.identify(docs.limit(3), None))} == {"und"}


def test_language_models_learn_from_all_rows(spark):
    r = random.Random(4)
    rows = [(i, f"{r.choice(EN)} {r.choice(EN)} q{i:x}".replace("0", "k").translate(str.maketrans("123456789", "lmnoprstu")), "en", "s") for i in range(6000)]
    rows += [(6000 + i, " ".join(r.choice(DE) for _ in range(6)), "de", "s") for i in range(40)]
    rows.append((7000, "jazzy " * 12_000, "en", "s"))
    docs = make_docs(spark, rows)
    models, limits = langid.fit(docs)
    apart = {x["doc_id"] for x in docs.selectExpr("doc_id", "pmod(xxhash64(text, 11), 5) = 0 AS apart").filter("apart").collect()}
    words, kept = {"en": Counter(), "de": Counter()}, []
    for i, t, lang, _ in rows:
        if i not in apart:
            words[lang].update(langid.letters(t))
        elif t not in {x for x, _ in kept}:
            kept.append((t, lang))
    want = langid.CharModels.fit(words)
    assert all((a == b).all() for a, b in zip(models.keys, want.keys)) and all(np.allclose(a, b) for a, b in zip(models.logp, want.logp))
    assert len(models.keys[4]) > 2000 and limits.shape == (3, 2) and np.isfinite(limits).all()
    seen = {}
    for lang, k, x in langid.rates(want, [langid.letters(t) for t, _ in kept], [lang for _, lang in kept]):
        seen.setdefault((lang, k), []).append(x)
    assert limits[0, 1] == pytest.approx(max(np.quantile(seen["en", k], 0.999) + 1 for k in range(3) if ("en", k) in seen), abs=1e-3)


def plain_kneser_ney(words, order, alphabet):
    """p(c | history) from the formula: raw counts at the top, distinct predecessors below, one discount a level."""
    grams = [Counter() for _ in range(order)]
    for w, n in words.items():
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            for k in range(min(order, i + 1)):
                grams[k][s[i - k : i + 1]] += n
    counts = [Counter(g) for g in grams]
    for k in range(order - 1):
        longer = {x for x in grams[k + 1]}
        for g in grams[k]:
            before = sum(x[1:] == g for x in longer)
            counts[k][g] = before or grams[k][g]

    def p(c, history, k):
        if k < 0:
            return 1 / alphabet
        h = history[len(history) - k :] if k else ""
        level = counts[k]
        seen = [v for g, v in level.items() if g[:-1] == h]
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(0.9, max(0.1, ones / max(ones + 2 * twos, 1)))
        if not seen:
            return p(c, history, k - 1)
        return max(level[h + c] - d, 0) / sum(seen) + d * len(seen) / sum(seen) * p(c, history, k - 1)

    return p


def test_kneser_ney_matches_plain_version_and_sums_to_one():
    words = {"x": Counter({"abab": 3, "abba": 2, "aab": 1, "b": 4}), "y": Counter({"cac": 1, "ab": 2})}
    m = langid.CharModels.fit(words, 3)
    for j, lang in enumerate(m.langs):
        p = plain_kneser_ney(words[lang], 3, langid.ALPHABET)
        for word in ("a", "ab", "abab", "aab", "bb", "caca"):
            s = f"\x02{word}\x03"
            want = sum(math.log(p(s[i], s[:i], min(2, i))) for i in range(1, len(s)))
            assert m.score([word])[0][0][j] == pytest.approx(want, abs=2e-3), (lang, word)
        for history in ("\x02", "\x02a", "\x02ab", "\x02cc"):
            of = lambda c: p(c, history, min(2, len(history)))  # noqa: E731,B023
            letters = {*"".join(words[lang]), "\x03"}
            assert sum(map(of, letters)) + (langid.ALPHABET - len(letters)) * of("z") == pytest.approx(1)


def test_foreign_texts_are_rejected(spark):
    docs = make_docs(spark, sample(300))
    model = langid.fit(docs)
    tests = make_docs(spark, [(1, "漢字 漢字 仮名 交じり", None, None), (2, "привет мир", None, None), (3, "the quick brown fox", None, None), (4, "fox", None, None), (5, "zwölf boxkämpfer jagen den fuchs", None, None), (6, "日本", None, None)])
    bad = {r["doc_id"]: r["rejected"] for r in rows_of(langid.identify(tests, model))}
    assert bad[1] and bad[2] and bad[6] and not bad[3] and not bad[4]


def test_toxicity_restores_and_scores(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        words = [r.choice(EN) for _ in range(30)]
        if i % 4 == 0:
            words[r.randint(0, 29)] = r.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data, data)
    for s, w in (("1d10t", "idiot"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("$tup!d", "stupid")):
        assert toxicity.restore(s, model.lm, {}) == w
    tests = spark.createDataFrame([(1, "you 1d10t over there"), (2, " ".join(EN)), (3, None), (4, ""), (5, "x" * 100_000), (2, " ".join(EN))], "doc_id long, text string")
    got = [(r["doc_id"], r["predicted"]) for r in rows_of(toxicity.toxicity(tests, model, extra=("doc_id",)))]
    assert sorted(got) == [(1, 1), (2, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert toxicity.fit(data.limit(0), data) is None and toxicity.fit(data.filter("toxic = 0"), data) is None
    assert toxicity.toxicity(tests.limit(0), None).count() == 0


def test_spread_insults_keep_their_borders(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        words = [r.choice([*EN, "i", "you"]) for _ in range(30)]
        if i % 4 == 0:
            words[r.randint(0, 29)] = r.choice(["idiot", "stupid", "trash"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data, data)
    for text, want in (
        ("you are a s t u p i d man", "you are a stupid man"),
        ("I t r a s h it", "i trash it"),
        ("s t u p i d, go", "stupid, go"),
        ("go s t u p i d. Go", "go stupid. go"),
        ('"s t u p i d"', '"stupid"'),
        ("(s t u p i d)", "(stupid)"),
        ("((((s t u p i d", "((((stupid"),
        ("s.t.u.p.i.d.", "stupid."),
        ("so _i-d-i-o-t_", "so _idiot_"),
        ("a $ t u p ! d fox", "a stupid fox"),
        ("y o u s t u p i d", "you stupid"),
        ("y o u  i d i o t!", "you idiot!"),
    ):
        assert toxicity.restore(text, model.lm, {}) == want
    scorer = toxicity.Scorer(model)
    assert scorer.score("you are a s t u p i d fox") >= toxicity.THRESHOLD > scorer.score("you are a fox")


def test_toxicity_learns_from_all_labelled_rows(spark):
    r = random.Random(12)
    rows = [(f"{'idiot' if i % 10 == 0 else 'stupid' if i % 10 == 1 and i % 30 else r.choice(EN)} {' '.join(r.choice(EN) for _ in range(4))} {i:x}z", int(i % 10 < 2)) for i in range(20_000)]
    rows += [(t + " idiot", 0) for t, _ in rows[2:40:10]] + rows[:500]
    rows.append(("fox " * 20_000 + "idiot", 1))
    data = spark.createDataFrame(rows, "text string, toxic int")
    model, distinct = toxicity.fit(data, data), {}
    for t, y in rows:
        distinct[t] = max(y, distinct.get(t, 0))
    sizes = Counter(distinct.values())
    for word in ("idiot", "stupid"):
        f, = [f for f in model.ratios if word.startswith(f.rstrip("$"))]
        held = Counter(y for t, y in distinct.items() if any(w.startswith(f) or w + "$" == f for w in t.split()))
        assert model.ratios[f] == pytest.approx(math.log((held[1] / sizes[1]) / ((held[0] + 0.5) / sizes[0])))
    often = round(len(rows) / sizes[1])
    words = Counter(w for t, y in rows for w in re.findall(r"[^\W\d_]+", t))
    for t, y in distinct.items():
        if y:
            for w in re.findall(r"[^\W\d_]+", t):
                words[w] += often
    assert model.lm.grams == toxicity.CharModel(words).grams
    scorer = toxicity.Scorer(model)
    assert scorer.score("fox 1d10t") >= toxicity.THRESHOLD > scorer.score("fox dog")


def test_toxic_texts_of_any_length_count(spark):
    rows = [(f"{'fox ' * 15_000} stupid {i:x}", 1) for i in range(6)] + [(f"fox dog {i:x}", 0) for i in range(30)]
    data = spark.createDataFrame(rows, "text string, toxic int")
    assert "stupid$" in toxicity.fit(data, data).ratios


def all_paths(span, lm):
    """(cost, restored) of every path through a span's lattice, spelled out without Viterbi."""
    text = span.lower()
    runs = [len(x.group()) for x in re.finditer(r"(.)\1*", text) for _ in x.group()]
    drops, meants = {2: 5.0}, {2: 0.05}

    def go(i, history, last, out, cost):
        if i == len(text):
            yield cost + lm.cost(history, "\x03"), out
            return
        c, again = text[i], i > 0 and text[i - 1] == text[i]
        meant = meants.get(runs[i], 1.5) if again else 0.05
        if c == last and out:
            yield from go(i + 1, history, last, out, cost + drops.get(runs[i], 0.3))
        if c.isalpha():
            yield from go(i + 1, history[1] + c, c, out + c, cost + meant + lm.cost(history, c))
            return
        for r in toxicity.LEET.get(c, ""):
            yield from go(i + 1, history[1] + r, c, out + r, cost + 1.2 + meant + lm.cost(history, r))
        yield from go(i + 1, "\x02\x02", c, out + c, cost + 4.0 + lm.cost(history, "\x03"))

    return go(0, "\x02\x02", "", "", 0.0)


def test_decoding_finds_the_cheapest_path():
    lm = toxicity.CharModel(Counter({"idiot": 3, "stupid": 2, "moron": 2, "asset": 4, "all": 5, "ill": 2, "aloud": 1}))
    r = random.Random(6)
    for _ in range(150):
        word = r.choice(["idiot", "stupid", "moron", "asset", "all", "ill"])
        span = "".join(r.choice([c, c, c * r.randint(2, 3), *[k for k, v in toxicity.LEET.items() if c in v and k not in "(*!"]]) for c in word)
        best = min(c for c, _ in all_paths(span, lm))
        assert toxicity.decode(span, lm) in {o for c, o in all_paths(span, lm) if c < best + 1e-9}, span
    assert toxicity.decode("a" + "*" * 3000 + "b", lm)  # long spans stay linear


@pytest.mark.parametrize("seed", range(3))
def test_words_by_token_are_those_of_the_whole_text(seed):
    lm = toxicity.CharModel(Counter({"idiot": 3, "stupid": 2, "the": 9}))
    r = random.Random(seed)
    bits = ["the", "a", "I", "1d10t", "s.t.u.p.i.d", "s t u p i d", "st up", "x-y", "* a *", "- b -", "$tup!d,", "ooooo", "«q»", "_i-d_", "12 3 4 5", "é ü", ". . .", "(a b c)", "\n", "  "]
    for _ in range(300):
        text = r.choice([" ", "", "\t"]).join(r.choice(bits) for _ in range(r.randint(1, 8)))
        assert toxicity.Restorer(lm).words(text) == set(WORD_LETTERS.findall(toxicity.restore(text, lm, {}))), text


WORD_LETTERS = re.compile(r"[^\W\d_]+")


def jaccard(a, b):
    def bag(t):
        w = WORD.findall(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    keys = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    on_a, on_b = np.flatnonzero(a), np.flatnonzero(b)
    sig = minhash.bag_minhash(np.concatenate([keys[on_a], keys[on_b]]), np.repeat([0, 1], [len(on_a), len(on_b)]), np.concatenate([a[on_a], b[on_b]]).astype(float), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_match_all_pairs(spark, block):
    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = sample(60)
    for i in range(80):  # some near the base, some only near each other
        w = list(base)
        for k in range(r.randint(0, 4) if i < 40 else 5):
            w[r.randrange(150) if i < 40 else 20 * k + i % 7] = f"n{r.randint(0, 10**6) if i < 40 else i % 7}"
        w[149] = f"e{i % 50}"
        rows.append((1000 + i, " ".join(w), "en", "src0"))
    got = rows_of(minhash.near_duplicates(make_docs(spark, rows), block=block))
    assert len(got) == len(rows)
    texts = [(i, t) for i, t, *_ in rows if i is not None and WORD.search(t or "")]
    low = {i: i for i, _ in texts}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(texts, 2) if a != b and jaccard(s, t) >= 0.8]
    for _ in range(len(low)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert all(r["component_id"] == low.get(r["doc_id"], r["doc_id"]) for r in got)
    assert minhash.near_duplicates(make_docs(spark, rows).limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), (3, 1), *[(100 + i, 101 + i) for i in range(20)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(21)}}


def test_mix_plans_all_patterns(spark):
    r = random.Random(9)
    names = [f"s{i:02d}" for i in range(16)]
    subsets = [c for k in range(2, 7) for c in itertools.combinations(names, k)]
    shared = [(c, f"{i:x} " + "w " * r.randint(1, 30)) for i, c in enumerate(r.sample(subsets, 10_400))]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate((t, s) for c, t in shared for s in c)]
    words = {t: len(t.split()) for _, t in shared}
    share = sum(words.values()) / sum(words[t] for _, t, _, _ in rows)
    got = rows_of(mix.mix_documents(make_docs(spark, rows), share=share, weights=(1,)))
    text, times, taken = {i: t for i, t, _, _ in rows}, Counter(), Counter()
    for x in got:
        times[text[x["doc_id"]]] += x["taken"] // x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[x["source"]] - x["target"]) <= max(1, x["target"] / mix.NEAR) for x in got)
    light = sorted(words, key=words.get)[:400]
    # every text is shared and there are as many words wanted as there are, so hardly one is taken twice
    assert sum(times[t] > 1 for t in light) <= 8


def test_mix_reaches_targets(spark):
    rows = sample(400)
    rows += [(900 + i, rows[i % 40][1], "en", f"src{i % 5}") for i in range(300)]  # texts that several sources share
    docs = make_docs(spark, rows)
    got = rows_of(mix.mix_documents(docs))
    assert len(got) == len(rows) and got and all(r["taken"] <= 2 * r["size"] for r in got)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["source_size"] >= r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    words = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert all(r["size"] == words[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] != 5)
    for s, t in target.items():
        mine = [r for r in got if r["source"] == s]
        fits = [r["size"] for r in mine if r["taken"] < 2 * r["size"]]
        # within 1/2000, or no row that is left fits
        assert t <= 2 * size[s] + 1e-9 and taken[s] <= t + 1e-6
        assert t - taken[s] <= max(2, t / 1000) or min(fits, default=10**9) > t - taken[s] - 1, (s, t, taken[s], sorted(fits)[:3])
    again = rows_of(mix.mix_documents(docs))
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    assert mix.mix_documents(docs.limit(0)).count() == 0


def test_shared_texts_are_taken_once_first(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(EN) for _ in range(10)) for _ in range(120)]
    rows = [(i, texts[i], "en", "a") for i in range(100)] + [(200 + i, texts[20 + i], "en", "b") for i in range(100)]
    plan = mix.plan_mix(make_docs(spark, rows), share=0.5, weights=(1, 1))
    assert len({(p, c) for p, c, *_ in plan.cells}) == 3 and len(plan.cells) == 4  # a, a and b, b
    docs = make_docs(spark, rows).select("doc_id", "source", "text", *[c.alias(n) for n, c in mix.counted("text").items()])
    takes = Counter()
    for x in plan.takes(docs, "doc_id", "source", "size", "h").collect():
        takes[x["text"]] += x["takes"]
    # 100 texts' worth of words are wanted and 120 texts there are
    assert sum(takes.values()) == 100 and sum(n - 1 for n in takes.values() if n > 1) <= 4


def test_stage_keeps_columns_that_clash(spark):
    rows = sample(60)
    docs = make_docs(spark, rows).selectExpr("*", "1 AS row", "2 AS target", "3 AS takes", "4 AS _cell", "5 AS h", "6 AS _sha", "7 AS source_size", "8 AS _row", "9 AS held_out", "10 AS score")
    for stage in (mix.stage, minhash.stage, langid.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.filter("row != 1 OR target != 2 OR takes != 3 OR _cell != 4 OR h != 5 OR _sha != 6 OR source_size != 7 OR _row != 8").isEmpty()
        assert stage(spark, docs.limit(0), "").count() == 0


def cheapest(supply, members, quota, caps, base, passes):
    """Most words, then least cost, by trying every whole flow."""
    pairs = [(p, s) for p in members for s in members[p]]
    best = (0, 0)

    def go(k, flow):
        nonlocal best
        if k == len(pairs):
            total = sum(flow.values())
            cost = 0
            for p in members:
                n = sum(v for (q, _), v in flow.items() if q == p)
                if n > passes * supply[p]:
                    return
                cost += sum(base.get(p, 0) + 1 + i // supply[p] for i in range(n))
            best = max(best, (total, -cost))
            return
        p, s = pairs[k]
        used = sum(v for (_, x), v in flow.items() if x == s)
        for v in range(min(caps[(p, s)], quota[s] - used) + 1):
            go(k + 1, {**flow, (p, s): v})

    go(0, {})
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    r = random.Random(seed)
    members = {0: ["a"], 1: ["a", "b"], 2: ["b"]} if seed % 2 else {0: ["a", "b"], 1: ["b", "c"]}
    supply = {p: r.randint(1, 3) for p in members}
    quota = {s: r.randint(0, 6) for s in "abc"}
    caps = {(p, s): r.randint(1, 5) for p in members for s in members[p]}
    base = {p: r.randint(0, 1) for p in members}
    flow = mix.min_cost_flow(supply, members, quota, 3, caps, base)
    used = {p: round(sum(v for (q, _), v in flow.items() if q == p)) for p in members}
    cost = sum(base[p] + 1 + i // supply[p] for p in members for i in range(used[p]))
    assert all(v <= caps[k] + 1e-9 for k, v in flow.items())
    assert (sum(used.values()), -cost) == cheapest(supply, members, quota, caps, base, 3)


def test_flow_uses_overlapping_sources():
    flow = mix.min_cost_flow({0: 10.0, 1: 10.0, 2: 10.0}, {0: ["a"], 1: ["a", "b"], 2: ["b"]}, {"a": 20.0, "b": 10.0}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "a") == pytest.approx(20) and sum(v for (_, s), v in flow.items() if s == "b") == pytest.approx(10)
    assert all(sum(v for (q, _), v in flow.items() if q == p) == pytest.approx(10) for p in range(3))  # nothing is repeated


def test_flow_reaches_a_null_source():
    flow = mix.min_cost_flow({0: 4.0, 1: 4.0}, {0: ["a", None], 1: ["a"]}, {"a": 6.0, None: 6.0}, 4, {(0, "a"): 8.0, (0, None): 8.0, (1, "a"): 8.0})
    assert sum(v for (_, s), v in flow.items() if s is None) == pytest.approx(6) and sum(flow.values()) == pytest.approx(12)


def test_embeddings_match_all_pairs(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 48))
    rows = []
    for i in range(400):
        c = centres[i % 30] if i % 2 else r.normal(size=48)
        rows.append((i, [float(x) for x in c + r.normal(size=48) * r.choice([0.1, 0.2, 0.3])]))
    rows += [(500, None), (501, [0.0] * 48), (502, [float("nan")] * 48), (503, [1.0, None]), (504, []), (505, [2 * x for x in rows[1][1]]), (None, rows[1][1]), (1, rows[1][1]), (506, [3.0] * 48)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS label")
    got = rows_of(embed.near_vectors(df, block=16))
    assert len(got) == len(rows)
    live = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 48 and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in live])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = sum(near.sum(axis=1))
    assert want > 400
    links = sum(r["n_links"] for r in got)
    assert 0.9 * want <= links <= want
    dead = {500, 501, 502, 503, 504, None}
    assert all(r["n_links"] == 0 for r in got if r["vec_id"] in dead)
    assert embed.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [5, 64, 300])
def test_recall_holds_with_longer_tuples(d):
    r = np.random.default_rng(9)
    a = embed.unit_rows(r.normal(size=(400 if d < 100 else 150, d)))
    b = r.normal(size=a.shape)
    b = 0.9 * a + np.sqrt(0.19) * embed.unit_rows(b - (b * a).sum(axis=1, keepdims=True) * a)
    for hashes in (1, 2, 3, 4) if d < 100 else (2, 3):
        tables = embed.tables_for(embed.width_of(d), hashes, 1, 0.9)
        meets = embed.codes(a, tables, hashes, 1)[:, :, :, None] == embed.codes(b, tables, hashes, 1)[:, :, None, :]
        assert meets.any(axis=(1, 2, 3)).mean() >= 0.99


@pytest.mark.parametrize("hashes", [3, 4])
def test_embeddings_match_all_pairs_with_longer_tuples(spark, hashes):
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(100, 64)), 3, axis=0)
    x = embed.unit_rows(x + r.normal(size=x.shape) * 0.32)
    near = x @ x.T >= 0.9
    want = near.sum() - len(x)
    assert want > 150
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = sum(r["n_links"] for r in rows_of(embed.near_vectors(df, hashes=hashes)))
    assert 0.99 * want <= links <= want


def test_shards_are_even(spark):
    docs = make_docs(spark, sample(600)).selectExpr("doc_id", "text", "coalesce(octet_length(text), 0) + 16 AS bytes")
    from pyspark.sql import functions as F

    out = shard.kd_shards(docs, shard.dimensions(F.col("text")), "bytes", F.col("text"), F.col("doc_id"), 8)
    got = rows_of(gapless(out, "shard", F.struct("doc_id", "text"), ["doc_id", "text"], "slot"))
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r["shard"]] += r["bytes"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(sample(600)) and set(weight) == set(range(8))
    big = {r["shard"] for r in got if r["bytes"] > 10_000}
    assert all(w <= 1.3 * sum(weight.values()) / 8 for s, w in weight.items() if s not in big)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(weight.values())
    by_target = rows_of(shard.kd_shards(docs, shard.dimensions(F.col("text")), "bytes", F.col("text"), F.col("doc_id"), target=total / 5))
    assert {r["shard"] for r in by_target} == set(range(5))
    assert shard.kd_shards(docs.limit(0), shard.dimensions(F.col("text")), "bytes", F.col("text"), F.col("doc_id"), 8).count() == 0


def test_elias_fano(tmp_path):
    r = np.random.default_rng(1)
    for n, u in ((1, 1), (5, 7), (1000, 1 << 40), (3000, 4000), (200, 1 << 20), (900, 1 << 62)):
        v = np.sort(r.choice(u, n, replace=False) if u < 1 << 24 else np.unique(r.integers(0, u, 2 * n))[:n])
        path = str(tmp_path / f"e{n}")
        lmscore.EliasFano.build(v, u, path)
        e = lmscore.EliasFano.load(path)
        assert (e.find(v.astype(np.int64)) == np.arange(n)).all() and (e.at(np.arange(n)) == v).all()
        other = np.setdiff1d(r.integers(0, u + 5, 500), v)
        assert (e.find(other) == -1).all()
    v = np.concatenate([np.arange(500), np.full(300, 10**6), 10**6 + np.arange(1, 400), [10**9]])  # runs and equal numbers
    lmscore.EliasFano.build(v, 10**9 + 1, str(tmp_path / "runs"))
    e = lmscore.EliasFano.load(str(tmp_path / "runs"))
    assert (e.at(np.arange(len(v))) == v).all() and set(e.find(np.arange(500))) == set(range(500)) and e.find(np.array([10**9]))[0] == len(v) - 1


def lower_words(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), "</s>"]


def plain_model(texts, order, cutoff):
    """(p(word | words before), counts) by the formula: absolute discounting down to shares of words."""
    grams = [Counter() for _ in range(order)]
    for t in texts:
        w = lower_words(t)
        grams[0].update(w)
        w = ["</s>", *w]
        for k in range(1, order):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n = sum(grams[0].values())
    unknown = max(sum(x == 1 for x in grams[0].values()), 1) / n
    kept = [{g: c for g, c in x.items() if k == 0 or c >= cutoff} for k, x in enumerate(grams)]
    mass = Counter()
    for k in range(1, order):
        for g, c in kept[k].items():
            mass[g[:-1]] += (c - 0.75) / (grams[0][g[0]] if k == 1 else kept[k - 1].get(g[:-1], math.inf))

    def p(w, before):
        out = (1 - unknown) * grams[0][w] / n if grams[0][w] else unknown
        for k in range(1, min(order, len(before) + 1)):
            h = tuple(before[-k:])
            total = grams[0][h[0]] if k == 1 else kept[k - 1].get(h)
            if not total:
                break
            if mass[h]:
                c = kept[k].get((*h, w), 0)
                out = max(c - 0.75, 0) / total + (1 - mass[h]) * out
        return out

    return p, grams, unknown


@pytest.mark.parametrize(("order", "cutoff"), [(1, 1), (2, 2), (3, 1), (3, 2), (4, 1)])
def test_language_model_matches_plain_version(spark, order, cutoff):
    rows = [*sample(200), (900, "The unseen quick zebra brown fox jumps", "en", "s"), (909, "brown fox jumps over zebra zebra " * 300, "en", "s")]
    docs = make_docs(spark, rows).select("doc_id", "text", "size").repartition(6)
    train = docs.filter("doc_id % 7 != 2")
    model = lmscore.train(train, order, cutoff)
    got = rows_of(lmscore.score(docs, model, ("doc_id", "text")))
    assert len(got) == docs.count()
    p, grams, _ = plain_model([r["text"] for r in train.collect()], order, cutoff)
    n, v = sum(grams[0].values()), len(grams[0])
    assert [sum(m["full"]) for m in model["levels"]] == [sum(c >= cutoff for c in g.values()) for g in grams[1:]]
    for r in got:
        t = lower_words(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(x in grams[0] for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((grams[0][x] + 1) / (n + v + 1)) for x in t))
        full = ["</s>", *t]
        s = sum(math.log10(p(full[i], full[max(0, i - order + 1) : i])) for i in range(1, len(full)))
        assert r["score"] == pytest.approx(s, rel=0.02, abs=0.05 + 0.002 * len(t))  # a byte a probability
    none = lmscore.train(docs.limit(0))
    assert lmscore.score(docs, none, ("doc_id",)).agg({"score": "sum"}).first()[0] == 0
    assert lmscore.score(docs.limit(0), model, ("doc_id",)).count() == 0


@pytest.mark.parametrize("cutoff", [1, 2])
def test_language_model_sums_to_one(spark, cutoff):
    """Over all words and an unknown one, behind known, rare, unknown and no words."""
    rows = [(i, t, "en", "s") for i, (_, t, *_) in enumerate(sample(80)) if t and len(t) < 400]
    docs = make_docs(spark, rows).select("doc_id", "text")
    model = lmscore.train(docs, 3, cutoff)
    words = {w for _, t, *_ in rows for w in lower_words(t)} - {"</s>"}
    histories = ["", "the", "the quick", "fox jumps", "neverseen", "the neverseen", "neverseen the", rows[3][1]]
    tests = [(k, f"{h} {w}".strip()) for k, h in enumerate(histories) for w in [*words, "qqqq"]] + [(-1 - k, h) for k, h in enumerate(histories)]
    got = defaultdict(list)
    for r in rows_of(lmscore.score(spark.createDataFrame(tests, "doc_id long, text string"), model, ("doc_id", "text"))):
        got[r["doc_id"]].append((r["text"], r["score"]))
    p, _, _ = plain_model([t for _, t, *_ in rows], 3, cutoff)
    for k, h in enumerate(histories):
        base = got[-1 - k][0][1] - math.log10(p("</s>", ["</s>", *lower_words(h)[:-1]][-2:]))
        total = p("</s>", ["</s>", *lower_words(h)[:-1]][-2:])
        for text, score in got[k]:
            after = math.log10(p("</s>", ["</s>", *lower_words(text)[:-1]][-2:]))
            total += 10 ** (score - after - base)
        assert total == pytest.approx(1, rel=0.06), h


def test_crc_of_pieces():
    ids = np.arange(2050, dtype="<u4").tobytes()
    rows = packing.piece_rows(ids, 1024)
    assert [r[2] for r in rows] == [2, 1024, 1024] and rows[0][3] == zlib.crc32(ids[:8])


@pytest.mark.parametrize("run", [1, 8, 9, 64, 65, 300])
def test_elias_fano_finds_in_runs_of_one_high_part(tmp_path, run):
    v = np.unique(np.concatenate([np.arange(5000, 5000 + 2 * run, 2), np.arange(10) * 100_000 + 7])).astype(np.uint64)
    lmscore.EliasFano.build(v, 1 << 20, str(tmp_path / "e"))
    e = lmscore.EliasFano.load(str(tmp_path / "e"))
    ask = np.unique(np.concatenate([np.arange(4990, 5010 + 2 * run), np.arange(10) * 100_000 + 7, [(1 << 20) - 1]]))
    place = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(ask).tolist() == [place.get(x, -1) for x in ask.tolist()]

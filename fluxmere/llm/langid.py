"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fold, held, small_batches

ORDER = 5
#: Distinct tokens that a task counts before it turns them to grams; texts whose words it scores together.
TOKENS, SLICE = 100_000, 1000
#: Letters that the lowest order spreads its discount over; a foreign letter costs that much.
ALPHABET = 50_000
LETTERS = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes by order, valid by place, word of place). A word is framed: 2 word 3; place 0 of each is the frame."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    start = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - start[word]
    out = []
    with np.errstate(over="ignore"):
        h = mix64(codes + np.uint64(0x1234567))
        out.append(h)
        for k in range(1, order):
            back = np.zeros_like(codes)
            back[k:] = codes[:-k]
            h = mix64(h * _MULT + back + np.uint64(k))
            out.append(h)
    return out, place, word


def longest(words: Counter, order: int) -> tuple[list[str], list[int]]:
    """(grams, counts): of each place of framed words, the gram of ``order`` characters or, near the start, all so far."""
    names = list(words)
    hashes, place, word = grams(names, order)
    size = np.minimum(place + 1, order)
    key = np.stack(hashes)[size - 1, np.arange(len(place))] if len(place) else np.zeros(0, np.uint64)
    on = np.flatnonzero(place > 0)
    _, first, inv = np.unique(key[on], return_index=True, return_inverse=True)
    n = np.zeros(len(first), np.int64)
    np.add.at(n, inv, np.fromiter((words[w] for w in names), np.int64, len(names))[word[on]])
    text, ends = "".join(f"\x02{w}\x03" for w in names), on[first] + 1
    return [text[b - m : b] for b, m in zip(ends.tolist(), size[on[first]].tolist(), strict=True)], n.tolist()


def spell(texts: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(hashes by order of the ends of grams, of what stands before their last character, their sizes)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends, out = np.cumsum(sizes), []
    for last in (1, 2):
        rows = []
        with np.errstate(over="ignore"):
            for k in range(order):
                c = np.where(sizes >= last + k, flat[np.maximum(ends - last - k, 0)] if len(flat) else 0, 0).astype(np.uint64)
                rows.append(mix64(rows[-1] * _MULT + c + np.uint64(k)) if k else mix64(c + np.uint64(0x1234567)))
        out.append(rows)
    return out[0], out[1], sizes


class CharModels:
    """All languages' models in one sorted hash array a order; row r has a log probability a language.

    Probabilities are interpolated Kneser-Ney, stored for n-grams seen in any language; where a
    language has not seen an n-gram the row holds that language's backed-off value, so a lookup of
    the longest known n-gram needs no further ones but backoff weights of longer, unknown ones.
    """

    def __init__(self, langs: list[str], keys: list[np.ndarray], logp: list[np.ndarray], backoff: list[np.ndarray]):
        self.langs, self.keys, self.logp, self.backoff, self.starts = langs, keys, logp, backoff, [None] * len(keys)

    @classmethod
    def fit(cls, counts: dict[str, Counter], order: int = ORDER) -> CharModels:
        """``counts``: words by language."""
        return cls.of({k: longest(c, order) for k, c in counts.items()}, order)

    @classmethod
    def of(cls, counts: dict[str, tuple[list[str], list[int]]], order: int = ORDER) -> CharModels:
        """``counts``: the longest gram of each place and how often, by language. Languages in order of their names."""
        langs = sorted(counts)
        spelled = [spell(counts[lang][0], order) for lang in langs]
        per = []  # by language, by order: keys, counts
        for lang, (hashes, _, sizes) in zip(langs, spelled, strict=True):
            weight = np.minimum(np.array(counts[lang][1], np.float64), 1e12)
            levels = []
            for k in range(order):
                ok = sizes > k
                uniq, inv = np.unique(hashes[k][ok], return_inverse=True)
                levels.append([uniq, np.bincount(inv, weight[ok], len(uniq))])
            frame = spell(["\x02"], 1)[0][0]  # a context, but never what follows one
            at = np.searchsorted(levels[0][0], frame)
            levels[0] = [np.insert(levels[0][0], at, frame), np.insert(levels[0][1], at, 0.0)]
            # continuation counts: in how many distinct longer n-grams an n-gram ends
            for k in range(order - 1):
                ok = sizes > k + 1
                _, at = np.unique(hashes[k + 1][ok], return_index=True)
                short = hashes[k][ok][at]
                u, c = np.unique(short, return_counts=True)
                full = levels[k][1]
                # n-grams at a word's start have no longer form: they keep their counts
                pos = np.searchsorted(levels[k][0], u)
                cont = np.where(np.isin(levels[k][0], u), 0.0, full)
                cont[pos] = c
                levels[k][1] = cont
            per.append(levels)
        keys = [np.unique(np.concatenate([p[k][0] for p in per])) for k in range(order)]
        logp, backoff = [], []
        suffix, context = cls._links(spelled, keys, order)
        lower = np.full((len(keys[0]), len(langs)), 1.0 / ALPHABET)
        for k in range(order):
            value = np.zeros((len(keys[k]), len(langs)))
            gamma = np.ones((len(keys[k - 1]) if k else 1, len(langs)))
            for j, p in enumerate(per):
                key, c = p[k]
                row = np.searchsorted(keys[k], key)
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))
                ctx = context[k][row]
                total = np.bincount(ctx, c, len(gamma))
                kinds = np.bincount(ctx[c > 0], minlength=len(gamma))  # the frame is no letter
                seen = total > 0
                gamma[seen, j] = d * kinds[seen] / total[seen]
                value[row, j] = np.maximum(c - d, 0) / total[ctx]
            if k:
                lower = np.exp(logp[k - 1])[suffix[k]]
            full = value + gamma[context[k]] * lower
            logp.append(np.log(np.maximum(full, 1e-12)).astype(np.float32))
            backoff.append(np.log(np.maximum(gamma, 1e-12)).astype(np.float32))
        return cls(langs, keys, logp, backoff)

    @staticmethod
    def _links(spelled, keys, order):
        suffix, context = [None] * order, [np.zeros(len(keys[0]), np.int64)] + [None] * (order - 1)
        for k in range(1, order):
            suffix[k] = np.zeros(len(keys[k]), np.int64)
            context[k] = np.zeros(len(keys[k]), np.int64)
        for hashes, before, sizes in spelled:
            for k in range(1, order):
                ok = sizes > k
                row = np.searchsorted(keys[k], hashes[k][ok])
                suffix[k][row] = np.searchsorted(keys[k - 1], hashes[k - 1][ok])
                context[k][row] = np.searchsorted(keys[k - 1], before[k - 1][ok])
        return suffix, context

    def rows(self, k: int, h: np.ndarray) -> np.ndarray:
        """Rows of hashes among an order's n-grams, or -1: the first bits tell where to look, as hashes spread evenly."""
        keys = self.keys[k]
        if not len(keys):
            return np.full(len(h), -1)
        if self.starts[k] is None:
            bits = len(keys).bit_length()
            head = keys >> np.uint64(64 - bits)
            self.starts[k] = np.uint64(64 - bits), np.searchsorted(head, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        shift, starts = self.starts[k]
        head = (h >> shift).astype(np.int64)
        at, end = starts[head], starts[head + 1]
        out = np.where((at < end) & (keys[np.minimum(at, len(keys) - 1)] == h), at, -1)
        open_ = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            hit = keys[at[open_]] == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (at[open_] + 1 < end[open_])]
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability a word and language, characters a word with its end)."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.float32)
        hashes, place, word = grams(words, len(self.keys))
        n = len(place)
        unseen = np.float32(-np.log(2.0 * ALPHABET))
        value = np.full((n, len(self.langs)), unseen, np.float32)
        before = None  # row of the (k)-gram that ends one place earlier, or -1
        for k in range(len(self.keys)):
            row = np.where(place >= k, self.rows(k, hashes[k]), -1)
            if k:
                known = np.full(n, -1)
                known[1:] = before[:-1]
                step = (known >= 0) & (row < 0) & (place >= k)
                value[step] += self.backoff[k][known[step]]
            hit = (row >= 0) & (place >= 1)
            value[hit] = self.logp[k][row[hit]]
            before = row
        value[place == 0] = 0
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        total = np.add.reduceat(value, np.concatenate([[0], ends[:-1]]), axis=0)
        return total, np.fromiter((len(w) + 1 for w in words), np.float32, len(words))


def composed(text: str) -> str:
    """In lower case, composed: an accent as a mark of its own would cut its word."""
    text = text.lower()
    return text if is_normalized("NFC", text) else normalize("NFC", text)


def letters(text: str) -> list[str]:
    """Runs of letters of a composed text."""
    return LETTERS.findall(composed(text))


class Scorer:
    """Word scores are kept, up to ``limit`` words; a text's score is the sum over its words."""

    def __init__(self, models: CharModels, limit: int = 120_000):
        self.models, self.limit, self.rows = models, limit, {}
        self.table = np.zeros((1024, len(models.langs) + 1), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability a text and language, characters); no characters where a text has no letter."""
        words = [letters(t) if t else [] for t in texts]
        words = [w if w and (w[0].isalpha() or any(c.isalpha() for x in w for c in x)) else [] for w in words]
        if len(self.rows) >= self.limit:
            self.rows = dict.fromkeys(())
        new = list(set().union(*words).difference(self.rows))
        if new:
            first = len(self.rows)
            if first + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), first + len(new)), self.table.shape[1]), np.float32)
                grown[:first] = self.table[:first]
                self.table = grown
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                total, size = self.models.score(part)
                self.table[first + a : first + a + len(part), :-1] = total
                self.table[first + a : first + a + len(part), -1] = size
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        out = np.zeros((len(texts), self.table.shape[1]), np.float64)
        ends = np.cumsum(n)
        for i in range(len(texts)):
            if n[i]:
                out[i] = self.table[flat[ends[i] - n[i] : ends[i]]].sum(axis=0, dtype=np.float64)
        return out[:, :-1], out[:, -1]


#: Lengths in characters at which a text counts as middling and as long; short texts scatter more.
CLASSES = (20, 100)


def fit(docs: DataFrame, order: int = ORDER) -> tuple[CharModels, np.ndarray] | None:
    """Models and rejection limits from labelled rows (text, lang), or None if there are none.

    All rows count. Four fifths of the texts, by a hash, train the models, each row as often as it stands there;
    the others, each text once, calibrate: a limit is the 0.999 quantile of their cross-entropy by
    language and length class, plus a nat. Languages of fewer than 10 rows, or with a part that is empty, do both on
    all rows. A text beyond the limits of all languages is rejected. The driver gets the distinct grams.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", (F.pmod(F.xxhash64("text", F.lit(11)), F.lit(5)) == 0).alias("apart"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("apart").alias("kept")).collect()
    if not sizes:
        return None
    both = F.col("lang").isin([r["lang"] for r in sizes if r["n"] < 10 or r["kept"] in (0, r["n"])])

    def count(batches):
        tokens: dict[str, Counter] = {}

        def turned():
            for lang, found in tokens.items():
                words = Counter()
                for t, n in found.items():
                    for w in (t,) if t.isalpha() else LETTERS.findall(t):
                        words[w] += n
                gram, n = longest(words, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            tokens.clear()

        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                tokens.setdefault(lang, Counter()).update(composed(t.as_py()).split())
                if sum(map(len, tokens.values())) >= TOKENS:
                    yield from turned()
        yield from turned()

    table = rows.filter(~F.col("apart") | both).select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    for lang in pc.unique(table.column("lang")).to_pylist():
        mine = table.filter(pc.equal(table.column("lang"), lang))
        counts[lang] = mine.column("gram").to_pylist(), mine.column("n").to_pylist()
    if not counts:
        return None
    models = CharModels.of(counts, order)
    apart = rows.filter(F.col("apart") | both).groupBy("lang", F.xxhash64("text", F.lit(11)).alias("place")).agg(F.first("text").alias("text"))
    return models, calibrated(models, apart.select("text", "lang"))


def rates(models: CharModels, texts: list[list[str]], langs: list[str]):
    """(language, length class, cross-entropy) of texts' words; short classes are measured on runs of them."""
    words = list({w for t in texts for w in t})
    total, size = models.score(words)
    row, of = dict(zip(words, range(len(words)), strict=True)), {x: i for i, x in enumerate(models.langs)}
    for t, lang in zip(texts, langs, strict=True):
        if t and lang in of:
            at = [row[w] for w in t]
            cost, n = (-total[at, of[lang]].astype(np.float64)).tolist(), size[at].astype(np.int64).tolist()
            if sum(n) >= CLASSES[-1]:
                yield lang, len(CLASSES), sum(cost) / sum(n)
            for k, most in enumerate(CLASSES):
                run = seen = 0
                for x, m in zip(cost, n, strict=True):
                    run += x
                    seen += m
                    if seen >= most / 4:
                        yield lang, k, run / seen
                        run = seen = 0


def calibrated(models: CharModels, apart: DataFrame) -> np.ndarray:
    """The largest cross-entropy that is taken for each language, a row a length class, from all rows (text, lang).

    Rates are counted to a ten thousandth of a nat, so that the driver gets as many rows at any size.
    """
    shared = apart.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        seen = Counter()
        for b in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            seen.update((lang, k, round(x * 10_000)) for lang, k, x in rates(shared.value, [letters(t.as_py()) for t in b.column(0)], b.column(1).to_pylist()))
        lang, k, x = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(x, pa.int64()), pa.array(seen.values(), pa.int64())], names=["lang", "k", "x", "n"])

    found: dict = {}
    for r in apart.mapInArrow(measure, "lang string, k int, x long, n long").groupBy("lang", "k", "x").agg(F.sum("n").alias("n")).orderBy("x").collect():
        found.setdefault((r["lang"], r["k"]), []).append((r["x"] / 10_000, r["n"]))
    shared.unpersist()
    limits = np.full((len(CLASSES) + 1, len(models.langs)), np.inf)
    for i, lang in enumerate(models.langs):
        for k in range(len(CLASSES) + 1):
            if (lang, k) in found:
                x, n = map(np.array, zip(*found[(lang, k)], strict=True))
                ends = np.cumsum(n)
                at = 0.999 * (ends[-1] - 1)
                low, high = (x[np.searchsorted(ends, j, "right")] for j in (int(at), int(np.ceil(at))))
                limits[k, i] = low + (high - low) * (at - int(at)) + 1.0
        known = limits[:, i][np.isfinite(limits[:, i])]
        limits[:, i] = np.where(np.isfinite(limits[:, i]), limits[:, i], known.max() if len(known) else np.inf)
    # a shorter text is never judged more strictly than a longer one
    return np.maximum.accumulate(limits[::-1], axis=0)[::-1]


def identify(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", extra: tuple = ()) -> DataFrame:
    """Rows of (``doc_id``, ``extra``, lang_pred, score, cross_entropy, rejected) by each whole text.

    The language with the lowest cross-entropy a character wins (ties: the first name); ``score`` is
    its share of a softmax over the rates, at a sharpness that grows with the text up to 40
    characters. Null, empty and letterless texts give ``und``, score 0, rejected; so does every text
    if nothing could be learned. Repeated rows repeat their result.
    """
    spark = docs.sparkSession
    cols = [F.col(doc_id), *[F.col(c) for c in extra], F.col(text).alias("_text")]
    rows = docs.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema += ", lang_pred string, score double, cross_entropy double, rejected boolean"
    shared = spark.sparkContext.broadcast(model)
    token = f"{id(shared)}-{np.random.randint(1 << 60)}"

    def run(batches):
        scorer = held(token, lambda: Scorer(shared.value[0]) if shared.value else None)
        limits = shared.value[1] if shared.value else None
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                texts = part.column(part.num_columns - 1).to_pylist()
                lang, score, rate, bad = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
                if scorer:
                    total, size = scorer.texts(texts)
                    has = size > 0
                    ce = -total[has] / size[has, None]
                    best = ce.argmin(axis=1)
                    sharp = np.minimum(size[has], 40.0)[:, None]
                    odds = np.exp(-(ce - ce.min(axis=1, keepdims=True)) * sharp)
                    low = ce[np.arange(len(best)), best]
                    score[has], rate[has] = 1 / odds.sum(axis=1), low
                    bad[has] = (ce > limits[np.searchsorted(CLASSES, size[has], "right")]).all(axis=1)
                    for i, j in zip(np.flatnonzero(has), best, strict=True):
                        lang[i] = scorer.models.langs[j]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lang), pa.array(score), pa.array(rate, mask=np.isnan(rate)), pa.array(bad)],
                    names=[*part.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return rows.mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    rows = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return identify(rows, model, extra=("held_out",))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the identification rejects go; the others stay as they were."""
    small_batches(spark)
    model = fit(docs.filter(fold("doc_id", 3) != 1))
    cols = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    return identify(rows, model, extra=("_row",)).filter("NOT rejected").select("_row.*")

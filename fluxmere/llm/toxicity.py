"""Toxicity behind disguises: noisy-channel restoration by Viterbi decoding, then a learned score."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Kept, fold, held, small_batches, stored

#: Features kept; distinct tokens that a task counts before it turns them to trigrams; texts that it restores before it hands on what it found.
FEATURES, TOKENS, SLICE = 400, 100_000, 1000
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7

# Letters that a written sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou",
}
_SIGNS = re.escape("".join(LEET))
WORD = re.compile(r"[^\W\d_]+")
# A spread span: single letters or signs with separators between; punctuation may stand at both ends.
_UNIT, _SEP = rf"[^\W_{_SIGNS}]|[{_SIGNS}]", r"[ .\-_*]{1,2}"
_UNIT = f"(?:{_UNIT})"
_SPREAD = rf"(?<![^\W_])(?:{_UNIT}{_SEP}){{2,}}{_UNIT}(?![^\W_])"
SPREAD = re.compile(rf"([^\w\s]*)({_SPREAD})", re.IGNORECASE)
STEP = re.compile(rf"{_UNIT}({_SEP}(?={_UNIT}))?", re.IGNORECASE)
TOKEN = re.compile(r"\S+")
#: Where a lattice has more than one path: signs inside words, spread letters, letters three times.
SUSPECT = re.compile(
    rf"(?:(?<![^\w\s])[^\w\s]*)?{_SPREAD}"
    rf"|\S*[^\W\d_][{_SIGNS}]\S*"
    rf"|\S*[{_SIGNS}][^\W\d_]\S*"
    rf"|\S*([^\W\d_])\1\1\S*",
    re.IGNORECASE,
)
PLAIN, TRIPLE = ",;:?\"'", re.compile(r"([^\W\d_])\1\1")
#: What a spread span that holds white space has: a sign or letter between separators, then a last one.
SPACED = re.compile(rf"[ .\-_*]{_UNIT}{_SEP}{_UNIT}(?![^\W_])")
CHEAP = re.compile(rf"[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]|([^\W\d_])\1\1|(?<![^\W_]){_UNIT}{_SEP}{_UNIT}[ .\-_*]", re.IGNORECASE)

# Channel costs (negative log probabilities) of writing a letter otherwise than as itself.
COST_SIGN, COST_SKIP, COST_PLAIN, COST_KEEP = 1.2, 0.4, 0.05, 4.0
COST_BORDER = 3.0  # a separator of a spread span that ends a word
# By the length of a run: a letter dropped, a letter meant. Doubled letters are mostly meant.
COST_DROP, COST_MEANT = {2: 5.0}, {2: 0.05}
COST_DROP_LONG, COST_MEANT_LONG = 0.3, 1.5


def trigrams(words: Counter) -> Counter:
    """Character trigrams over framed words; shorter grams are sums of these."""
    if not words:
        return Counter()
    lengths = np.fromiter((len(w) + 3 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"\x02\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    inside[ends - 1] = inside[ends - 2] = False  # no trigram reaches into the next word
    keys, at = np.unique((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[inside[:-2]], return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths - 2))
    return Counter({chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)})


class CharModel:
    """Character trigrams over framed words, interpolated with lower orders."""

    def __init__(self, words: Counter, counted: Counter | None = None):
        grams: list[Counter] = [Counter(), Counter(), trigrams(words) if counted is None else counted]
        for g, n in grams[2].items():
            grams[0][g[2:]] += n
            grams[1][g[1:]] += n
        self.grams, self.total = grams, max(1, sum(grams[0].values()))
        self.context: list[Counter] = [Counter(), Counter(), Counter()]
        self.kinds: list[Counter] = [Counter(), Counter(), Counter()]
        for k in (1, 2):
            for g, n in grams[k].items():
                self.context[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1
        self.cost = lru_cache(50_000)(self._cost)

    def __reduce__(self):
        return (_rebuilt, (self.grams, self.total, self.context, self.kinds))

    def _cost(self, history: str, c: str) -> float:
        p = (self.grams[0][c] + 0.1) / (self.total + 1000)
        for k in (1, 2):
            h = history[2 - k :]
            n, kinds = self.context[k][h], self.kinds[k][h]
            if n:
                p = (self.grams[k][h + c] + kinds * p) / (n + kinds)
        return -log(p)


def _rebuilt(grams, total, context, kinds) -> CharModel:
    out = CharModel(Counter())
    out.grams, out.total, out.context, out.kinds = grams, total, context, kinds
    return out


def decode(span: str, lm: CharModel) -> str:
    """The likeliest word behind a disguised span, or the span as it is if no reading beats that.

    The lattice: a letter stands for itself or, in a run, for one letter; a sign stands for its
    letters or for itself; separators between spread letters stand for nothing or end a word. Viterbi over states
    of the last two letters; cost is the channel's plus the language model's.
    """
    text = span.lower()
    spread = SPREAD.fullmatch(text)
    head = re.match(r"[^\w@$!|+€£¡(*]*", text).end()
    tail = len(text) - len(re.search(r"[^\w@$|+€£*]*$", text).group())
    if spread:
        head, tail = spread.span(2)
    body = text[head:tail] if tail > head else ""
    between = {i for m in STEP.finditer(body) if m.group(1) for i in range(*m.span(1))} if spread else ()
    # best: state -> (cost, restored as linked cells); a state is the last two letters and the last source sign
    best = {("\x02\x02", ""): (0.0, None)}
    runs = [len(r.group()) for r in re.finditer(r"(.)\1*", body, re.DOTALL) for _ in r.group()]
    for i, c in enumerate(body):
        nxt: dict = {}
        again = i > 0 and body[i - 1] == c
        drop, meant = COST_DROP.get(runs[i], COST_DROP_LONG), COST_MEANT.get(runs[i], COST_MEANT_LONG) if again else COST_PLAIN

        def put(state, cost, out, nxt=nxt):
            if state not in nxt or cost < nxt[state][0]:
                nxt[state] = (cost, out)

        for (h, last), (cost, out) in best.items():
            if i in between:
                put((h, last), cost + COST_SKIP, out)
                if h != "\x02\x02":
                    put(("\x02\x02", ""), cost + COST_BORDER + lm.cost(h, "\x03"), (" ", out))
                continue
            if c == last and out:  # the same sign again: another beat of the same letter
                put((h, last), cost + drop, out)
            if c.isalpha():
                put((h[1] + c, c), cost + meant + lm.cost(h, c), (c, out))
                continue
            for r in LEET.get(c, ""):
                put((h[1] + r, c), cost + COST_SIGN + meant + lm.cost(h, r), (r, out))
            # the sign itself: ends a word, begins another
            put(("\x02\x02", c), cost + COST_KEEP + lm.cost(h, "\x03"), (c, out))
        best = nxt
    if not best:
        return text
    cell, letters = min(((v[0] + lm.cost(k[0], "\x03"), v[1]) for k, v in best.items()), key=lambda x: x[0])[1], []
    while cell:
        letters.append(cell[0])
        cell = cell[1]
    return text[:head] + "".join(reversed(letters)) + text[tail:]


def restore(text: str, lm: CharModel, memory: dict) -> str:
    """A whole text in lower case, its suspect spans decoded. A distinct span is decoded once."""
    if not CHEAP.search(text):
        return text.lower()

    def put(m: re.Match) -> str:
        span = m.group()
        out = memory.get(span)
        if out is None:
            out = decode(span, lm)
            if len(memory) < 50_000 and len(span) < 100:
                memory[span] = out
        return out

    return SUSPECT.sub(put, text).lower()


def features(word: str) -> list[str]:
    """A word and its beginnings: inflected insults share a stem."""
    return [word + "$", *(word[:n] for n in PREFIXES if n <= len(word))]


class Model:
    """Log likelihood ratios of features; a logistic of their sum and of the text's length on top."""

    def __init__(self, lm: CharModel, ratios: dict[str, float], line: tuple[float, float, float]):
        self.lm, self.ratios, self.line = lm, ratios, line

    def __reduce__(self):
        return (Model, (self.lm, self.ratios, self.line))


class Restorer:
    """Distinct words of whole texts, disguises taken off. The words of tokens lately met are kept.

    A span that is decoded lies within a token (a run without white space) unless spread letters
    have white space between them; texts that may hold such a span are restored as a whole.
    """

    def __init__(self, lm: CharModel):
        self.lm, self.spans, self.tokens = lm, {}, Kept(self.token)

    def token(self, token: str) -> tuple[str, ...]:
        return tuple(WORD.findall(restore(token, self.lm, self.spans)))

    def split(self, tokens: set[str]) -> set[str]:
        """Words of tokens: most are a word, with punctuation that stands for no letter, and have one reading."""
        plain = set(filter(str.isalpha, tokens))
        odd = []
        for t in tokens - plain:
            core = t.strip(PLAIN)
            if core.isalpha():
                plain.add(core)
            else:
                odd.append(t)
        out = set(map(str.lower, plain))
        if TRIPLE.search("\n".join(out)):
            again = {w for w in out if TRIPLE.search(w)}
            out -= again
            odd += again
        whole = set(filter(str.isalpha, out))
        if len(whole) < len(out):  # lower case of a few letters is a letter and a mark
            odd += out - whole
        return whole.union(*map(self.tokens.__getitem__, odd))

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        if not SPACED.search(text):
            return self.split(set(text.split()))
        # only tokens near spread letters are restored together
        spans = [m.span() for m in TOKEN.finditer(text)]
        starts, near = [a for a, _ in spans], set()
        for m in SPACED.finditer(text):
            i, j = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
            near.update(range(max(0, i - 2), min(len(spans), j + 3)))
        out = self.split({text[a:b] for k, (a, b) in enumerate(spans) if k not in near})
        for k in sorted(near):
            if k - 1 not in near:
                first = spans[k][0]
            if k + 1 not in near:
                out.update(WORD.findall(restore(text[first : spans[k][1]], self.lm, self.spans)))
        return out


class Scorer:
    """Ratios are looked up by a word's first letters, which most words share with no feature."""

    def __init__(self, model: Model):
        self.model, self.restorer = model, Restorer(model.lm)
        self.heads = {f.rstrip("$")[:3] for f in model.ratios}

    def weight(self, word: str) -> float:
        return max((self.model.ratios.get(f, 0.0) for f in features(word)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """(summed ratios of a text's distinct words, log of how many it has)."""
        words = self.restorer.words(text)
        heads = self.heads
        return sum(self.weight(w) for w in words if w[:3] in heads), log(1 + len(words))

    def score(self, text: str | None) -> float:
        (a, b, c), (x, n) = self.model.line, self.evidence(text)
        return 1 / (1 + exp(-max(-30.0, min(30.0, a + b * x + c * n))))


def counted(texts: DataFrame) -> Counter:
    """Character trigrams of all words of all ``texts`` (text), each row counted; the driver gets the distinct ones."""

    def count(batches):
        tokens, out = Counter(), Counter()

        def turn():
            words = Counter()
            for t, n in tokens.items():
                for w in (t,) if t.isalpha() else WORD.findall(t):
                    words[w] += n
            tokens.clear()
            out.update(trigrams(words))

        for b in batches:
            for t in b.column(0):
                tokens.update(t.as_py().lower().split())
                if len(tokens) >= TOKENS:
                    turn()
        turn()
        yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], names=["g", "n"])

    grams = texts.filter("text IS NOT NULL").select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return Counter(dict(zip(grams.column(0).to_pylist(), grams.column(1).to_pylist(), strict=True)))


def fit(labelled: DataFrame, background: DataFrame, keep: int = FEATURES) -> Model | None:
    """A model from rows (text, toxic), and (text) for the character model. None without both labels.

    All rows count, whatever their number and length. The character model counts every row of the background,
    and the toxic texts as often as makes them as many. Labelled texts count once each, toxic if a copy is.
    Features that 1 in 100 toxic texts hold (4 at least) and that are 20 times as frequent there are taken
    by support; one that begins another, or the other way round, is taken once. A logistic regression
    turns the sum of a text's log likelihood ratios, each of a distinct word's best feature, and the
    number of its words, among which some match by chance, into a probability.

    Labelled texts are restored once: what is kept of them is which features, of those that enough
    toxic texts hold, their words have. Counts and evidence come from that.
    """
    rows = labelled.filter("text IS NOT NULL AND toxic IN (0, 1)")
    rows = stored(rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.sha1("text").alias("sha")), "toxic-labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("sha").agg(F.max("toxic").alias("toxic")).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    toxic = stored(rows.filter("toxic = 1").groupBy("sha").agg(F.first("text").alias("text")).select("text"), "toxic-texts")
    grams, often = counted(background), max(1, round(background.filter("text IS NOT NULL").count() / sizes[1]))
    for g, n in counted(toxic).items():
        grams[g] += often * n
    lm = CharModel(Counter(), grams)

    def held_features(batches):
        restorer, seen = Restorer(lm), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update({f for w in restorer.words(t) for f in features(w)})
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["f", "bad"])

    support = toxic.mapInArrow(held_features, "f string, bad long").groupBy("f").agg(F.sum("bad").alias("bad"))
    names = [r["f"] for r in support.filter(F.col("bad") >= max(4, sizes[1] // 100)).orderBy("f").collect()]
    ids = {f: i for i, f in enumerate(names)}

    def matched(batches):
        restorer = Restorer(lm)
        of = Kept(lambda w: tuple(ids[f] for f in features(w) if f in ids))
        for b in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            n, ends, flat = [], [0], array("i")
            for t in b.column(0):
                words = restorer.words(t.as_py())
                # a feature stands here once for each distinct word that has it
                for w in words:
                    flat.extend(of[w])
                n.append(len(words))
                ends.append(len(flat))
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(n, pa.int64()), hits], names=["sha", "toxic", "n", "hits"])

    found = rows.select("text", "sha", "toxic").mapInArrow(matched, "sha string, toxic int, n long, hits array<int>")
    found = found.groupBy("sha").agg(F.max("toxic").alias("toxic"), F.first(F.struct("n", "hits")).alias("of"))
    found = stored(found.select("toxic", "of.n", "of.hits"), "toxic-features")

    def counts(batches):
        seen, some = np.zeros((2, len(names)), np.int64), max(1, 4_000_000 // max(1, len(names)))
        for b in (b.slice(a, some) for b in batches for a in range(0, b.num_rows, some)):
            holds = np.zeros((b.num_rows, len(names)), bool)
            holds[np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy())), b.column(1).flatten().to_numpy()] = True
            bad = b.column(0).to_numpy() == 1
            seen += np.stack([holds[~bad].sum(axis=0), holds[bad].sum(axis=0)])
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["i", "clean", "bad"])

    table = found.select("toxic", "hits").mapInArrow(counts, "i long, clean long, bad long").groupBy("i").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).collect()
    over = [(r["i"], r["clean"], r["bad"]) for r in table if (r["bad"] / sizes[1]) / ((r["clean"] + 0.5) / sizes[0]) >= 20]
    pool: dict[int, float] = {}
    stems: list[str] = []
    for i, clean, bad in sorted(over, key=lambda x: (-x[2], x[1], -len(names[x[0]]), names[x[0]])):
        stem = names[i].rstrip("$")
        if len(pool) < keep and not any(stem.startswith(p) or p.startswith(stem) for p in stems):
            stems.append(stem)
            pool[i] = log((bad / sizes[1]) / ((clean + 0.5) / sizes[0]))
    if not pool:
        return Model(lm, {}, (log(sizes[1] / sizes[0]), 0.0, 0.0))
    ratio = np.zeros(len(names))
    ratio[list(pool)] = list(pool.values())

    def weighed(batches):
        for b in batches:
            # no word has two features of the pool, so that a sum over features is one over words
            total = np.concatenate([[0.0], np.cumsum(ratio[b.column(2).flatten().to_numpy()])])
            ends = np.cumsum(np.diff(b.column(2).offsets.to_numpy()))
            x = np.minimum(np.diff(total[np.concatenate([[0], ends])]), 40.0)
            n = np.log1p(b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.abs(x.round(1))), pa.array(n.round(1)), b.column(0)], names=["x", "n", "toxic"])

    drawn = found.mapInArrow(weighed, "x double, n double, toxic int").groupBy("x", "n", "toxic").agg(F.count("*").alias("c")).collect()
    drawn = sorted((r["x"], r["n"], r["toxic"], r["c"]) for r in drawn)
    x = np.array([[1.0, r[0], r[1]] for r in drawn])
    y, c = np.array([float(r[2]) for r in drawn]), np.array([float(r[3]) for r in drawn])
    return Model(lm, {names[i]: r for i, r in pool.items()}, tuple(map(float, logistic(x, y, c))))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton steps of a logistic regression over rows that stand for ``n`` texts each."""
    w = np.zeros(x.shape[1])
    w[0] = log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, model: Model | None, extra: tuple = (), text: str = "text") -> DataFrame:
    """Rows of ``extra`` with ``score``, the chance that a whole text is toxic, and ``predicted``.

    A null or empty text has no feature and gets the score of such texts; without a model every
    score is 0. Repeated rows repeat their result; columns not in ``extra`` aren't read.
    """
    rows = docs.select(*extra, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double", "predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"{id(shared)}-{np.random.randint(1 << 60)}"

    def run(batches):
        scorer = held(token, lambda: Scorer(shared.value) if shared.value else None)
        for b in batches:
            score = np.array([scorer.score(t.as_py()) if scorer else 0.0 for t in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, schema)


def learn(spark, docs: DataFrame, sf_dir: str) -> Model | None:
    """Fit on rows whose id falls in the learning folds. One label a doc_id: a toxic one wins."""
    rows = docs.select("doc_id", "text").filter(fold("doc_id", 3) != 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # joined alike at any size: labels grow with the documents
    return fit(rows.join(labels.hint("merge"), "doc_id"), rows)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(spark, docs, sf_dir)
    return toxicity(docs.withColumn("held_out", fold("doc_id", 3) == 1), model, extra=("doc_id", "held_out"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows predicted toxic go; the others stay as they were."""
    small_batches(spark)
    model = learn(spark, docs, sf_dir)
    cols = docs.columns
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    return toxicity(rows, model, extra=("_row",)).filter("predicted = 0").select("_row.*")

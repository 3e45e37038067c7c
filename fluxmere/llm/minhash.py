"""Near-duplicates by BagMinHash signatures of word shingles, banded and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .embed import roots
from .textvec import counted, mix64, shingles, slices, utf8, words
from .util import fresh, held, small_batches, stored

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
SLICE = 1 << 18  # bytes of text whose signatures are drawn at once; arrivals take about a hundred times as much
#: Shingles of pairs that are compared at once.
LOAD = 1 << 18


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * (1.0 / (1 << 53))


def bag_minhash(key: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """An n_texts by m signature whose agreement is the weighted Jaccard similarity in expectation.

    Weights are discretised to 1, 2, 3, ... An element owns a Poisson process over time and weight,
    split by a hierarchy of dyadic weight intervals (0, 1], (1, 2], (2, 4], (4, 8], ...: each has its
    own arrivals, seeded by element and interval, at a rate of its width; an arrival has a uniform
    weight in its interval and a uniform component, and counts if that weight lies below the
    element's. A component keeps its earliest arrival. Arrivals are drawn in order of time and only
    up to the time by which a text of this total weight has filled all components, nearly always;
    texts that still miss one are drawn again to twice that time, so the result is exact.
    """
    best_t = np.full(n_texts * m, np.inf)
    best = np.zeros(n_texts * m, np.uint64)
    if not len(key):
        return best.reshape(n_texts, m)
    with np.errstate(over="ignore"):
        elements, owners, tops, lows, widths = [], [], [], [], []
        low, width = 0, 1
        while True:
            on = np.flatnonzero(weight > low)
            if not len(on):
                break
            elements.append(mix64(key[on] + np.uint64((low * 2 + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
            owners.append(text[on])
            tops.append(weight[on])
            lows.append(np.full(len(on), low))
            widths.append(np.full(len(on), width))
            low, width = low + width, max(width, low + width)
        seed, owner, top, low, width = (np.concatenate(x) for x in (elements, owners, tops, lows, widths))
        total = np.bincount(text, weight, n_texts)
        horizon = np.where(total > 0, m * (np.log(m) + 5) / np.maximum(total, 1), 0.0)
        whole = np.zeros(len(seed))  # time so far
        live = np.arange(len(seed))
        step, limit, block = np.zeros(len(seed), np.uint64), horizon, 1
        while len(live):
            s = seed[live]
            base = mix64(s[:, None] + (step[live][:, None] + np.arange(1, block + 1, dtype=np.uint64)[None, :]) * np.uint64(0xD1342543DE82EF95))
            times = whole[live][:, None] + np.cumsum(-np.log(unit(base)) / width[live][:, None], axis=1)
            within = times <= limit[owner[live]][:, None]
            i, j = np.nonzero(within)
            if len(i):
                e, id_, at = live[i], base[i, j], times[i, j]
                level = low[e] + width[e] * unit(mix64(id_ + np.uint64(1)))
                on = level <= top[e]
                e, id_, at = e[on], mix64(id_[on] + np.uint64(2)), at[on]
                slot = owner[e] * m + (id_ % np.uint64(m)).astype(np.int64)
                order = np.lexsort((id_, at, slot))
                slot, at, id_ = slot[order], at[order], id_[order]
                first = np.ones(len(slot), bool)
                first[1:] = slot[1:] != slot[:-1]
                slot, at, id_ = slot[first], at[first], id_[first]
                better = at < best_t[slot]
                best_t[slot[better]], best[slot[better]] = at[better], id_[better]
            whole[live], step[live] = times[:, -1], step[live] + np.uint64(block)
            live = live[within[:, -1]]
            block = 16
            if not len(live):
                missing = ((best_t.reshape(n_texts, m) == np.inf).any(axis=1)) & (total > 0)
                if missing.any():
                    limit = np.where(missing, limit * 2, 0.0)
                    live = np.flatnonzero(missing[owner])
                    whole[live], step[live] = 0.0, 0
    return best.reshape(n_texts, m)


SIGNED = "doc_id long, k1 long, k2 long, n_words int, bands array<long>"


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, n_words, bands): two hashes of the whole word sequence, and a key for each band."""

    def run(batches):
        held("bags", dict)  # what earlier stages keep in this worker goes
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, bounds = words(*utf8(part.column(1)))
                n = part.num_rows
                key, owner, count = counted(*shingles(h, bounds, size))
                sig = bag_minhash(key, owner, count.astype(np.float64), n, bands * rows)
                with np.errstate(over="ignore"):
                    band = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
                    for r in range(rows):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                    owner = np.repeat(np.arange(n), np.diff(bounds))
                    place = (np.arange(len(h)) - bounds[:-1][owner] + 1).astype(np.uint64)
                    keys = []
                    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
                        total = np.zeros(len(h) + 1, np.uint64)
                        np.cumsum(mix64(h ^ mix64(place * np.uint64(salt))), out=total[1:])
                        keys.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, keys), pa.array(np.diff(bounds).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "k1", "k2", "n_words", "bands"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


class Bags:
    """Shingle multisets of a slice's texts: for each text its distinct shingles, numbered, with counts."""

    def __init__(self, column: pa.Array, size: int):
        n = len(column)
        key, self.text, self.count = counted(*shingles(*words(*utf8(column)), size))
        self.kinds, self.id = np.unique(key, return_inverse=True)
        order = np.lexsort((self.id, self.text))
        self.text, self.id, self.count = self.text[order], self.id[order], self.count[order]
        self.bounds = np.searchsorted(self.text, np.arange(n + 1))
        self.total = np.bincount(self.text, self.count, n)
        self.place = self.text * max(1, len(self.kinds)) + self.id

    def near(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether each pair of texts has a weighted Jaccard similarity of at least ``least``."""
        low, high = np.minimum(self.total[i], self.total[j]), np.maximum(self.total[i], self.total[j])
        out = (low >= least * high) & (low > 0)
        on = np.flatnonzero(out)
        load = np.cumsum(self.bounds[j[on] + 1] - self.bounds[j[on]])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(load, np.arange(LOAD, load[-1] if len(load) else 0, LOAD)) + 1, [len(on)]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = on[a:b]
            x, y = i[part], j[part]
            sizes = self.bounds[y + 1] - self.bounds[y]
            pair = np.repeat(np.arange(len(part)), sizes)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.bounds[y][pair]
            want = x[pair] * max(1, len(self.kinds)) + self.id[at]
            spot = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
            hit = self.place[spot] == want
            both = np.bincount(pair, np.where(hit, np.minimum(self.count[spot], self.count[at]), 0), len(part))
            out[part] = both >= least * (self.total[x] + self.total[y] - both)
        return out

    def matrix(self, rows: np.ndarray, least: float, width: int = 2048) -> np.ndarray:
        """``near`` for all pairs of ``rows`` at once: a multiset is a set of (shingle, occurrence), overlaps are products."""
        n = len(rows)
        size = self.bounds[rows + 1] - self.bounds[rows]
        row = np.repeat(np.arange(n), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + self.bounds[rows][row]
        times = self.count[at]
        row, kind = np.repeat(row, times), np.repeat(self.id[at], times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((row, nth, kind))
        row, kind, nth = row[order], kind[order], nth[order]
        new = np.append(True, (kind[1:] != kind[:-1]) | (nth[1:] != nth[:-1]))[: len(row)]
        column = np.cumsum(new) - 1
        held = np.bincount(column)
        both = np.zeros((n, n), np.float32)
        few = (held[column] > 1) & (held[column] <= 8)
        c, r = column[few], row[few]
        for k in range(1, 8):
            same = np.flatnonzero(c[k:] == c[:-k])
            if len(same):
                both += np.bincount(r[same] * n + r[same + k], minlength=n * n).reshape(n, n).astype(np.float32)
        both += both.T
        many = held[column] > 8
        _, column = np.unique(column[many], return_inverse=True)
        row = row[many]
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            block = np.zeros((n, width), np.float32)
            block[row[a:b], column[a:b] - k * width] = 1
            both += block @ block.T
        total = self.total[rows]
        return both >= least * (total[:, None] + total[None, :] - both)


def whole_groups(batches, rows: int = 2000, size: int = 1 << 20):
    """Record batches of rows sorted by their first column, cut only between groups of equal values.

    A group is a star or a pair of blocks, so what is held is bounded.
    """
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for part in slices(batch, "text", size):
            g = np.asarray(part.column(0))
            if held and (held >= rows or sum(p.nbytes for p in parts) >= size):
                last = np.asarray(parts[-1].column(0))[-1]
                cut = int(np.argmax(g != last)) if (g != last).any() else len(g)
                parts.append(part.slice(0, cut))
                part, g = part.slice(cut), g[cut:]
                held += cut
                if len(g):
                    yield joined(parts)
                    parts, held = [], 0
            if part.num_rows:
                parts.append(part)
                held += part.num_rows
    if held:
        yield joined(parts)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def edges(g: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, g[1:] != g[:-1]))[: len(g)]


def stars(placed: DataFrame, size: int, least: float) -> DataFrame:
    """Rows (g, rep, centre, text), sorted by g: the (a, b) of each group's members that are near one of its centres."""

    def run(batches):
        for part in whole_groups(batches):
            g, rep, centre = (np.asarray(part.column(k)) for k in (0, 1, 2))
            centre = np.asarray(centre, bool)
            bags = Bags(part.column(3), size)
            start = edges(g)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))
            mine = np.flatnonzero(centre)
            first = np.searchsorted(group[mine], np.arange(len(start) + 1))
            others, out_a, out_b = np.flatnonzero(~centre), [], []
            for k in range(int(np.diff(first).max(initial=0))):  # mostly one: a doc_id with several texts has as many
                on = others[first[group[others]] + k < first[group[others] + 1]]
                c = mine[first[group[on]] + k]
                ok = bags.near(c, on, least)
                out_a.append(rep[c[ok]])
                out_b.append(rep[on[ok]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *out_a])), pa.array(np.concatenate([none, *out_b]))], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def blocks(placed: DataFrame, size: int, least: float, dense: int = 24) -> DataFrame:
    """Rows (g, rep, c, side, text), sorted by g: links (a, b) that join different components ``c`` of a group.

    A group whose sides are 0 is one block, compared with itself; else side 1 is compared with side 2.
    A group hands on a spanning forest of its links, so at most one row a member.
    """

    def run(batches):
        for part in whole_groups(batches):
            g, rep, comp, side = (np.asarray(part.column(k)) for k in (0, 1, 2, 3))
            bags = Bags(part.column(4), size)
            start = np.append(edges(g), len(g))
            i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            small_i, small_j = [], []
            for a, b in zip(start[:-1], start[1:], strict=True):
                rows = np.arange(a, b)
                allowed = (comp[rows][:, None] != comp[rows][None, :]) & ((side[rows][:, None] == 0) | (side[rows][:, None] < side[rows][None, :]))
                if b - a <= dense:
                    x, y = np.nonzero(np.triu(allowed | allowed.T, 1))
                    small_i.append(rows[x])
                    small_j.append(rows[y])
                elif allowed.any():
                    x, y = np.nonzero(np.triu((allowed | allowed.T) & bags.matrix(rows, least), 1))
                    low = roots(len(rows), x, y)
                    on = np.flatnonzero(low != np.arange(len(rows)))
                    i.append(rows[low[on]])
                    j.append(rows[on])
            if small_i:
                x, y = np.concatenate(small_i), np.concatenate(small_j)
                ok = bags.near(x, y, least)
                i.append(x[ok])
                j.append(y[ok])
            yield pa.RecordBatch.from_arrays([pa.array(rep[np.concatenate(i)]), pa.array(rep[np.concatenate(j)])], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


#: Members of a block and words in it: what a task compares at once.
BLOCK, BLOCK_WORDS = 512, 300_000


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, component_id, n_words, kept) a row of ``docs``.

    Rows with the same words in the same order form a class, named by its least doc_id; classes
    whose shingle multisets have a weighted Jaccard similarity of ``least`` or more are linked, and
    linked classes form a component, named by its least doc_id; kept marks the row with that id.
    Candidates are classes that agree in a band (25 bands of 5 rows miss a pair at 0.8 once in
    20,000). A bucket's classes are first compared with its least one: stars, cut into blocks of
    members, so a large group is many tasks and needs no pairs. Members of one component can't
    change it, so buckets whose other members still lie in several components are then compared
    only across components: a component that outgrows a block is cut into blocks of its own, the
    others share blocks, and each pair of blocks but those of one component is compared inside a
    task, by matrix products; a task hands on at most one link a member.
    A text of 1 to 4 words is one shingle. Texts without words, null texts and rows with a null
    doc_id are never linked and are their own class. Rows that share a doc_id are one document with
    several texts: what is near any of them is linked to it.
    """
    signed = stored(signatures(docs, doc_id, text, size, bands, rows), "bags")
    live = signed.filter("n_words > 0 AND doc_id IS NOT NULL")
    classes = stored(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")), "bag-classes")
    keys = classes.select("rep", "n_words", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("a")).filter("n > 1")
    members = stored(keys.join(buckets, "key").select("key", "n", "a", "rep", "n_words"), "bag-members")
    ids = members.select("rep").distinct()
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    texts = stored(every.join(ids.hint("shuffle_hash"), every["doc_id"] == ids["rep"]).select("rep", "text"), "bag-texts")

    # stars: a group is a centre with a block of its members
    pairs = members.filter("rep != a").select("a", "rep", "n_words").distinct()
    sizes = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_words") / BLOCK_WORDS)).alias("blocks"))
    dealt = pairs.join(sizes, "a").select("a", "rep", F.xxhash64("a", F.pmod(F.xxhash64("rep"), "blocks")).alias("g"))
    dealt = stored(dealt, "bag-stars")
    ends = dealt.select("g", "rep", F.lit(False).alias("centre")).unionAll(dealt.select("g", F.col("a").alias("rep"), F.lit(True).alias("centre")).distinct())
    placed = ends.join(texts, "rep").select("g", "rep", "centre", "text").repartition("g").sortWithinPartitions("g")
    links = stored(stars(placed, size, least), "bag-links")
    comps = stored(components(links), "bag-components")

    # what stars leave: members of a bucket, but for its centre, in several components
    others = members.filter("n > 2 AND rep != a").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", "n_words", F.coalesce("component", "rep").alias("c"))
    others = stored(others, "bag-others")
    several = others.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum("n_words").alias("w"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark")).filter("lo < hi")
    # equal sets of members are compared in one of their buckets
    several = stored(several.groupBy("m", "w", "mark").agg(F.min("key").alias("key")).select("key", "m"), "bag-several")
    if not several.isEmpty():
        rest = others.join(several, "key").select("key", "rep", "n_words", "c")
        own = rest.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n_words").alias("w"))
        own = own.withColumn("pool", F.when((F.col("m") > block // 2) | (F.col("w") > BLOCK_WORDS // 2), F.col("c")))
        # the blocks of a bucket: those of each large component, and of all others together (pool null)
        pools = own.groupBy("key", "pool").agg(F.greatest(F.ceil(F.sum("m") / block), F.ceil(F.sum("w") / BLOCK_WORDS)).cast("int").alias("parts"))
        rest = rest.join(own.filter("pool IS NOT NULL").select(F.col("key").alias("k"), "pool"), (F.col("key") == F.col("k")) & (F.col("c") == F.col("pool")), "left").drop("k")
        mine = pools.select(F.col("key").alias("k"), F.col("pool").alias("p"), "parts")
        rest = rest.join(mine, (F.col("key") == F.col("k")) & F.col("pool").eqNullSafe(F.col("p"))).select("key", "rep", "c", "pool", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"))
        against = pools.select("key", F.col("pool").alias("pool2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
        rest = rest.join(against, "key").filter(F.col("pool").isNull() | ~F.col("pool").eqNullSafe(F.col("pool2")))
        here, there = (F.xxhash64(F.coalesce(p, F.lit(0)), p.isNull(), part.cast("long")) for p, part in ((F.col("pool"), F.col("part")), (F.col("pool2"), F.col("part2"))))
        side = F.when(here == there, 0).when(here < there, 1).otherwise(2)
        dealt = stored(rest.select("rep", "c", side.alias("side"), F.xxhash64("key", F.least(here, there), F.greatest(here, there)).alias("g")), "bag-blocks")
        placed = dealt.join(texts, "rep").select("g", "rep", "c", "side", "text").repartition("g").sortWithinPartitions("g")
        across = stored(blocks(placed, size, least), "bag-across")
        if not across.isEmpty():
            comps = stored(components(links.unionAll(across)), "bag-components")
    named = classes.select("k1", "k2", "rep").join(comps, classes["rep"] == comps["node"], "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_words", "k1", "k2").join(named, ["k1", "k2"], "left")
    linked = F.col("n_words") > 0
    return out.select(
        "doc_id",
        F.when(linked, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "n_words",
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, the one with the least doc_id.

    Rows that repeat a kept doc_id and its text leave one, of several texts of one doc_id each stays;
    rows without words or without an id stay. Other columns are passed on untouched.
    """
    small_batches(spark)
    cols = docs.columns
    kept, many, sha = fresh(docs, "_kept", "_many", "_sha")
    near = stored(near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(kept)).agg((F.count("*") > 1).alias(many)), "bag-kept")
    # joined alike at any size: what is kept grows with the documents
    rows = docs.join(near.hint("merge"), docs["doc_id"] == near[kept])
    if near.filter(F.col(many)).isEmpty():
        rows = rows.select(*[F.col(f"`{c}`") for c in cols])
    else:
        twice = rows.filter(F.col(many)).withColumn(sha, F.sha1(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", sha])
        rows = rows.filter(~F.col(many)).select(*[F.col(f"`{c}`") for c in cols]).unionAll(twice.select(*[F.col(f"`{c}`") for c in cols]))
    return rows.unionAll(docs.filter("doc_id IS NULL"))

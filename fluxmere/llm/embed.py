"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, verified."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import stored

LEAST, TABLES, PROBES, BLOCK = 0.9, 8, 1, 1024
RECALL = 0.999  # predicted for a pair at the least cosine
_RNG = 0xC0FFEE


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def width_of(d: int) -> int:
    """The power of two that vectors are padded to; 64 at least, as signs and transforms of less rotate too few ways."""
    return 1 << max(6, (d - 1).bit_length())


@lru_cache(256)
def tables_for(width: int, hashes: int, probes: int, least: float, tables: int = TABLES) -> int:
    """Tables, ``tables`` at least, in which a pair with a cosine of ``least`` is predicted to meet with chance RECALL.

    The chance of one table is measured on random pairs at that cosine: it falls with the width and
    with every hash of the tuple. All pairs of one angle have it, so tables multiply.
    """
    rng = np.random.Generator(np.random.PCG64(_RNG + 1))
    n = max(64, (1 << 15) // width)
    a = unit_rows(rng.normal(size=(n, width)))
    b = rng.normal(size=(n, width))
    b = unit_rows(b - (b * a).sum(axis=1, keepdims=True) * a)
    b = least * a + np.sqrt(max(0.0, 1 - least * least)) * b
    ca, cb = codes(a, 16, hashes, probes), codes(b, 16, hashes, probes)
    meet = (ca[:, :, :, None] == cb[:, :, None, :]).any(axis=(2, 3)).mean()
    meet = min(max(meet, 1 / (16 * n)), 1 - 1e-9)
    return max(tables, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet))))


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes, the own one first.

    A hash is the closest vertex of the cross-polytope (the coordinate largest in size, with its
    sign) after three rounds of random signs and Hadamard transform. The probes replace, in one hash
    of the tuple, the closest vertex by the next; those that lose least come first.
    """
    n, d = x.shape
    width = width_of(d)
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.Generator(np.random.PCG64(_RNG))
    signs = rng.integers(0, 2, (tables, hashes, 3, width)) * 2 - 1
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            flip = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[flip] = top[flip][:, ::-1]
            vertex = top * 2 + (y[rows[:, None], top] < 0)
            best.append(vertex[:, 0])
            second.append(vertex[:, 1])
            loss.append(size[rows, top[:, 0]] - size[rows, top[:, 1]])
        base = 2 * width
        own = sum(b * base**k for k, b in enumerate(best))
        out[:, t, 0] = own
        order = np.argsort(np.stack(loss, 1), axis=1)
        swap = np.stack([own + (s - b) * base**k for k, (b, s) in enumerate(zip(best, second, strict=True))], 1)
        for p in range(probes):
            out[:, t, 1 + p] = swap[rows, order[:, min(p, hashes - 1)]]
    return out


def owned(ca: np.ndarray, cb: np.ndarray, table: int, code: np.ndarray) -> np.ndarray:
    """Whether a bucket is the first, by table and code, in which each pair meets. Codes: pairs, tables, slots."""
    ok = np.ones(len(ca), bool)
    none = np.iinfo(np.int64).max
    for t in range(table + 1):
        meets = ca[:, t, :, None] == cb[:, t, None, :]
        least = np.where(meets, ca[:, t, :, None], none).reshape(len(ca), -1).min(axis=1) if len(ca) else np.zeros(0, np.int64)
        ok &= least == none if t < table else least == code
    return ok


def bucket_pairs(code: np.ndarray, x: np.ndarray, least: float, dense: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of equal code, sorted by it, with a cosine of ``least``: small buckets by distance, large ones by matrix."""
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sizes = np.diff(np.append(starts, len(code)))
    out_i, out_j = [], []
    for a, n in zip(starts[sizes > dense], sizes[sizes > dense], strict=True):
        i, j = np.nonzero(np.triu(x[a : a + n] @ x[a : a + n].T >= least, 1))
        out_i.append(i + a)
        out_j.append(j + a)
    small = np.flatnonzero(np.repeat(sizes <= dense, sizes))
    for k in range(1, int(sizes[sizes <= dense].max(initial=1))):
        i = small[small + k < len(code)]
        i = i[code[i] == code[i + k]]
        hit = np.einsum("ij,ij->i", x[i], x[i + k]) >= least
        out_i.append(i[hit])
        out_j.append(i[hit] + k)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over links (i, j)."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, hashes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) a row: links are pairs with a cosine of at least ``least``.

    Equal vectors form a class and are compared once. Classes are dealt to the buckets of their own
    code and their probes in every table; a tuple has as many hashes as keep buckets small, the
    logarithm of the number of classes, unless ``hashes`` says how many, and there are as many tables
    (``tables`` at least) as keep the predicted recall at ``least`` at RECALL whatever the tuple's and
    the vectors' length. Buckets over ``block`` rows are cut into blocks and every pair of
    blocks is a task of its own. Cosines are exact, in double precision, by matrix products; a pair is counted by the first
    bucket it meets in, so counts add up without listing pairs, and a block hands on one edge a
    vector for the components. Vectors of different lengths are never compared. Null, empty and zero
    vectors, and those with null or non-finite numbers, have no links and are their own component;
    so have rows with a null id (component null). Repeated rows count as vectors of their own.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json("v"), 256))), "vectors")
    classes = stored(rows.filter("ok").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "vector-classes")
    total = classes.count()
    hashes = hashes or max(1, round(np.log2(max(total, 2)) / 8))

    def hashed(batches):
        for b in batches:
            lists = b.column(2)
            size = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            at = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                on = np.flatnonzero(size == d)
                x = unit_rows(flat[at[on][:, None] + np.arange(d)[None, :]])
                c = codes(x, tables_for(width_of(int(d)), hashes, probes, least, tables), hashes, probes).reshape(len(on), -1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(on)), b.column(1).take(pa.array(on)), pa.array(np.full(len(on), d, np.int32)), lists.take(pa.array(on)), pa.array(list(c), pa.list_(pa.int64()))],
                    names=["rep", "n", "d", "x", "codes"],
                )

    hashed_rows = stored(classes.select("rep", "n", "v").mapInArrow(hashed, "rep long, n long, d int, x array<double>, codes array<long>"), "vector-codes")
    placed = hashed_rows.select("rep", "n", "d", "x", "codes", F.posexplode("codes").alias("at", "code"))
    placed = placed.withColumn("t", F.floor(F.col("at") / (1 + probes)).cast("int")).drop("at")
    slim = placed.select("d", "t", "code").groupBy("d", "t", "code").agg(F.count("*").alias("size")).filter("size > 1")
    slim = slim.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    live = placed.join(slim.select("d", "t", "code", "blocks"), ["d", "t", "code"])
    live = live.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a row of a large bucket goes to every pair of blocks that holds its own; small buckets share tasks
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b1": F.least("mine", "other"), "b2": F.greatest("mine", "other")})
    parts = max(1, total // 1000)
    live = live.withColumn("part", F.when(F.col("blocks") > 1, F.col("code")).otherwise(-1 - F.pmod(F.xxhash64("code"), F.lit(parts))))

    def compare(key, pdf):
        import pandas as pd

        _, table, _, b1, b2 = (int(k) for k in key)
        pdf = pdf.sort_values("code", kind="stable")
        rep, n, code, mine = (pdf[c].to_numpy() for c in ("rep", "n", "code", "mine"))
        x = unit_rows(np.stack(pdf["x"].to_numpy()))
        c = np.stack(pdf["codes"].to_numpy()).reshape(len(pdf), -1, 1 + probes)
        if b1 == b2:
            i, j = bucket_pairs(code, x, least)
        else:
            left, right = np.flatnonzero(mine == b1), np.flatnonzero(mine == b2)
            i, j = np.nonzero(x[left] @ x[right].T >= least)
            i, j = left[i], right[j]
        links, keep_i, keep_j = np.zeros(len(rep), np.int64), [], []
        step = max(1, 3_200_000 // (c.shape[1] * c.shape[2]))
        for a in range(0, len(i), step):
            p, q = i[a : a + step], j[a : a + step]
            own = owned(c[p], c[q], table, code[p])
            p, q = p[own], q[own]
            links += np.bincount(p, n[q], len(rep)).astype(np.int64) + np.bincount(q, n[p], len(rep)).astype(np.int64)
            keep_i.append(p)
            keep_j.append(q)
        low = roots(len(rep), np.concatenate([*keep_i, np.zeros(0, np.int64)]), np.concatenate([*keep_j, np.zeros(0, np.int64)]))
        on = links > 0
        return pd.DataFrame({"rep": rep[on], "links": links[on], "root": rep[low[on]]})

    found = stored(live.select("d", "t", "part", "b1", "b2", "code", "mine", "rep", "n", "x", "codes").groupBy("d", "t", "part", "b1", "b2").applyInPandas(compare, "rep long, links long, root long"), "vector-links")
    comps = components(found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("key", "rep", "n").join(sums, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("key").alias("key_"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, F.col("key") == F.col("key_"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

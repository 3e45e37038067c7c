"""K-d tree sharding: split at distributed weighted medians along the widest dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import fresh, gapless, stored, weighted_cuts

LEVELS, TEXT_BITS, ROW_BITS = 20, 28, 12
BITS = LEVELS + TEXT_BITS + ROW_BITS


def dimensions(text: Column) -> dict[str, Column]:
    """Metadata of a text, each scaled to [0, 1] by fixed ranges; equal texts agree in all of them."""
    octets = F.coalesce(F.octet_length(text), F.lit(0))
    lines = octets - F.coalesce(F.octet_length(F.replace(text, F.lit("\n"))), F.lit(0))
    return {
        "octets": F.log2(1 + octets) / 40,
        "lines": F.log2(1 + lines) / 40,
        "density": F.coalesce(F.try_divide(octets, F.char_length(text)) - 1, F.lit(0.0)) / 3,
    }


def kd_shards(df: DataFrame, dims: dict[str, Column], weight: str, group: Column, row: Column, shards: int | None = None, out: str = "shard", target: float | None = None) -> DataFrame:
    """Add ``out``: the leaf, 0 to ``shards`` - 1, of a k-d tree whose leaves weigh nearly the same.

    Without ``shards``, there are as many as bring leaves down to a weight of ``target``.

    A node of k leaves is cut along the dimension with the widest range in it, at the key below
    which k // 2 of k parts of its weight lie. A key is the coordinate on 2^20 levels, then a hash
    of ``group``, then a hash of ``row``: rows with equal coordinates split by group, so a group
    (equal texts) stays whole unless it weighs over 1/20 of a leaf; cuts are right to 1/1000 of a
    leaf, or to one group.
    Every level costs one range and a few histogram aggregations over all nodes at once; the driver
    gets at most 4096 sums a node, and the tree (at most ``shards`` - 1 cuts) becomes one expression.
    Null dimensions count as 0. Rows that agree in group, row and all dimensions can't be told apart and
    stay together, however many. One row that outweighs a leaf is a leaf that weighs more. Columns of any
    other name are passed on. An empty table stays empty.
    """
    names = fresh(df, *[f"_q{i}" for i in range(len(dims))], "_tie", "_node", "_key")
    qs, (tie, node_col, key_col) = names[: len(dims)], names[len(dims) :]
    q = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    top = (1 << LEVELS) - 1
    ties = F.shiftleft(F.pmod(F.xxhash64(group), F.lit(1 << TEXT_BITS)), ROW_BITS) + F.pmod(F.xxhash64(row, F.lit(7)), F.lit(1 << ROW_BITS))
    base = df.withColumns({n: F.floor(q(c) * top).cast("long") for n, c in zip(qs, dims.values(), strict=True)} | {tie: ties})
    base = stored(base, "kd")
    keys = [F.shiftleft(F.col(n), TEXT_BITS + ROW_BITS) + F.col(tie) for n in qs]
    total = base.agg(F.sum(weight).cast("double")).first()[0] or 0.0
    if shards is None:
        shards = max(1, math.ceil(total / (target or total or 1) - 1e-9))
    tolerance = total / shards / 1000
    tree: dict = {"leaves": shards, "first": 0, "id": 0}

    def assign(node: dict, of) -> Column:
        if "cut" not in node:
            return of(node)
        return F.when(keys[node["dim"]] < node["cut"], assign(node["left"], of)).otherwise(assign(node["right"], of))

    front = [tree] if shards > 1 else []
    while front:
        open_ids = {n["id"] for n in front}
        at = base.withColumn(node_col, assign(tree, lambda n: F.lit(n["id"] if n["id"] in open_ids and n in front else -1)))
        spans = [f(c).alias(f"{c}_{k}") for c in qs for k, f in (("lo", F.min), ("hi", F.max))]
        rows = {r[node_col]: r for r in at.groupBy(node_col).agg(F.sum(weight).cast("double").alias("w"), *spans).collect()}
        wanted, chosen = {}, {}
        for n in front:
            r = rows.get(n["id"])
            widths = [(r[f"{c}_hi"] - r[f"{c}_lo"], -i) for i, c in enumerate(qs)] if r else [(0, 0)]
            n["dim"] = -max(widths)[1]
            chosen[n["id"]] = n["dim"]
            wanted[n["id"]] = (r["w"] if r else 0.0) * (n["leaves"] // 2) / n["leaves"]
        key = F.lit(None).cast("long")
        for d in set(chosen.values()):
            key = F.when(F.col(node_col).isin([i for i, x in chosen.items() if x == d]), keys[d]).otherwise(key)
        cuts = weighted_cuts(at.withColumn(key_col, key), node_col, key_col, weight, wanted, BITS, {i: tolerance for i in wanted}, whole=(1 << ROW_BITS, 50 * tolerance))
        later = []
        for n in front:
            half = n["leaves"] // 2
            n["cut"] = cuts[n["id"]][0]
            n["left"] = {"leaves": half, "first": n["first"], "id": 2 * n["id"] + 1}
            n["right"] = {"leaves": n["leaves"] - half, "first": n["first"] + half, "id": 2 * n["id"] + 2}
            later += [x for x in (n["left"], n["right"]) if x["leaves"] > 1]
        front = later
    return base.withColumn(out, assign(tree, lambda n: F.lit(n["first"]))).drop(*qs, tie)


def op9(spark, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes (law ``bytes``). A null text weighs 16 and has the crc32 of no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    dims = dimensions(F.col("text"))
    meta = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *[c.alias(n) for n, c in dims.items()])
    out = kd_shards(meta, {n: F.col(n) for n in dims}, "size", F.struct("text_crc32", "size"), F.col("doc_id"), 40)
    out = gapless(out, "shard", F.struct("doc_id", "text_crc32"), ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

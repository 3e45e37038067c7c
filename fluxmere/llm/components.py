"""Connected components of a link table, distributed: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import forget, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Alternates large-star (each node points its larger neighbours to its least one) and small-star
    (smaller neighbours and itself) until nothing changes; a logarithmic number of rounds in practice. Each round
    is two aggregations and joins by node with written results, so lineage stays short and nothing
    is gathered in one place. Self-links, null ends and repeated links are ignored.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "cc",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, last = None, mark(edges)
    while last[0] and last != before:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(root.select("u", F.col("m").alias("v"))).filter("u != v")
        small = stored(small.distinct(), "cc")
        forget(edges, large)
        edges = small
        before, last = last, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

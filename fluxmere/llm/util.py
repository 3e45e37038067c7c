"""Helpers that the training-data operators share: shared storage, stable splits, gapless ranks, cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fluxmere-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fluxmere/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """A mounted path for Python's own files; the shared folder has to be mounted for those."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: model and archive files need a mounted shared folder (file:// or a path)")
    return uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is read straight from files, so that row numbers come out alike each time; else written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, name) if any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "ExistingRDD")) else df


def forget(*frames: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/fluxmere/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of the driver's ``rows``, handed over by Arrow.

    ``createDataFrame`` over a list makes an RDD that Python converts: on every executor another daemon with
    workers of its own, which stay beside those that run the operators.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


#: Rows of whole texts that Spark hands to a Python worker at once, in the pipeline.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python ``BATCH`` at a time; a smaller setting stays.

    At Spark's 10,000 a batch of texts is a whole task's input, which the JVM and the worker hold at
    once, coming and going, beside all that a long-lived worker has from earlier stages.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


_HELD: dict[str, object] = {}


def held(token: str, make):
    """This worker's ``make()`` for ``token``. One thing is held at a time: the last operator's goes before the next one's comes."""
    if token not in _HELD:
        _HELD.clear()
        release()
        _HELD[token] = make()
    return _HELD[token]


class Kept(dict):
    """What ``make`` gives for a text, for the last ``limit`` to twice as many short texts asked for.

    A full generation becomes the old one, and what is asked for again comes back from it, so frequent
    texts stay and memory is bounded however many there are.
    """

    def __init__(self, make, limit: int = 80_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, text: str):
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
            if len(text) > self.longest:
                return out
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[text] = out
        return out


def release() -> None:
    """Give freed memory back to the system; a worker lives on through later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(col: str, buckets: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % buckets


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, for working columns."""
    out, taken = [], {c.lower() for c in df.columns}
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def gapless(df: DataFrame, group: str, spread: Column, order: list[str], out: str) -> DataFrame:
    """Number each group's rows 0, 1, 2, ... without putting a group into one task.

    Rows are dealt to (group, part); a part holds about 1/4000 of all rows or 250, whichever is
    more. The table of part sizes has at most 4000 rows plus one a group, so it is small at any size.
    """
    g, parts_, part, c, p, n, start = fresh(df, "_g", "_parts", "_part", "_c", "_p", "_n", "_start")
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = df.count()
    chunk = max(250, -(-total // 4000))
    parts = sizes.select(F.col(group).alias(g), F.ceil(F.col("n") / chunk).cast("long").alias(parts_))
    # groups may be many: join, don't broadcast by hand
    dealt = df.join(parts, F.col(group).eqNullSafe(F.col(g)), "left").drop(g)
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(spread), F.col(parts_)))
    counts = dealt.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.count("*").alias(c))
    w = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(g, p, F.coalesce(F.sum(c).over(w), F.lit(0)).alias(start))
    dealt = dealt.withColumn(n, F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1)
    joined = dealt.join(starts, F.col(group).eqNullSafe(F.col(g)) & (F.col(part) == F.col(p)), "left")
    return joined.withColumn(out, (F.col(start) + F.col(n)).cast("long")).drop(g, p, c, start, n, part, parts_)


def weighted_cuts(df: DataFrame, group: str, key: str, weight: str, wanted: dict, bits: int, stop: dict, near: bool = True, whole: tuple = (1, 0.0)) -> dict:
    """For each group, the least key at which the running weight, in key order, reaches ``wanted``.

    ``key`` is a long in [0, 2^bits). Returns {group: (cut, weight of keys below cut)}: keys below
    the cut weigh at most ``wanted``. Found by refining histograms of 2^12 bins, one aggregation a
    round over all groups at once, until the bin that holds the cut weighs at most ``stop[group]`` or
    is one key wide, or has at most ``whole`` keys and weight; the cut is that bin's near end, or its
    start if not ``near``. The driver gets at most 4096 rows a group.
    """
    span = {g: (0, 1 << bits, 0.0) for g in wanted}  # low, width, weight below low
    live, done = dict(span), {}
    while live:
        shift = {g: max(0, width.bit_length() - 1 - 12) for g, (_, width, _) in live.items()}
        table = [(g, x[0], x[0] + x[1], 1 << shift[g]) for g, x in live.items()]
        low, high, wide = fresh(df, "_low", "_high", "_wide")
        if len(table) <= 64:
            of = lambda i: F.try_element_at(F.create_map(*[y for t in table for y in (F.lit(t[0]), F.lit(t[i]))]), F.col(group))  # noqa: E731,B023
            at = df.withColumns({low: of(1), high: of(2), wide: of(3)})
        else:  # a row a group, as the driver holds them
            g, = fresh(df, "_group")
            small = listed(df.sparkSession, table, f"`{g}` {df.schema[group].dataType.simpleString()}, `{low}` long, `{high}` long, `{wide}` long")
            at = df.join(F.broadcast(small), F.col(group) == F.col(g))
        rows = (
            at.filter(F.col(low).isNotNull() & (F.col(key) >= F.col(low)) & (F.col(key) < F.col(high)))
            .groupBy(F.col(group).alias("g"), F.call_function("div", F.col(key) - F.col(low), F.col(wide)).alias("b"))
            .agg(F.sum(weight).cast("double").alias("w"))
            .collect()
        )
        bins: dict = {}
        for r in rows:
            bins.setdefault(r["g"], []).append((r["b"], r["w"]))
        later = {}
        for g, (lo, width, below) in live.items():
            held = sorted(bins.get(g, []))
            for b, w in held:
                if below + w > wanted[g]:
                    start, size = lo + (b << shift[g]), 1 << shift[g]
                    if w <= stop[g] or size == 1 or (size <= whole[0] and w <= whole[1]):
                        over = near and wanted[g] - below > w / 2
                        done[g] = (start + size, below + w) if over else (start, below)
                    else:
                        later[g] = (start, size, below)
                    break
                below += w
            else:
                done[g] = (lo + width, below)
        live = later
    return done

"""Rows in order, over bounded input: folds over a key's rows, and one long sequence cut into parts.

What a key of a fold holds on to is all that is in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many rows of a sequence are one part, up to so many parts; cuts come from so many keys a part.
PART_ROWS, PARTS, KEYS = 1 << 20, 256, 64
PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def cuts(df: DataFrame, order: list[str]) -> list[Column]:
    """Keys that cut the sequence of all rows into parts of about PART_ROWS rows, ascending; none for a shorter one.

    Runs a count and, for a long sequence, a job for the keys with the least hashes. As with Spark's own range
    partitions, those keys decide how even the parts are and nothing else: each row is in one part.
    """
    kinds = [df.schema[o].dataType for o in order]
    if not all(isinstance(k, PLAIN) for k in kinds):
        return []
    parts = min(PARTS, -(-df.count() // PART_ROWS))
    if parts < 2:
        return []
    cols = [F.col(f"`{o}`") for o in order]
    # instants travel as numbers, as Python's local times repeat an hour a year
    instant = [isinstance(k, T.TimestampType) for k in kinds]
    held = df.select(*cols).orderBy(F.xxhash64(*cols)).limit(KEYS * parts).orderBy(*cols)
    held = held.select(*[F.unix_micros(c) if i else c for c, i in zip(cols, instant, strict=True)]).collect()
    literal = lambda v, k, i: F.timestamp_micros(F.lit(v).cast("bigint")) if i else F.lit(v).cast(k)
    return [F.struct(*[literal(*x).alias(o) for o, *x in zip(order, held[len(held) * p // parts], kinds, instant, strict=True)]) for p in range(1, parts)]


def in_parts(df: DataFrame, part: str, at: list[Column], order: list[str], inputs: list[str], reach: dict[str | None, int], copy: str) -> DataFrame:
    """The rows dealt by ``part``, with copies of earlier parts' rows before those of a part, told by the column ``copy``.

    ``reach``: how many rows with a value in an input (None: rows of any kind) are looked back to. So many, the last
    ones, of each earlier part are copied, ``order`` and ``inputs`` only; a window by part that looks back no
    farther gives what one over the whole sequence does.
    """
    cols, last = [F.col(f"`{o}`") for o in order], len(at)
    key, first = F.struct(*[c.alias(o) for c, o in zip(cols, order, strict=True)]), cols[0]

    # whole keys are compared: column by column, the tree is a method too long for the JIT
    def place(a: int, b: int) -> Column:
        m = (a + b) // 2
        return F.lit(a) if a == b else F.when(key >= at[m], place(m + 1, b)).otherwise(place(a, m))

    df = df.withColumn(part, place(0, last))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in [*order, *inputs]])
    tests = [F.lit(True) if i is None else F.col(i).isNotNull() for i in reach]
    early = df.filter(F.col(part) < last)
    if max(reach.values()) == 1:
        # the last values of the first column by hashing, then the few rows that have them; a row may come twice
        ends = early.groupBy(part).agg(*[F.max(F.when(t, first)).alias(f"{copy}{i}") for i, t in enumerate(tests)])
        hits = [t & first.eqNullSafe(F.col(f"{copy}{i}")) for i, t in enumerate(tests)]
        early = early.join(F.broadcast(ends), part).filter(reduce(Column.__or__, hits))
        tails = early.groupBy(part).agg(F.array(*[F.max_by(row, F.when(h, key)) for h in hits]).alias(copy))
        tails = tails.select(part, F.explode(copy).alias(copy)).filter(F.col(copy).isNotNull())
    else:
        back = Window.partitionBy(part).orderBy(*[c.desc() for c in cols]).rowsBetween(Window.unboundedPreceding, 0)
        near = [t & (F.count(F.when(t, 1)).over(back) <= k) for t, k in zip(tests, reach.values(), strict=True)]
        tails = early.repartitionById(last + 1, F.col(part)).withColumn(copy, reduce(Column.__or__, near))
        tails = tails.filter(copy).select(part, row.alias(copy))
    later = F.explode(F.sequence(F.col(part) + 1, F.lit(last))).alias(part)
    tails = tails.select(later, f"{copy}.*").withColumn(copy, F.lit(True))
    return df.withColumn(copy, F.lit(False)).unionByName(tails, allowMissingColumns=True).repartitionById(last + 1, F.col(part))


def by_key(df: DataFrame, keys: list[Column], order: list[str], schema, step) -> DataFrame:
    """``step(rows, held, last)`` gives (rows out or None, held) for one batch after another of a key's rows.

    One shuffle by key and a sort; a key's rows stream through its task, ``last`` with the last of them.
    Without keys, all rows are one key: their order is one sequence, so it is one task.
    """
    name = "_kid"
    while name in df.columns:
        name = "_" + name
    df = df.withColumn(name, F.to_json(F.struct(*keys)) if keys else F.lit(""))

    def run(batches):
        key, held, rows = None, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf.pop(name)
            starts = [0, *(ids.ne(ids.shift()).to_numpy().nonzero()[0][1:]), len(ids)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                # one batch behind, so that the last one of a key is known
                if rows is not None:
                    out, held = step(rows, held, ids.iat[a] != key)
                    if out is not None and len(out):
                        yield out
                held = held if ids.iat[a] == key else None
                key, rows = ids.iat[a], pdf.iloc[a:b].reset_index(drop=True)
        if rows is not None:
            out, _ = step(rows, held, True)
            if out is not None and len(out):
                yield out

    return df.repartition(name).sortWithinPartitions(name, *order).mapInPandas(run, schema)

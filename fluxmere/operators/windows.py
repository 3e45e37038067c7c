"""Event-time windows over bounded input."""

from __future__ import annotations

import bisect
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import SqlError
from ..plans.parser import Node, Window, seconds
from .ordered import by_key


def span(text: str) -> str:
    s = seconds(text)
    return f"{int(s * 1000)} milliseconds" if s != int(s) else f"{int(s)} seconds"


def time_column(df: DataFrame, name: str, unit: str | None) -> DataFrame:
    """``name`` as a timestamp in UTC; a number needs a unit, and rows without a time go."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        t = c.cast("timestamp")
    elif isinstance(kind, T.NumericType):
        scale = {"dd": 86_400_000_000, "hh": 3_600_000_000, "mi": 60_000_000, "ss": 1_000_000, "ms": 1000, "ns": 0}.get((unit or "").lower())
        if scale is None:
            raise SqlError("semantic", f"{name} is a number: TIMEUNIT is needed")
        t = F.timestamp_micros((c * scale if scale else c / 1000).cast("bigint"))
    else:
        t = c.try_cast("timestamp")
    return df.withColumn("_time", t).filter(F.col("_time").isNotNull())


def idle(df: DataFrame, after: float) -> DataFrame:
    """Add a beat a second whose time is ``after`` seconds ago, so that the watermark goes on when a source falls silent."""
    beats = df.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    beats = beats.select(F.timestamp_micros(F.unix_micros("timestamp") - int(after * 1_000_000)).alias("_time"), F.lit(True).alias("_beat"))
    return df.withColumn("_beat", F.lit(False)).unionByName(beats, allowMissingColumns=True)


def beating(df: DataFrame) -> DataFrame:
    """Rows without the beats; not before the watermark has seen them, which a random test keeps the optimiser from."""
    return df.filter(F.rand() >= F.when(F.col("_beat"), 2.0).otherwise(0.0)).drop("_beat") if "_beat" in df.columns else df


def assign(df: DataFrame, w: Window, keys: list[Column], order: list[str], streaming: bool = False) -> tuple[DataFrame, list[Column]]:
    """Rows with their window, and the Columns to group by for it."""
    if w.kind == "tumbling":
        return df, [F.window("_time", span(w.args[0])).alias("_window")]
    if w.kind == "sliding":
        size, slide = span(w.args[0]), span(w.args[1])
        out = df.withColumn("_window", F.window("_time", size, slide))
        if not streaming:
            # the first slot starts at the slide before the first row: one small aggregate, joined as one row
            step = int(seconds(w.args[1]) * 1_000_000)
            low = df.agg((F.call_function("div", F.unix_micros(F.min("_time")), F.lit(step)) * step).alias("_low"))
            out = out.crossJoin(F.broadcast(low)).filter(F.unix_micros(F.col("_window.start")) >= F.col("_low")).drop("_low")
        return out, [F.col("_window")]
    if w.kind == "session":
        return df, [F.session_window("_time", span(w.args[0])).alias("_window")]
    if w.kind == "counting":
        n = int(float(w.args[0]))
        df = df.withColumn("_keys", F.struct(*keys) if keys else F.lit(1))
        by = W.partitionBy("_keys").orderBy(*order)
        df = df.withColumn("_bucket", F.floor((F.row_number().over(by) - 1) / n))
        full = F.count(F.lit(1)).over(W.partitionBy("_keys", "_bucket")) == n
        return df.withColumn("_full", full).filter("_full"), [F.col("_bucket")]
    raise SqlError("semantic", f"{w.kind} windows are grouped otherwise")


OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
TRIGGERS = {"count", "sum", "avg", "min", "max", "median", "stddev", "first_value", "last_value"}


def trigger(n: Node, found: list[Node]):
    """A Python predicate over the values of the aggregates in ``found``."""
    if n.kind == "bin" and n.value in ("and", "or"):
        a, b = trigger(n.args[0], found), trigger(n.args[1], found)
        return (lambda v: a(v) and b(v)) if n.value == "and" else (lambda v: a(v) or b(v))
    if n.kind == "bin" and n.value in OPS:
        f, sides = OPS[n.value], []
        for a in n.args:
            if a.kind == "call":
                if a.value not in TRIGGERS:
                    raise SqlError("semantic", f"{a.value} can't trigger a window", *a.at)
                found.append(a)
                sides.append(lambda v, i=len(found) - 1: v[i])
            elif a.kind == "lit":
                sides.append(lambda v, x=a.value: x)
            else:
                raise SqlError("semantic", "a trigger compares aggregates with literals", *a.at)
        return lambda v: (x := sides[0](v)) is not None and (y := sides[1](v)) is not None and f(x, y)
    raise SqlError("semantic", "a trigger is made of comparisons, AND and OR", *n.at)


class Running:
    """One aggregate of a trigger, a row at a time. NULL is skipped, but for first_value and last_value."""

    def __init__(self, name: str):
        self.name, self.n, self.total, self.square, self.low, self.high, self.all, self.first, self.last, self.rows = name, 0, 0.0, 0.0, None, None, [], None, None, 0

    def add(self, x) -> None:
        x = None if x is not None and x != x else x
        self.first = x if not self.rows else self.first
        self.last, self.rows = x, self.rows + 1
        if x is None:
            return
        self.n += 1
        if self.name in ("sum", "avg", "stddev"):
            x = float(x)
            before = self.total / (self.n - 1) if self.n > 1 else 0.0
            self.total += x
            self.square += (x - before) * (x - self.total / self.n)
        elif self.name in ("min", "max"):
            self.low = x if self.low is None else min(self.low, x)
            self.high = x if self.high is None else max(self.high, x)
        elif self.name == "median":
            bisect.insort(self.all, float(x))

    @property
    def value(self):
        if self.name in ("first_value", "last_value"):
            return self.first if self.name == "first_value" else self.last
        if self.name == "count":
            return self.n
        if not self.n:
            return None
        half = len(self.all) // 2
        return {
            "sum": lambda: self.total,
            "avg": lambda: self.total / self.n,
            "min": lambda: self.low,
            "max": lambda: self.high,
            "median": lambda: self.all[half] if len(self.all) % 2 else (self.all[half - 1] + self.all[half]) / 2,
            "stddev": lambda: math.sqrt(max(0.0, self.square) / (self.n - 1)) if self.n > 1 else 0.0,
        }[self.name]()


def trigger_columns(df: DataFrame, w: Window, keys: list[Column], compiler):
    """(rows with _keys and the trigger's arguments, a fold of them: firings before each row, and at the end all)."""
    found: list[Node] = []
    fires = trigger(w.trigger, found)
    names = [a.value for a in found]
    df = df.withColumn("_keys", F.struct(*keys) if keys else F.lit(1))
    df = df.withColumns({f"_t{i}": F.lit(1) if not a.args or a.args[0].kind == "star" else compiler.row(a.args[0]) for i, a in enumerate(found)})

    def fold_rows(pdf, state):
        out, state, k = [], state or [Running(x) for x in names], 0
        columns = [[None if x is None or x != x else x for x in pdf[f"_t{i}"].tolist()] for i in range(len(names))]
        for row in zip(*columns, strict=True) if columns else ((),) * len(pdf):
            for s, x in zip(state, row, strict=True):
                s.add(x)
            out.append(k)
            if fires([s.value for s in state]):
                state, k = [Running(x) for x in names], k + 1
        return [*out, k], state

    return df, found, fold_rows


def count_of(w: Window, found: list[Node]) -> int | None:
    """After how many rows a plain count fires, if that is all the trigger asks."""
    t = w.trigger
    if len(found) != 1 or found[0].value != "count" or (found[0].args and found[0].args[0].kind != "star"):
        return None
    if t.kind != "bin" or t.args[0] is not found[0] or t.args[1].kind != "lit" or not isinstance(t.args[1].value, int | float):
        return None
    n = math.ceil(t.args[1].value)
    n = n + 1 if t.value == ">" and n == t.args[1].value else n
    return max(1, n) if t.value in (">=", ">") or (t.value == "=" and n == t.args[1].value and n >= 1) else None


def global_windows(df: DataFrame, w: Window, keys: list[Column], compiler, order: list[str]) -> DataFrame:
    """Number each key's firings; rows after the last firing go. A fold in order, which holds a window's rows."""
    df, found, fold_rows = trigger_columns(df, w, keys, compiler)
    n = count_of(w, found)
    if n is not None:  # a plain count fires every n rows: no fold needed
        by = W.partitionBy("_keys").orderBy(*order)
        df = df.withColumn("_bucket", F.floor((F.row_number().over(by) - 1) / n).cast("long"))
        return df.withColumn("_full", F.count(F.lit(1)).over(W.partitionBy("_keys", "_bucket")) == n).filter("_full").drop("_full")
    schema = T.StructType([*df.schema.fields, T.StructField("_bucket", T.LongType())])

    def step(pdf, held, last):
        import pandas as pd

        rest, done, running = held or (None, 0, None)
        numbers, running = fold_rows(pdf, running)
        pdf["_bucket"] = [done + k for k in numbers[:-1]]
        pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
        fired = done + numbers[-1]
        return pdf[pdf["_bucket"] < fired], (pdf[pdf["_bucket"] >= fired], fired, running)

    return by_key(df, keys, order, schema, step)

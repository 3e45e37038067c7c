"""The same query text over unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Engine, Plan
from ..plans.errors import SqlError
from ..plans.parser import Window, parse


def parts(engine: Engine, text: str) -> tuple[Plan, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(plan, what runs as a stream, what is done to each of its micro-batches).

    The stream holds all state; a micro-batch has whole windows, so their results are ordered, made
    distinct and limited one by one. An aggregate without a window has windows of 10 seconds.
    """
    q = parse(text)
    plan = Plan(engine, q, streaming=True)
    if plan.kind == "window" and q.window is None:
        q.window = Window("tumbling", ["10s"])
    for join in q.joins:
        plan.enrich(*join)
    if plan.kind != "window":
        out = plan.patterns() if plan.kind == "cep" else plan.direct()
        by = [F.col(f"`{n}`").desc() if d else F.col(f"`{n}`") for n, d in q.order]
        return plan, out, lambda batch: batch.orderBy(*by) if by else batch
    rows, groups, extra = plan.assigned()
    if plan.released:

        def finish(batch: DataFrame) -> DataFrame:
            out, marks = plan.aggregated(batch, groups, extra)
            return plan.ordered(out, marks).drop(*marks)

        return plan, rows, finish
    out, marks = plan.aggregated(rows, groups, extra)
    return plan, out, lambda batch: plan.ordered(batch, marks).drop(*marks)


def stream(engine: Engine, text: str) -> DataFrame:
    """A streaming DataFrame of a query's results: all but what needs whole windows at once, which ``start`` delivers.

    Windows take event time: the watermark trails by MAXOUTOFORDERNESS.
    """
    plan, out, _ = parts(engine, text)
    if plan.kind == "window":
        if plan.released:
            raise SqlError("streaming", "counting and trigger windows and ALLOWEDLATENESS need start(), which groups each window as a whole")
        return out.drop("_window")
    return out


def start(engine: Engine, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Run a query; ``sink`` gets each finished batch, ordered, distinct and limited as the query says, in turn.

    With ALLOWEDLATENESS, a window comes once the watermark passes its end, and again, whole and with the
    same ``window_id()``, after each micro-batch that brings rows late for it.
    """
    plan, df, finish = parts(engine, text)
    writer = df.writeStream.foreachBatch(lambda batch, number: sink(finish(batch), number)).outputMode("append").option("checkpointLocation", checkpoint)
    if not once:
        return writer.trigger(processingTime=every).start()
    # keys that time out by the clock would keep a run of all available input going for ever
    name, spark = "spark.sql.streaming.noDataMicroBatches.enabled", engine.spark
    held = spark.conf.get(name)
    try:
        if "STATETTL" in plan.q.options:
            spark.conf.set(name, "false")
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, held)

"""The life of one query over a stream: options, sinks, results one by one, statistics, stop."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from . import logs
from .api import Engine, Plan, View, default_name
from .operators.compile import calls
from .plans.errors import SqlError
from .plans.parser import parse
from .sources.schema import validate
from .streaming.run import start


@dataclass(frozen=True)
class Options:
    """What a rule runs with.

    ``results`` bounds the channel, whose oldest result goes when it is full. ``overflow`` names what
    happens to input that comes faster than it is worked on: Spark reads a source at its own pace, so
    ``block`` and ``expand`` need nothing and ``drop`` would only lose rows; all three keep every row.
    ``partitions`` is the number of shuffle partitions, ``every`` the time between micro-batches.
    ``schema`` declares the input; rows that break it are counted and dropped.
    """

    every: str = "1 second"
    results: int = 10_000
    overflow: str = "block"
    partitions: int | None = None
    schema: Any = None
    log_level: str = "warn"
    log_form: str = "text"
    log_stream: Any = None

    def __post_init__(self):
        if self.overflow not in ("block", "drop", "expand"):
            raise ValueError(f"unknown overflow strategy {self.overflow}")

    def fast(self) -> Options:
        """For throughput: fewer, larger micro-batches."""
        return replace(self, every="5 seconds", results=100_000)

    def prompt(self) -> Options:
        """For latency: micro-batches as soon as there is input."""
        return replace(self, every="0 seconds")


class Rule:
    """One query. A rule starts once; sinks can be added before and after."""

    def __init__(self, engine: Engine, text: str, options: Options | None = None):
        self.engine, self.text, self.options = engine, text, options or Options()
        self.query, self.plan = parse(text), Plan(engine, parse(text))
        self.sinks: list[Callable[[list[dict]], None]] = []
        self.channels: list[queue.Queue] = []
        self.running: StreamingQuery | None = None
        self.out_rows = self.lost = self.schema_dropped = 0
        self.batch = -1  # the last one delivered
        self.log = logs.logger(self.options.log_level, self.options.log_form, self.options.log_stream)
        if self.options.partitions:
            engine.spark.conf.set("spark.sql.shuffle.partitions", self.options.partitions)

    # what it is
    @property
    def is_aggregation(self) -> bool:
        return self.plan.kind == "window"

    @property
    def is_cep(self) -> bool:
        return self.plan.kind == "cep"

    @property
    def is_stream(self) -> bool:
        return self.engine.view(self.query.table).df.isStreaming

    @property
    def fields(self) -> list[str]:
        """Output columns in the order of the query, a star left open."""
        return [alias or default_name(e, i) for i, (e, alias) in enumerate(self.query.items) if e.kind != "star"]

    # results
    def add_sink(self, sink: Callable[[list[dict]], None]) -> Rule:
        """``sink`` gets each result as rows; sinks are called in turn, in the order of results. An error in one is logged."""
        self.sinks.append(sink)
        return self

    add_sync_sink = add_sink

    def channel(self) -> queue.Queue:
        """A queue of results; the oldest goes when it is full, and is counted."""
        out: queue.Queue = queue.Queue(self.options.results)
        self.channels.append(out)
        return out

    def print_table(self, write: Callable[[str], None] = print) -> Rule:
        return self.add_sink(lambda rows: write(table(rows, self.fields)) if rows else None)

    def deliver(self, batch: DataFrame, number: int) -> None:
        rows = [r.asDict(recursive=True) for r in batch.collect()]  # what a rule hands to callbacks
        self.out_rows, self.batch = self.out_rows + len(rows), number
        self.log.debug("result", extra={"fields": {"batch": number, "rows": len(rows)}})
        if not rows:
            return
        for sink in list(self.sinks):
            try:
                sink(rows)
            except Exception:
                self.log.exception("a sink failed")
        for c in self.channels:
            while True:
                try:
                    c.put_nowait(rows)
                    break
                except queue.Full:
                    self.lost += len(c.get_nowait())

    # life
    def start(self, checkpoint: str, once: bool = False) -> Rule:
        if self.running is not None:
            raise SqlError("streaming", "this rule has been started")
        if self.options.schema is not None:
            self.checked()
        self.running = start(self.engine, self.text, self.deliver, checkpoint, once, self.options.every)
        return self

    def checked(self) -> None:
        """Replace the rule's input by its rows that fit the schema."""
        view = self.engine.view(self.query.table)
        good, bad = validate(view.df, self.options.schema)
        if not view.df.isStreaming:
            self.schema_dropped = bad.count()
        self.engine.views[self.query.table.lower()] = View(good, view.order)

    def execute(self) -> DataFrame:
        """The result over bounded input."""
        return self.engine.sql(self.text)

    def emit_sync(self, row: dict | None) -> list[dict]:
        """The result rows of one input row: none if it is filtered. Only for queries whose rows don't depend on each other."""
        if self.plan.kind != "direct" or any(any(calls(e, "analytic")) for e in (*[x for x, _ in self.query.items], self.query.where) if e is not None):
            raise SqlError("streaming", "one row at a time needs a query without windows, patterns and stateful functions")
        if row is None:
            raise SqlError("streaming", "no row")
        view = self.engine.view(self.query.table)
        spark = self.engine.spark
        values = [row.get(f.name) for f in view.df.schema.fields]
        one = spark.createDataFrame([Row(*values)], T.StructType([T.StructField(f.name, f.dataType) for f in view.df.schema.fields]))
        alone = Engine(spark)
        alone.views = {**self.engine.views, self.query.table.lower(): View(one, view.order)}
        return [r.asDict(recursive=True) for r in alone.sql(self.text).collect()]

    def trigger_window(self) -> None:
        """Work on all input there is; windows that it closes are delivered."""
        if self.running is not None:
            self.running.processAllAvailable()

    def stop(self, flush: bool = True) -> None:
        """Stop, after all input there is unless ``flush`` is off. State stays in the checkpoint: a later start goes on from it."""
        if self.running is None:
            return
        if flush and self.running.isActive:
            self.running.processAllAvailable()
        self.running.stop()

    # statistics
    def progress(self) -> list:
        """Spark's reports of micro-batches; the last one is waited for a moment, as it comes a little after its batch."""
        if self.running is None:
            return []
        end = time.monotonic() + 3
        while time.monotonic() < end and not any(p["batchId"] >= self.batch for p in self.running.recentProgress):
            time.sleep(0.05)
        return list(self.running.recentProgress)

    def stats(self) -> dict[str, int]:
        """Counts so far. Input counts what the source had to read: rows that a pushed-down filter rules out may not be."""
        done = self.progress()
        state = [s for p in done[-1:] for s in p["stateOperators"]]
        return {
            "input_count": sum(p["numInputRows"] for p in done),
            "output_count": self.out_rows,
            "dropped_count": sum(s["numRowsDroppedByWatermark"] for p in done for s in p["stateOperators"]) + self.schema_dropped,
            "output_dropped_count": self.lost,
            "state_rows": sum(s["numRowsTotal"] for s in state),
            "result_chan_len": sum(c.qsize() for c in self.channels),
            "result_chan_cap": self.options.results * len(self.channels),
        }

    def detailed_stats(self) -> dict:
        basic, done = self.stats(), self.progress()
        share = lambda a, b: 100.0 * a / b if b else 0.0
        usage, dropped = share(basic["result_chan_len"], basic["result_chan_cap"]), share(basic["dropped_count"], basic["input_count"])
        level = "critical" if dropped > 50 else "warning" if dropped > 20 else "high_load" if usage > 90 else "moderate_load" if usage > 70 else "optimal"
        rate = done[-1].get("processedRowsPerSecond", 0.0) if done else 0.0
        return {"basic_stats": basic, "result_chan_usage": usage, "drop_rate": dropped, "process_rate": rate, "performance_level": level}


def table(rows: list[dict], order: list[str]) -> str:
    """Rows as a text table: columns of ``order`` first, others behind; widths by the longest value, 4 at least."""
    there = list(dict.fromkeys(c for r in rows for c in r))
    columns = [c for c in order if c in there] + ([c for c in there if c not in order] if order else sorted(there))
    cells = [[str(r.get(c, "")) for c in columns] for r in rows]
    widths = [max(4, len(c), *(len(r[i]) for r in cells)) for i, c in enumerate(columns)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda values: "|" + "|".join(f" {v:<{w}} " for v, w in zip(values, widths, strict=True)) + "|"
    return "\n".join([line, show(columns), line, *map(show, cells), line, f"({len(rows)} rows)"])

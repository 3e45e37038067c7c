"""A source that a program pushes rows into: files in a folder that a stream reads."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class PushSource:
    """``emit`` hands rows on as one file, whole or not at all; a stream takes files in the order they were emitted.

    Rows are dicts; missing fields are NULL. Files stay until ``folder`` is cleared, so a stream that starts
    later, or again from its checkpoint, loses nothing. Many producers can share a folder.
    """

    def __init__(self, spark: SparkSession, schema, folder: str, per_trigger: int | None = None):
        self.spark, self.schema, self.folder, self.per_trigger = spark, schema, folder, per_trigger
        self.numbers, self.clock = itertools.count(), 0.0
        os.makedirs(folder, exist_ok=True)

    @property
    def df(self) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if self.per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.per_trigger)
        return reader.json(self.folder)

    def emit(self, *rows: dict) -> None:
        if not rows:
            return
        name = f"{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{next(self.numbers):06d}-{uuid.uuid4().hex[:8]}.json"
        hidden = os.path.join(self.folder, f"_{name}")
        with open(hidden, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(json.dumps(row, default=lambda x: x.isoformat(" ", "microseconds") if isinstance(x, dt.datetime) else str(x)) + "\n")
        # a stream takes files by their time, in milliseconds
        self.clock = max(time.time(), self.clock + 0.002)
        os.utime(hidden, (self.clock, self.clock))
        os.replace(hidden, os.path.join(self.folder, name))

"""Stateful functions without PARTITION BY over a sequence that is cut into parts: the same results, and no task with all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from fluxmere.api import Engine
from fluxmere.operators import ordered

CALLS = [
    "changed_cols('p_', true, v, k)", "changed_cols('p_', false, *)", "changed_cols('p_', true, *)", "changed_col(true, l) AS c", "changed_col(false, v) AS c",
    "had_changed(true, v, k) AS c", "had_changed(true, *) AS c", "had_changed(false, v) AS c", "latest(k, 'none') AS c",
    "lag(v) AS c", "lag(v, 3) AS c", "lag(v, 2, -1, false) AS c", "lag(v, 1, null, false) AS c, lag(k, 2) AS d, latest(v) AS e, acc_count(v) AS g, lag(v) OVER (PARTITION BY k) AS h",
]


@pytest.fixture(scope="module")
def engine(spark):
    """Ties and NULLs in the first column of the order, a value that stays away over many parts, rows in no order."""
    r, start, rows = random.Random(5), dt.datetime(2024, 10, 27), []
    for i in range(150):
        ts = None if r.random() < 0.05 else start + dt.timedelta(seconds=300 * r.randrange(40))
        v = None if r.random() < 0.2 or 5 < (ts.minute if ts else 0) < 40 else float(r.randrange(3))
        rows.append((i, ts, v, r.choice([None, None, None, "a", "b"]), r.choice([None, [0], [1]])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, v double, k string, l array<int>").repartition(3).localCheckpoint()
    return Engine(spark).register("s", df, ["ts", "event_id"])


@pytest.mark.parametrize("call", CALLS)
def test_a_sequence_in_parts_gives_what_the_whole_one_gives(engine, monkeypatch, call):
    text = f"SELECT event_id, {call} FROM s WHERE event_id > 3"
    monkeypatch.setattr(ordered, "PART_ROWS", 1000, raising=False)
    whole = sorted(map(repr, engine.sql(text).collect()))
    monkeypatch.setattr(ordered, "PART_ROWS", 20, raising=False)
    cut = engine.sql(text)
    assert sorted(map(repr, cut.collect())) == whole
    if "acc_" not in call:
        sizes = cut.rdd.glom().map(len).collect()
        assert sum(sizes) == len(whole) and max(sizes) < 60


def test_rows_that_may_differ_when_read_again_are_not_cut(engine, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 20, raising=False)
    got = engine.sql("SELECT event_id, lag(rand()) AS c FROM s")
    assert max(got.rdd.glom().map(len).collect()) == 150


def test_changes_are_counted_once_over_the_cuts(engine, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 20, raising=False)
    rows = engine.view("s").df.orderBy("ts", "event_id").filter("k IS NOT NULL").collect()
    plain = [b["k"] for a, b in zip([None, *rows], rows) if a is None or a["k"] != b["k"]]
    got = engine.sql("SELECT changed_col(true, k) AS c FROM s").collect()
    assert sorted(r["c"] for r in got) == sorted(plain)

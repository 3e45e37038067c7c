"""Streams against batches: the same query over the same rows, file by file, with state kept between micro-batches."""

from __future__ import annotations

import datetime as dt
import io
import json
import random

import pytest

from fluxmere import logs
from fluxmere.api import Engine
from fluxmere.functions import registry
from fluxmere.plans.errors import SqlError
from fluxmere.rule import Options, Rule, table
from fluxmere.sources.push import PushSource
from fluxmere.sources.schema import Field
from fluxmere.streaming.run import start, stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, k string, v double"


def rows(df):
    return [tuple(r) for r in df.collect()]


def events(n=60, seed=1):
    r = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=i), r.choice("ab"), None if r.random() < 0.1 else float(r.randint(0, 9))) for i in range(n)]


class Feed:
    """Files that arrive one after another, a micro-batch each."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()
        live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        self.engine = Engine(spark).register("s", live, ["ts", "event_id"])

    def put(self, part):
        self.spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"x{self.n}"))
        for f in (self.folder / f"x{self.n}").glob("part-*.parquet"):
            f.rename(self.folder / "in" / f"{self.n:03d}.parquet")
        self.n += 1

    def run(self, text):
        """Results of each micro-batch so far, by a query that goes on from its checkpoint."""
        got = []
        q = start(self.engine, text, lambda df, i: got.append(rows(df)), str(self.folder / "cp"), once=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return [g for g in got if g]


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


STATEFUL = [
    "SELECT event_id, lag(v) OVER (PARTITION BY k) AS x, lag(v, 2, -1, false) OVER (PARTITION BY k) AS y, latest(v, 0) OVER (PARTITION BY k) AS z FROM s",
    "SELECT event_id, acc_sum(v) OVER (PARTITION BY k) AS a, acc_count(v) OVER (PARTITION BY k) AS b, acc_max(v, v > 2, v = 9) OVER (PARTITION BY k) AS c, acc_avg(v) OVER (PARTITION BY k WHEN v > 3) AS d FROM s",
    "SELECT event_id, changed_col(true, v) OVER (PARTITION BY k) AS a, had_changed(true, v) OVER (PARTITION BY k) AS b, had_changed(false, v, k) OVER (PARTITION BY k) AS c FROM s",
    "SELECT event_id, lag(v) AS x FROM s WHERE lag(v) > 3",
    "SELECT k, count(*) AS n, sum(v) AS t, min(event_id) AS i FROM s GROUP BY k, CountingWindow(7)",
    "SELECT k, count(*) AS n, sum(v) AS t FROM s GROUP BY k, GLOBAL WINDOW TRIGGER WHEN sum(v) > 20 AND count(*) >= 3",
    "SELECT k, count(*) AS n FROM s GROUP BY k, GLOBAL WINDOW TRIGGER WHEN count(*) >= 1.5",
    "SELECT k, mn, f, l FROM s MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES MATCH_NUMBER() AS mn, A.k AS k, FIRST(event_id) AS f, LAST(event_id) AS l PATTERN (A B+ C) DEFINE A AS v > 6, B AS v <= PREV(v) + 3, C AS v < 3)",
]


@pytest.mark.parametrize("text", STATEFUL)
def test_state_carries_over_micro_batches(spark, feed, text):
    data = events()
    for a in range(0, 60, 13):
        feed.put(data[a : a + 13])
    got = feed.run(text)
    feed.put([(90, T0 + dt.timedelta(seconds=90), "a", 8.0), (91, T0 + dt.timedelta(seconds=91), "b", 1.0)])
    got += feed.run(text)  # a later start goes on from the checkpoint
    data += [(90, T0 + dt.timedelta(seconds=90), "a", 8.0), (91, T0 + dt.timedelta(seconds=91), "b", 1.0)]
    want = rows(Engine(spark).register("s", spark.createDataFrame(data, SCHEMA), ["ts", "event_id"]).sql(text))
    got = [r for g in got for r in g]
    if "MATCH_RECOGNIZE" in text:  # matches that rows to come could change are still open
        assert set(got) <= set(want) and len(want) - len(got) <= 2 and len(got) > 2
    else:
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 3


def test_clauses_hold_in_each_window(feed):
    feed.put([(i, T0 + dt.timedelta(seconds=s), k, 1.0) for i, (s, k) in enumerate([(0, "a"), (1, "a"), (2, "b"), (11, "c"), (12, "b"), (13, "b"), (21, "a"), (60, "z")])])
    got = feed.run("SELECT k, count(*) AS n, window_id() AS w FROM s GROUP BY k, TumblingWindow('10s') WITH (TIMESTAMP='ts') ORDER BY n DESC LIMIT 1")
    assert [(k, n) for g in got for k, n, _ in g] == [("a", 2), ("b", 2), ("a", 1)]
    assert len({w for g in got for *_, w in g}) == 3


def test_distinct_and_limit_count_over_the_stream(spark, tmp_path):
    for k, text in enumerate(["SELECT DISTINCT k FROM s", "SELECT event_id FROM s LIMIT 3"]):
        (tmp_path / str(k)).mkdir()
        feed = Feed(spark, tmp_path / str(k))
        for i in range(3):
            feed.put([(2 * i, T0, "a", 1.0), (2 * i + 1, T0, "b", 1.0)])
        assert len([r for g in feed.run(text) for r in g]) == (2 if not k else 3)


@pytest.mark.parametrize(("window", "want"), [("TumblingWindow('10s')", [2, 1, 3]), ("SlidingWindow('10s', '10s')", [2, 1, 3]), ("SessionWindow('5s')", [2, 1, 3])])
def test_late_rows_bring_the_whole_window_again(feed, window, want):
    text = f"SELECT count(*) AS n, window_id() AS w FROM s GROUP BY {window} WITH (TIMESTAMP='ts', ALLOWEDLATENESS='60s')"
    at = lambda s, i: (i, T0 + dt.timedelta(seconds=s), "a", 1.0)
    feed.put([at(1, 0), at(2, 1)])
    feed.put([at(25, 2)])  # passes the end of the first window
    feed.put([at(45, 3)])
    feed.put([at(4, 4)])  # late for the first window
    feed.put([at(46, 5)])
    got = [r for g in feed.run(text) for r in g]
    assert sorted(n for n, _ in got) == sorted(want)
    if "Session" not in window:
        assert len({w for n, w in got if n > 1}) == 1  # the same window
    feed.put([at(200, 6)])
    feed.put([at(3, 7)])  # beyond the allowed lateness
    assert all(n < 4 for g in feed.run(text) for n, _ in g)


def test_without_lateness_late_rows_are_dropped(feed):
    text = "SELECT count(*) AS n FROM s GROUP BY TumblingWindow('10s') WITH (TIMESTAMP='ts')"
    for i, s in enumerate([1, 25, 45, 2, 90]):
        feed.put([(i, T0 + dt.timedelta(seconds=s), "a", 1.0)])
    assert [n for g in feed.run(text) for (n,) in g] == [1, 1, 1]


def test_far_future_rows_move_no_watermark(feed):
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    feed.put([(0, now, "a", 1.0), (1, now + dt.timedelta(days=9), "a", 1.0)])
    feed.put([(2, now, "a", 1.0)])
    feed.put([(3, now + dt.timedelta(seconds=60), "a", 1.0)])
    got = [n for g in feed.run("SELECT count(*) AS n FROM s GROUP BY TumblingWindow('10s') WITH (TIMESTAMP='ts')") for (n,) in g]
    assert got == [2]


def test_idle_source_closes_windows(spark, feed):
    feed.put([(0, dt.datetime.now(dt.UTC).replace(tzinfo=None), "a", 1.0)])
    got = []
    q = start(feed.engine, "SELECT count(*) AS n FROM s GROUP BY TumblingWindow('1s') WITH (TIMESTAMP='ts', IDLETIMEOUT='2s')", lambda df, i: got.extend(rows(df)), str(feed.folder / "cp"))
    for _ in range(60):
        if got or not q.isActive:
            break
        q.awaitTermination(1)
    q.stop()
    assert got == [(1,)]


def test_idle_keys_are_forgotten(spark, feed):
    text = "SELECT k, count(*) AS n FROM s GROUP BY k, CountingWindow(3) WITH (STATETTL='1s')"
    feed.put([(0, T0, "a", 1.0), (1, T0, "a", 1.0)])
    assert feed.run(text) == []
    import time

    time.sleep(2)
    feed.put([(2, T0, "b", 1.0)])
    feed.run(text)  # a's two rows time out
    feed.put([(3, T0, "a", 1.0), (4, T0, "b", 1.0), (5, T0, "b", 1.0)])
    assert [r for g in feed.run(text) for r in g] in ([("b", 3)], [])  # b may time out too, a may not be whole


def test_what_streams_refuse(feed):
    for text in ("SELECT lag(v) OVER (PARTITION BY k) AS a, lag(v) AS b FROM s", "SELECT k, lag(sum(v)) AS x FROM s GROUP BY k, TumblingWindow('1s') WITH (TIMESTAMP='ts')"):
        with pytest.raises(SqlError):
            start(feed.engine, text, print, str(feed.folder / "cp"), once=True)
    with pytest.raises(SqlError, match="start"):
        stream(feed.engine, "SELECT count(*) AS n FROM s GROUP BY CountingWindow(3)")


def test_rule(spark, feed):
    log = io.StringIO()
    rule = Rule(feed.engine, "SELECT k, v FROM s WHERE v > 1", Options(results=2, log_form="json", log_level="debug", log_stream=log))
    assert rule.is_stream and not rule.is_aggregation and not rule.is_cep and rule.fields == ["k", "v"]
    seen, printed = [], []
    channel = rule.channel()
    rule.add_sink(lambda r: 1 / 0).add_sync_sink(seen.extend).print_table(printed.append)
    for i in range(4):
        feed.put([(i, T0, "a", float(i)), (10 + i, T0, "b", float(i))])
    rule.start(str(feed.folder / "cp"))
    with pytest.raises(SqlError):
        rule.start(str(feed.folder / "cp"))
    rule.trigger_window()
    rule.stop()
    assert sorted(r["v"] for r in seen) == [2.0, 2.0, 3.0, 3.0] and channel.qsize() == 2
    assert printed[0].splitlines()[1] == "| k    | v    |" and printed[0].endswith("(2 rows)")
    stats = rule.detailed_stats()
    assert stats["basic_stats"]["input_count"] in (4, 8)  # files skip rows that a pushed-down filter rules out
    assert stats["basic_stats"]["output_count"] == 4
    assert stats["performance_level"] in ("optimal", "high_load") and any("a sink failed" in json.loads(x)["msg"] for x in log.getvalue().splitlines() if x.startswith("{"))
    assert rule.emit_sync({"event_id": 1, "k": "a", "v": 5.0}) == [{"k": "a", "v": 5.0}] and rule.emit_sync({"v": 0.5}) == []
    with pytest.raises(SqlError):
        Rule(feed.engine, "SELECT count(*) AS n FROM s GROUP BY CountingWindow(2)").emit_sync({})


def test_rule_checks_its_input(spark):
    e = Engine(spark).register("t", spark.createDataFrame([("1.5", "a"), ("x", "b")], "v string, k string"), ["k"])
    rule = Rule(e, "SELECT k, v FROM t", Options(schema=[Field("v", "float"), Field("k", "string")]))
    rule.checked()
    assert rows(rule.execute()) == [("a", 1.5)] and rule.schema_dropped == 1


def test_rows_can_be_pushed(spark, tmp_path):
    source = PushSource(spark, SCHEMA, str(tmp_path / "push"), 1)
    source.emit()
    for i in range(3):
        source.emit({"event_id": i, "ts": T0 + dt.timedelta(seconds=i), "k": "a", "v": i / 2}, {"event_id": 10 + i, "ts": T0})
    rule = Rule(Engine(spark).register("s", source.df, ["event_id"]), "SELECT event_id, ts, v FROM s WHERE k = 'a'")
    out = rule.channel()
    rule.start(str(tmp_path / "cp"))
    rule.stop()
    assert [out.get_nowait() for _ in range(3)] == [[{"event_id": i, "ts": T0 + dt.timedelta(seconds=i), "v": i / 2}] for i in range(3)]


def test_tables_and_logs():
    assert table([{"b": 1, "a": "long text"}], []).splitlines()[1] == "| a         | b    |"
    out = io.StringIO()
    logs.logger("info", "logfmt", out).info("two words", extra={"fields": {"n": 3}})
    assert 'msg="two words" n=3' in out.getvalue()
    with pytest.raises(ValueError):
        Options(overflow="lose")


class Ratio:
    """A user's aggregate with a parameter: share of values above a bound."""

    def __init__(self, bound=0.0):
        self.bound, self.n, self.hit = bound, 0, 0

    def add(self, v):
        self.n += 1
        self.hit += v > self.bound

    def result(self):
        return self.hit / self.n if self.n else None


class Streak:
    """A user's stateful function: how often in a row the value rose."""

    def __init__(self):
        self.last, self.n = None, 0

    def apply(self, v):
        self.n = self.n + 1 if v is not None and self.last is not None and v > self.last else 0
        self.last = v
        return self.n


def test_own_stateful_functions(spark, feed):
    registry.register_aggregate("ratio", Ratio, "double", 1, 2, aliases=("share",))
    registry.register_analytic("streak", Streak, "bigint")
    try:
        data = [(i, T0 + dt.timedelta(seconds=i), "a" if i % 3 else "b", float(v)) for i, v in enumerate([1, 2, 3, 1, 5, 6, 7, 2, 1])]
        e = Engine(spark).register("s", spark.createDataFrame(data, SCHEMA), ["ts", "event_id"])
        assert sorted(rows(e.sql("SELECT k, ratio(v, 2) AS r, share(v) AS s FROM s GROUP BY k"))) == [("a", 0.5, 1.0), ("b", 1 / 3, 1.0)]
        text = "SELECT event_id, streak(v) OVER (PARTITION BY k) AS n FROM s"
        want = sorted(rows(e.sql(text)))
        assert [n for _, n in want] == [0, 0, 1, 0, 2, 3, 1, 0, 0]
        feed.put(data[:4])
        feed.put(data[4:])
        assert sorted(r for g in feed.run(text) for r in g) == want
        assert {"ratio", "share", "streak"} == set(registry.listed("custom")) and "lag" in registry.listed("analytic")
        with pytest.raises(SqlError):
            registry.register("other", lambda x: x, aliases=("share",))
    finally:
        assert registry.unregister("share") and registry.unregister("streak") and not registry.unregister("ratio")

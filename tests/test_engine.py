"""The dialect on small tables: parsing, errors, NULL rules, windows, stateful functions, patterns, streams."""

from __future__ import annotations

import datetime as dt

import pytest

from fluxmere.api import Engine
from fluxmere.functions import registry
from fluxmere.plans.errors import SqlError
from fluxmere.plans.parser import parse, seconds
from fluxmere.sources.schema import Field, validate
from fluxmere.streaming.run import start


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=s), k, v) for i, (s, k, v) in enumerate([(0, "a", 10.0), (1, "a", 60.0), (2, "a", 70.0), (3, "a", 80.0), (30, "a", 5.0), (0, "b", None), (40, "b", 50.0)])]
    e.register("s", spark.createDataFrame(rows, "event_id long, ts timestamp, k string, v double"))
    e.register("meta", spark.createDataFrame([("a", "old", 1), ("a", "plant", 2), (None, "none", 3)], "k string, place string, seq int"), ["seq"])
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_rules(engine):
    assert rows(engine.sql("SELECT event_id FROM s WHERE v = null")) == [(5,)]
    assert len(rows(engine.sql("SELECT event_id FROM s WHERE v != nil"))) == 6
    assert rows(engine.sql("SELECT v + 1 AS x, v / 0 AS y FROM s WHERE event_id = 5")) == [(None, None)]
    assert 5 not in [r[0] for r in rows(engine.sql("SELECT event_id FROM s WHERE v < 100"))]


def test_join_takes_the_last_row_of_a_key_and_null_meets_null(engine):
    got = rows(engine.sql("SELECT event_id, m.place AS p FROM s LEFT JOIN meta m ON k = m.k WHERE event_id IN (0, 5)"))
    assert sorted(got) == [(0, "plant"), (5, None)]
    engine.register("n", engine.view("s").df.selectExpr("event_id", "CASE WHEN event_id < 3 THEN k END AS k"), ["event_id"])
    got = rows(engine.sql("SELECT event_id, m.place AS p FROM n JOIN meta m ON k = m.k"))
    assert sorted(got) == [(0, "plant"), (1, "plant"), (2, "plant"), (3, "none"), (4, "none"), (5, "none"), (6, "none")]
    # a table in the order of its key has no last row, but always the same one
    engine.register("meta", engine.view("meta").df, ["k"])
    assert sorted(rows(engine.sql("SELECT event_id, m.place AS p FROM s JOIN meta m ON k = m.k WHERE event_id < 2"))) == [(0, "plant"), (1, "plant")]
    engine.upsert("meta", engine.spark.createDataFrame([("b", "new", 9)], "k string, place string, seq int"), ["k"])
    assert rows(engine.sql("SELECT m.place AS p FROM s JOIN meta m ON k = m.k WHERE event_id = 6")) == [("new",)]


@pytest.mark.parametrize("text, part", [
    ("SELECT FROM s", "expression"), ("SELECT v FORM s", "FROM"), ("SELECT nosuch(v) FROM s", "unknown function"), ("SELECT sum(avg(v)) FROM s GROUP BY k", "inside an aggregate"),
    ("SELECT v FROM s RIGHT JOIN meta m ON k = m.k", "RIGHT"), ("SELECT lag(v) OVER (ORDER BY ts) FROM s", "OVER"), ("SELECT v FROM s WITH (NOPE='1')", "option"),
    ("SELECT round() FROM s", "arguments"), ("SELECT count(*) AS n FROM s GROUP BY GLOBAL WINDOW", "TRIGGER"), ("SELECT 'x FROM s", "unterminated"), ("SELECT nope FROM s", "unknown column"), ("SELECT v FROM nothere", "unknown table"),
])
def test_errors_say_what_and_where(engine, text, part):
    with pytest.raises(SqlError, match=part):
        engine.sql(text)


def test_durations():
    assert (seconds("1h30m"), seconds("100ms"), seconds("5")) == (5400.0, 0.1, 5.0)
    assert parse("SELECT a FROM t -- note\n WHERE b ^ 2 ^ 1 > 3").where.args[0].value == "^"


def test_windows(engine):
    got = rows(engine.sql("SELECT k, count(*) AS n, sum(v) AS s FROM s GROUP BY k, TumblingWindow('10s') HAVING n > 1 WITH (TIMESTAMP='ts')"))
    assert got == [("a", 4, 220.0)]
    got = rows(engine.sql("SELECT k, count(*) AS n FROM s GROUP BY k, SessionWindow('5s') WITH (TIMESTAMP='ts') ORDER BY n DESC LIMIT 1"))
    assert ("a", 4) in got
    assert rows(engine.sql("SELECT k, count(*) AS n, sum(v) AS s FROM s GROUP BY k, CountingWindow(2) ")).count(("a", 2, 70.0)) == 1
    got = rows(engine.sql("SELECT k, sum(v) AS s FROM s GROUP BY k, GLOBAL WINDOW TRIGGER WHEN sum(v) > 100"))
    assert got == [("a", 140.0)]


def test_stateful_functions(engine):
    got = rows(engine.sql("SELECT event_id, lag(v) OVER (PARTITION BY k WHEN v > 50) AS p, acc_sum(v) OVER (PARTITION BY k) AS s FROM s WHERE k = 'a'"))
    assert sorted(got) == [(0, None, 10.0), (1, None, 70.0), (2, 60.0, 140.0), (3, 70.0, 220.0), (4, 70.0, 225.0)]


def test_patterns(engine):
    text = "SELECT * FROM s MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES MATCH_NUMBER() AS mn, A.v AS peak ONE ROW PER MATCH PATTERN (A{3}) DEFINE A AS v > 50)"
    assert rows(engine.sql(text)) == [(1, 80.0)]
    text = "SELECT event_id, f, l FROM s MATCH_RECOGNIZE (PARTITION BY k ORDER BY ts MEASURES FIRST(v) AS f, LAST(v) AS l ALL ROWS PER MATCH PATTERN (A+ B) DEFINE A AS v > 50, B AS v < 50)"
    assert rows(engine.sql(text)) == [(1, 60.0, 60.0), (2, 60.0, 70.0), (3, 60.0, 80.0), (4, 60.0, 5.0)]


def test_own_functions(engine):
    registry.register("twice", lambda x: x * 2)
    try:
        assert rows(engine.sql("SELECT twice(v) AS t FROM s WHERE event_id = 1")) == [(120.0,)]
        with pytest.raises(SqlError):
            registry.register("abs", lambda x: x)
    finally:
        assert registry.unregister("twice")


def test_schema(spark):
    df = spark.createDataFrame([("a", "1.5"), (None, "2"), ("b", "x")], "id string, t string")
    good, bad = validate(df, [Field("id", "string", required=True), Field("t", "float"), Field("unit", "string", default="C")])
    assert rows(good) == [("a", 1.5, "C")] and bad.count() == 2


def test_stream(spark, engine, tmp_path):
    s = engine.view("s").df
    s.write.parquet(str(tmp_path / "in"))
    live = Engine(spark).register("s", spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), ["ts", "event_id"])
    got = []
    q = start(live, "SELECT k, count(*) AS n FROM s GROUP BY k, TumblingWindow('10s') WITH (TIMESTAMP='ts', MAXOUTOFORDERNESS='1s')", lambda df, i: got.extend(rows(df)), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert ("a", 4) in got


@pytest.fixture
def odd(spark):
    row = ("10.0", 12345678.0, [1, 2, 3], 1e30, 0.1, None)
    return Engine(spark).register("o", spark.createDataFrame([row], "k string, d double, a array<int>, big double, p double, z string"), ["k"])


@pytest.mark.parametrize(("expression", "want"), [
    ("upper(k)", "10.0"), ("md5(k)", "43a1437f7f656cd8be7c996c58719e0a"), ("concat(d, 'x')", "12345678x"), ("concat(p, k)", "0.110.0"), ("concat(d / 1e12, '')", "0.000012345678"),
    ("length(a)", 3), ("length(k)", 4), ("format(d, '0.00000')", "12345678.00000"), ("cast(big, 'bigint')", None), ("cast('x', 'int')", None), ("cast(d, 'string')", "12345678"),
    ("regexp_matches(k, '[')", None), ("regexp_replace(k, '(', 'x')", None), ("date_format('2024-01-01', 'bbb')", None), ("date_format('2024-01-02', 'YYYY/DD')", "2024/02"),
    ("k contains '0.'", True), ("k startsWith '10'", True), ("k endsWith '.1'", False), ("k matches '^1.*0$'", True), ("d > 5 ? 'hi' : 'lo'", "hi"), ("z ?? 'none'", "none"),
    ("all(a, {# > 0})", True), ("any(a, {# > 3})", False), ("none(a, {# > 3})", True), ("one(a, {# > 2})", True), ("filter(a, {# >= 2})", [2, 3]), ("map(a, {# * 2})", [2.0, 4.0, 6.0]), ("find(a, {# > 1})", 2), ("count(a, {# > 1})", 2),
    ("d in [1, 12345678]", True), ("!(d == 1) && d > 1", True), ("int('7')", 7), ("string(d)", "12345678"), ("type(k)", "string"), ("fromBase64(toBase64('é'))", "é"), ("hasPrefix(k, '1')", True),
    ("sha512('a')", "1f40fc92da241694750979ee6cf582f2d5d7d28e18335de05abc54d0560e0f5302860c652bf08d560252aa5e74210546f369fbbbce8c12cfc7957b2652fe9a75"),
    ("convert_tz('2024-01-01 00:00:00', 'Asia/Tokyo')", dt.datetime(2024, 1, 1, 9)), ("to_json(a)", "[1,2,3]"), ("from_json('{\"x\": 5}')", None),
])
def test_scalar_results(odd, expression, want):
    got = rows(odd.sql(f"SELECT {expression} AS x FROM o"))[0][0]
    if expression.startswith("from_json"):
        assert got.toPython() == {"x": 5}
    else:
        assert got == want and type(got) is type(want)


def test_text_meets_patterns_as_it_is(odd):
    assert rows(odd.sql("SELECT k FROM o WHERE k LIKE '10.0'")) == [("10.0",)]
    with pytest.raises(SqlError, match="unknown type"):
        odd.sql("SELECT cast(k, 'number') AS x FROM o")
    with pytest.raises(SqlError, match="braces"):
        odd.sql("SELECT all(a, d > 1) AS x FROM o")
    now = rows(odd.sql("SELECT now() AS a, current_date() AS b, current_time() AS c, rand() AS r FROM o"))[0]
    assert str(now[0])[:10] == now[1] and len(now[2]) == 8 and 0 <= now[3] < 1


def test_windows_come_in_order(engine):
    got = rows(engine.sql("SELECT k, count(*) AS n FROM s GROUP BY k, TumblingWindow('10s') WITH (TIMESTAMP='ts') ORDER BY k DESC"))
    assert got == [("b", 1), ("a", 4), ("a", 1), ("b", 1)]
    got = rows(engine.sql("SELECT k, count(*) AS n FROM s GROUP BY k, TumblingWindow('10s') WITH (TIMESTAMP='ts') ORDER BY n DESC LIMIT 1"))
    assert got == [("a", 4), ("a", 1), ("b", 1)]


def test_triggers(engine):
    assert rows(engine.sql("SELECT count(*) AS n FROM s WHERE k = 'a' GROUP BY GLOBAL WINDOW TRIGGER WHEN count(*) >= 1.5")) == [(2,), (2,)]
    assert rows(engine.sql("SELECT count(*) AS n FROM s WHERE k = 'a' GROUP BY GLOBAL WINDOW TRIGGER WHEN count(*) = 1.5")) == []
    assert rows(engine.sql("SELECT count(*) AS n FROM s GROUP BY k, GLOBAL WINDOW TRIGGER WHEN last_value(v) > 40 AND count(*) >= 2 ORDER BY n")) == [(2,), (2,), (2,)]
    # the first row of b has no value, so first_value is NULL and never fires
    assert rows(engine.sql("SELECT count(*) AS n FROM s WHERE k = 'b' GROUP BY k, GLOBAL WINDOW TRIGGER WHEN first_value(v) > 0")) == []


def test_first_row_has_changed(engine):
    got = rows(engine.sql("SELECT event_id, had_changed(true, v) OVER (PARTITION BY k) AS c FROM s WHERE k = 'b'"))
    assert sorted(got) == [(5, True), (6, True)]
    assert rows(engine.sql("SELECT k, v FROM s WHERE v > 1000")) == [] and sorted(rows(engine.sql("SELECT k, count(v) AS n, sum(k) AS t FROM s GROUP BY k"))) == [("a", 5, None), ("b", 1, None)]


def matched(engine, values, body, measures="MATCH_NUMBER() AS mn, FIRST(event_id) AS f, LAST(event_id) AS l"):
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), *v) if isinstance(v, tuple) else (i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "x", float(v)) for i, v in enumerate(values)]
    engine.register("p", engine.spark.createDataFrame(data, "event_id long, ts timestamp, k string, v double"), ["ts", "event_id"])
    return rows(engine.sql(f"SELECT * FROM p MATCH_RECOGNIZE (ORDER BY ts MEASURES {measures} {body})"))


def test_runs_that_conditions_tell_apart_are_kept(engine):
    assert matched(engine, [1, 1, 5], "PATTERN ((A | B)+ C) DEFINE C AS COUNT(B.v) = 2 AND v > 3") == [(1, 0, 2)]
    assert matched(engine, [1, 2, 3, 9], "PATTERN ((A | B)+ C) DEFINE C AS SUM(B.v) = 4 AND v > 8") == [(1, 0, 3)]
    # many readings, few that differ: no explosion
    assert matched(engine, [1] * 40 + [5], "PATTERN ((A | B)+ C) DEFINE C AS COUNT(B.v) = 20 AND v > 3") == [(1, 0, 40)]


def test_long_matches_are_linear(engine):
    assert matched(engine, [1] * 3000 + [5], "PATTERN (A+ B) DEFINE A AS v < 2, B AS v > 3 AND COUNT(A.v) = 3000") == [(1, 0, 3000)]


def test_pattern_expressions(engine):
    got = matched(engine, [1, 2, 3.456], "PATTERN (A B C) DEFINE B AS CASE WHEN A.v = 1 THEN round(v) = 2 ELSE false END, C AS v > AVG(v)", "round(AVG(v), 2) AS r, upper(concat(C.k, 'y')) AS u, CASE WHEN C.v > 3 THEN 'hi' ELSE 'lo' END AS c, coalesce(C.v, 0) AS z")
    assert got == [(2.15, "XY", "hi", 3.456)]
    with pytest.raises(SqlError, match="can't be used in a pattern"):
        matched(engine, [1], "PATTERN (A) DEFINE A AS v > 0", "md5(A.k) AS m")


def test_skips_and_subsets(engine):
    v = [1, 5, 6, 1, 7]
    assert matched(engine, v, "AFTER MATCH SKIP TO NEXT ROW PATTERN (A B) DEFINE B AS v > A.v") == [(1, 0, 1), (2, 1, 2), (3, 3, 4)]
    assert matched(engine, v, "AFTER MATCH SKIP PAST LAST ROW PATTERN (A B) DEFINE B AS v > A.v") == [(1, 0, 1), (2, 3, 4)]
    assert matched(engine, v, "AFTER MATCH SKIP TO LAST A PATTERN (A B) DEFINE B AS v > A.v")[0] == (1, 0, 1)
    assert matched(engine, v, "PATTERN (A B) SUBSET U = (A, B) DEFINE B AS v > A.v", "AVG(U.v) AS m, NEXT(v) AS n") == [(3.0, 6.0), (4.0, None)]
    for cycle in ("SUBSET U = (A, W), W = (B, U)", "SUBSET U = (A, U)"):
        with pytest.raises(SqlError, match="itself"):
            matched(engine, v, f"PATTERN (A B) {cycle} DEFINE B AS v > 1")


def test_reluctant_takes_the_shortest(engine):
    assert matched(engine, [1, 1, 1, 5, 5], "PATTERN (A+? B) DEFINE A AS v > 0, B AS v > 0") == [(1, 0, 1), (2, 2, 3)]
    assert matched(engine, [1, 1, 1, 5, 5], "PATTERN (A+ B) DEFINE A AS v > 0, B AS v > 0") == [(1, 0, 4)]


def plain_matches(values, define, pattern):
    """(first, last) of greedy matches past the last row, by a regular expression over every labelling of the rows."""
    import itertools
    import re

    out, at = [], 0
    while at < len(values):
        best = None
        for end in range(at + 1, len(values) + 1):
            options = [[s for s, f in define.items() if f(values, i)] for i in range(at, end)]
            if any(re.fullmatch(pattern, "".join(x)) for x in itertools.product(*options)):
                best = end
        out += [(at, best - 1)] if best else []
        at = best or at + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_patterns_match_a_plain_version(engine, seed):
    import random

    r = random.Random(seed)
    values = [r.randint(0, 9) for _ in range(14)]
    define = {"A": lambda v, i: v[i] > 3, "B": lambda v, i: i > 0 and v[i] < v[i - 1], "C": lambda v, i: v[i] % 2 == 0}
    texts = {"A": "v > 3", "B": "v < PREV(v)", "C": "v % 2 = 0"}
    for pattern, expression in (("(A B+ C)", "AB+C"), ("(A{2,3} C?)", "A{2,3}C?"), ("((A | C)+ B)", "(A|C)+B"), ("(PERMUTE(A, B, C))", "ABC|ACB|BAC|BCA|CAB|CBA")):
        body = ", ".join(f"{k} AS {v}" for k, v in texts.items() if k in expression)
        assert [x[1:] for x in matched(engine, values, f"PATTERN {pattern} DEFINE {body}")] == plain_matches(values, define, expression), pattern

"""The registered queries of the SQL engine: text of the dialect beside the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .api import Engine
from .plans.parser import parse

TABLES = {
    "events": ["ts", "event_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
    "part": ["p_partkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"],
}

#: name: (text of the dialect, DuckDB SQL or None)
QUERIES: dict[str, tuple[str, str | None]] = {}


def add(name: str, text: str, oracle: str | None) -> None:
    QUERIES[name] = (text, oracle)


E1 = "FROM events"
add("filter_project", f"SELECT event_id, user_id, value {E1} WHERE value > 25", f"SELECT event_id, user_id, value {E1} WHERE value > 25")
add("transform", f"SELECT event_id, value * 1.8 + 32 AS f {E1}", f"SELECT event_id, value * 1.8 + 32 AS f {E1}")
add("arithmetic", f"SELECT event_id, value + 1 AS a, value - 2.5 AS b, value * 3 AS c, value / 4 AS d, event_id % 7 AS e, -value AS g, 2 ^ 3 ^ 2 AS h, value / 0 AS z {E1}",
    f"SELECT event_id, value + 1 AS a, value - 2.5 AS b, value * 3 AS c, value / 4 AS d, (event_id % 7)::DOUBLE AS e, -value AS g, 512.0::DOUBLE AS h, NULL::DOUBLE AS z {E1}")
add("case_searched", f"SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band {E1}", f"SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band {E1}")
add("case_simple", f"SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code {E1}", f"SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code {E1}")
add("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE 'p%_1' OR p_name NOT LIKE '%a%'", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE 'p%_1' OR p_name NOT LIKE '%a%'")
add("null_logic", f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v {E1} WHERE null_if(event_type, 'error') IS NOT NULL AND null_if(event_type, 'view') != null",
    f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v {E1} WHERE event_type NOT IN ('error', 'view')")
add("in_between", f"SELECT event_id {E1} WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 50 AND NOT (user_id IN (1, 2))", f"SELECT event_id {E1} WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 50 AND user_id NOT IN (1, 2)")
add("nested_json", f"SELECT event_id, cast(json_extract(props, '$.k'), 'bigint') AS k {E1} WHERE json_extract(props, '$.k') > 50", f"SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k {E1} WHERE (props::JSON->>'$.k')::BIGINT > 50")
add("math_fns", f"SELECT event_id, abs(value - 50) AS a, sqrt(value) AS b, ceiling(value) AS c, floor(value) AS d, round(value) AS e, sign(value - 50) AS g, mod(value, 7) AS h, round(power(value, 2), 4) AS i, round(exp(value / 100), 6) AS j, trunc(value, 1) AS k {E1}",
    f"SELECT event_id, abs(value - 50) AS a, sqrt(value) AS b, ceil(value) AS c, floor(value) AS d, round(value) AS e, sign(value - 50)::INT AS g, fmod(value, 7) AS h, round(pow(value, 2), 4) AS i, round(exp(value / 100), 6) AS j, floor(value * 10) / 10 AS k {E1}")
add("log_fns", f"SELECT event_id, round(ln(value), 8) AS a, round(log(value), 8) AS b, round(log10(value), 8) AS c, round(log2(value), 8) AS d, sqrt(0 - value) AS e, ln(0 - value) AS g {E1}",
    f"SELECT event_id, round(ln(value), 8) AS a, round(log10(value), 8) AS b, round(log10(value), 8) AS c, round(log2(value), 8) AS d, NULL::DOUBLE AS e, NULL::DOUBLE AS g {E1}")
_trig = ", ".join(f"round({f}(value / 600), 8) AS {f}_" for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh"))
add("trig_fns", f"SELECT event_id, {_trig}, round(atan2(value, 2), 8) AS at2, acos(value + 2) AS out_ {E1}", f"SELECT event_id, {_trig}, round(atan2(value, 2), 8) AS at2, NULL::DOUBLE AS out_ {E1}")
add("bit_fns", f"SELECT event_id, bitand(event_id, 12) AS a, bitor(event_id, 12) AS b, bitxor(event_id, 12) AS c, bitnot(event_id) AS d {E1}", f"SELECT event_id, event_id & 12 AS a, event_id | 12 AS b, xor(event_id, 12) AS c, ~event_id AS d {E1}")
add("string_fns", f"SELECT event_id, upper(event_type) AS a, concat(event_type, '-', user_id) AS b, length(event_type) AS c, substring(event_type, 1, 3) AS d, substring(event_type, -2) AS e, replace(event_type, 'i', '_') AS g, lpad(event_type, 10, '*') AS h, rpad(event_type, 10, '*') AS i, indexof(event_type, 'i') AS j, startswith(event_type, 'c') AS k, endswith(event_type, 'w') AS l, trim(concat('  ', event_type, ' ')) AS m, ltrim(concat('  ', event_type)) AS n, rtrim(concat(event_type, '  ')) AS o, lower(upper(event_type)) AS p, format(value, '0.00') AS q {E1}",
    f"SELECT event_id, upper(event_type) AS a, event_type || '-' || user_id AS b, strlen(event_type)::BIGINT AS c, event_type[2:4] AS d, right(event_type, 2) AS e, replace(event_type, 'i', '_') AS g, lpad(event_type, 10, '*') AS h, rpad(event_type, 10, '*') AS i, instr(event_type, 'i')::BIGINT - 1 AS j, event_type LIKE 'c%' AS k, event_type LIKE '%w' AS l, event_type AS m, event_type AS n, event_type AS o, event_type AS p, printf('%.2f', value) AS q {E1}")
add("string_concat_plus", f"SELECT event_id, event_type + '!' AS a {E1}", f"SELECT event_id, event_type || '!' AS a {E1}")
add("length_bytes", "SELECT doc_id, length(text) AS n FROM documents", "SELECT doc_id, strlen(text)::BIGINT AS n FROM documents")
add("split_fn", "SELECT p_partkey, array_length(split(p_type, ' ')) AS n FROM part", "SELECT p_partkey, len(string_split(p_type, ' '))::BIGINT AS n FROM part")
add("regexp_fns", f"SELECT event_id, regexp_matches(event_type, '^[cv]') AS a, regexp_replace(event_type, '[aeiou]', '.') AS b, regexp_substring(event_type, '[aeiou]+') AS c {E1}", f"SELECT event_id, regexp_matches(event_type, '^[cv]') AS a, regexp_replace(event_type, '[aeiou]', '.', 'g') AS b, regexp_extract(event_type, '[aeiou]+') AS c {E1}")
add("conversion_fns", f"SELECT event_id, cast(value, 'bigint') AS a, cast(user_id, 'string') AS b, hex2dec(dec2hex(event_id)) AS c, dec2hex(event_id) AS d, encode(event_type, 'base64') AS e, decode(encode(event_type, 'hex'), 'hex') AS g, chr(65 + 1) AS h, url_decode(url_encode(event_type)) AS i, encode(event_type, 'hex') AS j {E1}",
    f"SELECT event_id, trunc(value)::BIGINT AS a, user_id::VARCHAR AS b, event_id AS c, printf('%x', event_id) AS d, to_base64(event_type::BLOB) AS e, event_type AS g, 'B' AS h, event_type AS i, lower(hex(event_type)) AS j {E1}")
add("datetime_extract", f"SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dw, dayofyear(ts) AS dy, weekofyear(ts) AS w, extract('weekday', ts) AS ew {E1}",
    f"SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, dayofweek(ts)::INT AS dw, dayofyear(ts)::INT AS dy, weekofyear(ts)::INT AS w, dayofweek(ts)::INT AS ew {E1}")
add("datetime_arith", f"SELECT event_id, date_add(ts, 1, 'day') AS a, date_sub(ts, 2, 'hours') AS b, date_diff(ts, '2024-01-01 00:00:00', 'hour') AS c, date_format(ts, 'YYYY-MM-DD HH:mm:ss') AS d, unix_timestamp(ts) AS e, from_unixtime(unix_timestamp(ts)) AS g, date_parse('2024/02/03', 'YYYY/MM/DD') AS h, to_seconds(ts) AS i, date_add('2024-01-31 00:00:00', 1, 'month') AS j {E1}",
    f"SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS b, floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600)::BIGINT AS c, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, epoch(date_trunc('second', ts))::BIGINT AS e, strftime(ts, '%Y-%m-%d %H:%M:%S') AS g, '2024-02-03 00:00:00' AS h, epoch(date_trunc('second', ts))::BIGINT AS i, '2024-03-02 00:00:00' AS j {E1}")
add("json_fns", f"SELECT event_id, json_valid(props) AS a, json_type(props) AS b, json_length(props) AS c, json_valid('x{{') AS d, json_type('[1]') AS e, json_length('[1,2,3]') AS g {E1}", f"SELECT event_id, true AS a, 'object' AS b, 1::BIGINT AS c, false AS d, 'array' AS e, 3::BIGINT AS g {E1}")
add("hash_fns", f"SELECT event_id, md5(event_type) AS a, sha1(event_type) AS b, sha256(event_type) AS c {E1}", f"SELECT event_id, md5(event_type) AS a, sha1(event_type) AS b, sha256(event_type) AS c {E1}")
_arr = "split(concat(event_type, ',a,b,a'), ',')"
add("array_fns", f"SELECT event_id, array_length({_arr}) AS a, array_contains({_arr}, 'b') AS b, array_position({_arr}, 'a') AS c, array_length(array_remove({_arr}, 'a')) AS d, array_length(array_distinct({_arr})) AS e, array_length(array_intersect({_arr}, split('a,z', ','))) AS g, array_length(array_union({_arr}, split('a,z', ','))) AS h, array_length(array_except({_arr}, split('a,z', ','))) AS i {E1}",
    f"SELECT event_id, 4::BIGINT AS a, true AS b, 2::BIGINT AS c, 2::BIGINT AS d, 3::BIGINT AS e, 1::BIGINT AS g, 4::BIGINT AS h, 2::BIGINT AS i {E1}")
add("type_checks", f"SELECT event_id, is_numeric(value) AS a, is_string(event_type) AS b, is_bool(value) AS c, is_array({_arr}) AS d, is_null(value) AS e, is_not_null(value) AS g, is_object(value) AS h {E1}", f"SELECT event_id, true AS a, true AS b, false AS c, true AS d, false AS e, true AS g, false AS h {E1}")
add("conditional_fns", f"SELECT event_id, if_null(null_if(event_type, 'click'), 'none') AS a, coalesce(null_if(event_type, 'view'), 'v') AS b, greatest(value, 50) AS c, least(value, 50) AS d, greatest(value, null) AS e, case_when(value > 50, 'x', 'y') AS g {E1}",
    f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'none' ELSE event_type END AS a, CASE WHEN event_type = 'view' THEN 'v' ELSE event_type END AS b, greatest(value, 50) AS c, least(value, 50) AS d, NULL::DOUBLE AS e, CASE WHEN value > 50 THEN 'x' ELSE 'y' END AS g {E1}")
add("expr_fn", f"SELECT event_id, expr('value * 2 + 1') AS a {E1}", f"SELECT event_id, value * 2 + 1 AS a {E1}")
add("text_number_compare", f"SELECT event_id {E1} WHERE json_extract(props, '$.k') = 10 OR event_type = 5", f"SELECT event_id {E1} WHERE (props::JSON->>'$.k')::DOUBLE = 10")
add("agg_basic", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi {E1} GROUP BY event_type", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi {E1} GROUP BY event_type")
add("agg_stats", f"SELECT event_type, round(stddev(value), 6) AS a, round(stddevs(value), 6) AS b, round(var(value), 4) AS c, round(vars(value), 4) AS d {E1} GROUP BY event_type", f"SELECT event_type, round(stddev_samp(value), 6) AS a, round(stddev_samp(value), 6) AS b, round(var_pop(value), 4) AS c, round(var_samp(value), 4) AS d {E1} GROUP BY event_type")
add("agg_median", f"SELECT user_id, round(median(value), 6) AS m {E1} GROUP BY user_id", f"SELECT user_id, round(median(value), 6) AS m {E1} GROUP BY user_id")
add("agg_percentile", f"SELECT user_id, percentile(value, 0.9) AS p, percentile(value) AS q {E1} GROUP BY user_id", f"SELECT user_id, list_sort(list(value))[1 + floor(0.9 * (count(*) - 1))::INT] AS p, list_sort(list(value))[1 + floor(0.95 * (count(*) - 1))::INT] AS q {E1} GROUP BY user_id")
add("agg_collect", f"SELECT user_id, array_length(collect(value)) AS n, merge_agg(event_type) AS m {E1} GROUP BY user_id", f"SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS m {E1} GROUP BY user_id")
add("agg_first_last", f"SELECT user_id, first_value(value) AS a, last_value(event_type) AS b, nth_value(value, 3) AS c {E1} GROUP BY user_id", f"SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(event_type, (ts, event_id)) AS b, list(value ORDER BY ts, event_id)[3] AS c {E1} GROUP BY user_id")
add("agg_deduplicate", f"SELECT user_id, array_length(deduplicate(event_type)) AS n {E1} GROUP BY user_id", f"SELECT user_id, count(DISTINCT event_type) AS n {E1} GROUP BY user_id")
add("agg_expression", f"SELECT event_type, round(avg(value * 2 + 1), 6) AS a, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS b {E1} GROUP BY event_type", f"SELECT event_type, round(avg(value * 2 + 1), 6) AS a, sum(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS b {E1} GROUP BY event_type")
add("last_expression", f"SELECT user_id, upper(event_type) AS t, count(*) AS n {E1} GROUP BY user_id", f"SELECT user_id, upper(arg_max(event_type, (ts, event_id))) AS t, count(*) AS n {E1} GROUP BY user_id")
add("group_by_expr", f"SELECT upper(event_type) AS t, count(*) AS n {E1} GROUP BY upper(event_type)", f"SELECT upper(event_type) AS t, count(*) AS n {E1} GROUP BY 1")
add("having_hidden_agg", f"SELECT user_id, count(*) AS n {E1} GROUP BY user_id HAVING max(value) > 200 AND n > 10", f"SELECT user_id, count(*) AS n {E1} GROUP BY user_id HAVING max(value) > 200 AND count(*) > 10")
add("post_agg_expr", f"SELECT event_type, round(max(value) - min(value), 4) AS r, ceiling(avg(value) * 1.8 + 32) AS c {E1} GROUP BY event_type", f"SELECT event_type, round(max(value) - min(value), 4) AS r, ceil(avg(value) * 1.8 + 32) AS c {E1} GROUP BY event_type")
_ns = "epoch_ns"
add("tumbling", f"SELECT event_type, count(*) AS cnt, round(avg(value), 6) AS avg_value, window_start() AS ws, window_end() AS we {E1} WHERE value > 10 GROUP BY event_type, TumblingWindow('1h') HAVING cnt > 2 WITH (TIMESTAMP='ts')",
    f"SELECT event_type, count(*) AS cnt, round(avg(value), 6) AS avg_value, {_ns}(time_bucket(INTERVAL 1 HOUR, ts)) AS ws, {_ns}(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR) AS we {E1} WHERE value > 10 GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts) HAVING count(*) > 2")
add("sliding", f"SELECT user_id, count(*) AS n, window_start() AS ws {E1} GROUP BY user_id, SlidingWindow('2h', '1h') WITH (TIMESTAMP='ts')",
    f"WITH lo AS (SELECT time_bucket(INTERVAL 1 HOUR, min(ts)) AS t FROM events), e AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS w FROM events, (SELECT unnest([0, 1]) AS k)) SELECT user_id, count(*) AS n, {_ns}(w) AS ws FROM e, lo WHERE w >= t GROUP BY user_id, w")
add("session", f"SELECT user_id, count(*) AS n, window_start() AS ws, window_end() AS we {E1} GROUP BY user_id, SessionWindow('6h') WITH (TIMESTAMP='ts')",
    f"WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT user_id, count(*) AS n, {_ns}(min(ts)) AS ws, {_ns}(max(ts) + INTERVAL 6 HOUR) AS we FROM b GROUP BY user_id, s")
add("counting", f"SELECT user_id, round(sum(value), 4) AS s, count(*) AS n {E1} GROUP BY user_id, CountingWindow(10)",
    "WITH a AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS b FROM events) SELECT user_id, round(sum(value), 4) AS s, count(*) AS n FROM a GROUP BY user_id, b HAVING count(*) = 10")
add("global_count_trigger", f"SELECT user_id, round(sum(value), 4) AS s, count(*) AS n {E1} GROUP BY user_id, GLOBAL WINDOW TRIGGER WHEN count(*) >= 5",
    "WITH a AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS b FROM events) SELECT user_id, round(sum(value), 4) AS s, count(*) AS n FROM a GROUP BY user_id, b HAVING count(*) = 5")
add("global_sum_trigger", f"SELECT user_id, round(sum(value), 4) AS s, count(*) AS n, last_value(value) AS v {E1} GROUP BY user_id, GLOBAL WINDOW TRIGGER WHEN sum(value) > 100 OR max(value) > 90",
    "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, value, value AS s, 1 AS n, value AS m FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.value, CASE WHEN r.s > 100 OR r.m > 90 THEN o.value ELSE r.s + o.value END, CASE WHEN r.s > 100 OR r.m > 90 THEN 1 ELSE r.n + 1 END, CASE WHEN r.s > 100 OR r.m > 90 THEN o.value ELSE greatest(r.m, o.value) END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, round(s, 4) AS s, n::BIGINT AS n, value AS v FROM r WHERE s > 100 OR m > 90")
add("window_topk", f"SELECT user_id, count(*) AS n, window_start() AS ws {E1} GROUP BY user_id, TumblingWindow('24h') WITH (TIMESTAMP='ts') ORDER BY n DESC, user_id LIMIT 3",
    f"SELECT user_id, n, ws FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n DESC, user_id) AS r FROM (SELECT user_id, count(*) AS n, {_ns}(time_bucket(INTERVAL 1 DAY, ts)) AS ws FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts))) WHERE r <= 3")
add("window_distinct", f"SELECT DISTINCT count(*) AS n, window_start() AS ws {E1} GROUP BY user_id, TumblingWindow('24h') WITH (TIMESTAMP='ts')", f"SELECT DISTINCT n, ws FROM (SELECT count(*) AS n, {_ns}(time_bucket(INTERVAL 1 DAY, ts)) AS ws FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts))")
add("join_inner", "SELECT o_orderkey, c.c_name AS name, o_totalprice FROM orders JOIN customer c ON o_custkey = c.c_custkey WHERE c.c_acctbal > 0", "SELECT o_orderkey, c_name AS name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
add("join_left", "SELECT c_custkey, n.n_name AS nation FROM customer LEFT JOIN nation n ON c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("join_multi", "SELECT o_orderkey, c.c_name AS name, c.c_mktsegment AS seg, o_orderpriority FROM orders JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN region r ON o_shippriority_ = r.r_regionkey".replace("o_shippriority_", "o_custkey"),
    "SELECT o_orderkey, c_name AS name, c_mktsegment AS seg, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN region ON o_custkey = r_regionkey")
add("join_composite", "SELECT c_custkey, s.s_name AS name FROM customer LEFT JOIN supplier s ON c_nationkey = s.s_nationkey AND c_custkey = s.s_suppkey",
    "SELECT c_custkey, s_name AS name FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
add("join_aggregate", "SELECT c.c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer c ON o_custkey = c.c_custkey GROUP BY c.c_mktsegment", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("unnest", "SELECT p_partkey, unnest(split(p_type, ' ')) AS word FROM part", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
_w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
add("lag_basic", f"SELECT event_id, lag(value) OVER (PARTITION BY user_id) AS p, value - lag(value) OVER (PARTITION BY user_id) AS d {E1}", f"SELECT event_id, lag(value) {_w} AS p, value - lag(value) {_w} AS d {E1}")
add("lag_default_offset", f"SELECT event_id, lag(value, 2, -1) OVER (PARTITION BY user_id) AS p {E1}", f"SELECT event_id, coalesce(lag(value, 2) {_w}, -1) AS p {E1}")
add("lag_ignore_null", f"SELECT event_id, lag(CASE WHEN value > 50 THEN value END) OVER (PARTITION BY user_id) AS p, lag(CASE WHEN value > 50 THEN value END, 1, null, false) OVER (PARTITION BY user_id) AS q {E1}",
    f"SELECT event_id, lag(CASE WHEN value > 50 THEN value END IGNORE NULLS) {_w} AS p, lag(CASE WHEN value > 50 THEN value END) {_w} AS q {E1}")
add("latest", f"SELECT event_id, latest(CASE WHEN value > 50 THEN value END, 0) OVER (PARTITION BY user_id) AS p {E1}", f"SELECT event_id, coalesce(last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) {_w}, 0) AS p {E1}")
add("acc_running", f"SELECT event_id, round(acc_sum(value) OVER (PARTITION BY user_id), 4) AS s, acc_max(value) OVER (PARTITION BY user_id) AS hi, acc_min(value) OVER (PARTITION BY user_id) AS lo, acc_count(value) OVER (PARTITION BY user_id) AS n, round(acc_avg(value) OVER (PARTITION BY user_id), 9) AS a {E1}",
    f"SELECT event_id, round(sum(value) {_w}, 4) AS s, max(value) {_w} AS hi, min(value) {_w} AS lo, count(value) {_w} AS n, round(avg(value) {_w}, 9) AS a {E1}")
add("acc_start_reset", f"SELECT event_id, round(acc_sum(value, value > 50, value > 150) OVER (PARTITION BY user_id), 4) AS s {E1}",
    f"WITH a AS (SELECT *, sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) {_w} AS e FROM events), b AS (SELECT *, max(CASE WHEN value > 50 AND NOT value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, e ORDER BY ts, event_id) AS o FROM a) SELECT event_id, round(coalesce(sum(CASE WHEN o = 1 AND NOT value > 150 THEN value END) OVER (PARTITION BY user_id, e ORDER BY ts, event_id), 0), 4) AS s FROM b")
add("changed_col", f"SELECT event_id, changed_col(true, event_type) OVER (PARTITION BY user_id) AS c {E1}", f"SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_w} THEN event_type END AS c {E1}")
add("changed_col_only", f"SELECT changed_col(true, event_type) OVER (PARTITION BY user_id) AS c {E1}", f"SELECT c FROM (SELECT CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_w} THEN event_type END AS c {E1}) WHERE c IS NOT NULL")
add("changed_cols", f"SELECT event_id, changed_cols('c_', true, event_type, user_id) {E1}", f"SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN event_type END AS c_event_type, CASE WHEN user_id IS DISTINCT FROM lag(user_id) OVER w THEN user_id END AS c_user_id {E1} WINDOW w AS (ORDER BY ts, event_id)")
add("had_changed", f"SELECT event_id, had_changed(true, event_type) OVER (PARTITION BY user_id) AS c {E1}", f"SELECT event_id, event_type IS DISTINCT FROM lag(event_type) {_w} AS c {E1}")
add("over_when", f"SELECT event_id, lag(value) OVER (PARTITION BY user_id WHEN value > 50) AS p {E1}",
    f"WITH a AS (SELECT event_id, user_id, ts, lag(value) {_w} AS p FROM events WHERE value > 50), b AS (SELECT e.event_id, e.user_id, e.ts, a.event_id AS k FROM events e LEFT JOIN a USING (event_id)), c AS (SELECT event_id, last_value(k IGNORE NULLS) {_w} AS k FROM b) SELECT c.event_id, a.p FROM c LEFT JOIN a ON a.event_id = c.k")
add("analytic_in_where", f"SELECT event_id, value {E1} WHERE value > lag(value) OVER (PARTITION BY user_id)", f"SELECT event_id, value FROM (SELECT *, lag(value) {_w} AS p FROM events) WHERE value > p")
add("analytic_over_window", f"SELECT event_type, count(*) AS n, lag(count(*)) AS p, window_start() AS ws {E1} GROUP BY event_type, TumblingWindow('24h') WITH (TIMESTAMP='ts')",
    f"SELECT event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY ws) AS p, ws FROM (SELECT event_type, count(*) AS n, {_ns}(time_bucket(INTERVAL 1 DAY, ts)) AS ws FROM events GROUP BY event_type, time_bucket(INTERVAL 1 DAY, ts))")
_m = "FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY ts MEASURES"
add("cep_sequence", f"SELECT * {_m} A.event_id AS a, B.event_id AS b, A.value AS peak, B.value AS low ONE ROW PER MATCH AFTER MATCH SKIP TO NEXT ROW PATTERN (A B) WITHIN '30d' DEFINE A AS value > 60, B AS value < 20)",
    f"SELECT event_id AS a, b, value AS peak, low FROM (SELECT event_id, value, lead(event_id) {_w} AS b, lead(value) {_w} AS low FROM events) WHERE value > 60 AND low < 20")
add("cep_repeat", f"SELECT * {_m} LAST(event_id) AS last_id, COUNT(*) AS n PATTERN (A{{3}}) WITHIN '30d' DEFINE A AS value > 30)".replace("PATTERN", "AFTER MATCH SKIP TO NEXT ROW PATTERN"),
    f"SELECT c AS last_id, 3::BIGINT AS n FROM (SELECT value, lead(value) {_w} AS v2, lead(value, 2) {_w} AS v3, lead(event_id, 2) {_w} AS c FROM events) WHERE value > 30 AND v2 > 30 AND v3 > 30")
add("cep_alternation", f"SELECT * {_m} A.event_id AS a, CLASSIFIER() AS c AFTER MATCH SKIP TO NEXT ROW PATTERN (A (B | C)) WITHIN '30d' DEFINE A AS event_type = 'click', B AS event_type = 'view', C AS event_type = 'error')",
    f"SELECT event_id AS a, CASE n WHEN 'view' THEN 'B' ELSE 'C' END AS c FROM (SELECT event_id, event_type, lead(event_type) {_w} AS n FROM events) WHERE event_type = 'click' AND n IN ('view', 'error')")
add("cep_within", f"SELECT * {_m} A.event_id AS a, B.event_id AS b AFTER MATCH SKIP TO NEXT ROW PATTERN (A B) WITHIN 2 HOURS DEFINE A AS value > 20, B AS value > A.value)",
    f"SELECT event_id AS a, b FROM (SELECT event_id, value, ts, lead(event_id) {_w} AS b, lead(value) {_w} AS v, lead(ts) {_w} AS t FROM events) WHERE value > 20 AND v > value AND t - ts <= INTERVAL 2 HOUR")
add("cep_all_rows", f"SELECT event_id, c, n {_m} CLASSIFIER() AS c, MATCH_NUMBER() AS n, SUM(A.value) AS s ALL ROWS PER MATCH PATTERN (A+ B) WITHIN '30d' DEFINE A AS value > 50, B AS value <= 50)",
    f"""WITH t AS (SELECT *, value > 50 AS a, count(*) FILTER (WHERE value <= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events),
        k AS (SELECT user_id, g FROM t GROUP BY user_id, g HAVING count(*) FILTER (WHERE a) > 0 AND count(*) FILTER (WHERE NOT a) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g) AS n FROM k)
    SELECT event_id, CASE WHEN a THEN 'A' ELSE 'B' END AS c, n FROM t JOIN r USING (user_id, g)""")
add("cep_permute", f"SELECT * {_m} FIRST(event_id) AS a AFTER MATCH SKIP TO NEXT ROW PATTERN (PERMUTE(A, B)) WITHIN '30d' DEFINE A AS event_type = 'click', B AS event_type = 'view')",
    f"SELECT event_id AS a FROM (SELECT event_id, event_type, lead(event_type) {_w} AS n FROM events) WHERE (event_type = 'click' AND n = 'view') OR (event_type = 'view' AND n = 'click')")
add("cep_subset", f"SELECT * {_m} U.event_id AS last_id, AVG(U.value) AS m PATTERN (A B) SUBSET U = (A, B) WITHIN '30d' DEFINE A AS value > 60, B AS value > 60)".replace("PATTERN", "AFTER MATCH SKIP TO NEXT ROW PATTERN"),
    f"SELECT b AS last_id, (value + v) / 2 AS m FROM (SELECT value, lead(event_id) {_w} AS b, lead(value) {_w} AS v FROM events) WHERE value > 60 AND v > 60")
add("cep_reluctant", f"SELECT * {_m} A.event_id AS a, COUNT(*) AS n PATTERN (A B*? C) WITHIN '30d' DEFINE A AS event_type = 'signup', C AS event_type = 'purchase')",
    f"""WITH t AS (SELECT *, row_number() {_w} AS i, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events)
    SELECT arg_min(event_id, i) FILTER (WHERE event_type = 'signup') AS a, max(i) FILTER (WHERE event_type = 'purchase') - min(i) FILTER (WHERE event_type = 'signup') + 1 AS n FROM t
    GROUP BY user_id, g HAVING count(*) FILTER (WHERE event_type = 'signup') > 0 AND count(*) FILTER (WHERE event_type = 'purchase') > 0""")
add("cep_navigation", f"SELECT * {_m} A.event_id AS a, PREV(value) AS p AFTER MATCH SKIP TO NEXT ROW PATTERN (A) WITHIN '30d' DEFINE A AS value > PREV(value))",
    f"SELECT event_id AS a, p FROM (SELECT event_id, value, lag(value) {_w} AS p FROM events) WHERE value > p")


# what mends or extends the dialect
_parts = "split(event_type, 'i')"
add("expression_extras",
    f"SELECT event_id, event_type contains 'ic' AS a, event_type startsWith 'c' AS b, event_type matches '^[cv]' AS c, value > 50 ? 'hi' : 'lo' AS d, null_if(event_type, 'view') ?? 'none' AS e, user_id in [1, 2, 3] AS g, any({_parts}, {{# == 'v'}}) AS h, count({_parts}, {{# != ''}}) AS i, array_length(filter({_parts}, {{length(#) > 2}})) AS j {E1} WHERE value > 1 && !(event_type == 'error')",
    f"SELECT event_id, contains(event_type, 'ic') AS a, event_type LIKE 'c%' AS b, regexp_matches(event_type, '^[cv]') AS c, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS d, coalesce(nullif(event_type, 'view'), 'none') AS e, user_id IN (1, 2, 3) AS g, list_contains(string_split(event_type, 'i'), 'v') AS h, len(list_filter(string_split(event_type, 'i'), lambda x: x != ''))::BIGINT AS i, len(list_filter(string_split(event_type, 'i'), lambda x: strlen(x) > 2))::BIGINT AS j {E1} WHERE value > 1 AND event_type != 'error'")
add("numbers_as_text",
    f"SELECT event_id, concat(round(value), '|', event_id) AS a, upper('10.0') AS b, md5(concat('10.0', event_type)) AS c, format(value, '0.00000') AS d, length(split(event_type, 'i')) AS e, cast(value * 1e30, 'bigint') AS g {E1} WHERE concat(user_id, '.0') LIKE '%.0'",
    f"SELECT event_id, round(value)::BIGINT || '|' || event_id AS a, '10.0' AS b, md5('10.0' || event_type) AS c, printf('%.5f', value) AS d, len(string_split(event_type, 'i'))::BIGINT AS e, NULL::BIGINT AS g {E1}")
add("more_functions",
    f"SELECT event_id, to_json({_parts}) AS a, json_type(to_json({_parts})) AS b, json_length(to_json({_parts})) AS c, convert_tz(ts, 'Asia/Tokyo') AS d, length(sha512(event_type)) AS e, substring(current_date(), 0, 2) AS g, length(current_time()) AS h, rand() < 1 AS i, now() > ts AS j, int(value) AS k, toBase64(event_type) AS l, type(event_type) AS m {E1}",
    f"SELECT event_id, to_json(string_split(event_type, 'i'))::VARCHAR AS a, 'array' AS b, len(string_split(event_type, 'i'))::BIGINT AS c, ts + INTERVAL 9 HOUR AS d, 128::BIGINT AS e, '20' AS g, 8::BIGINT AS h, true AS i, true AS j, trunc(value)::BIGINT AS k, to_base64(event_type::BLOB) AS l, 'string' AS m {E1}")
add("window_order_limit", "SELECT event_type, count(*) AS n, sum(event_id) AS t, window_id() AS w FROM events GROUP BY event_type, TumblingWindow('1d') WITH (TIMESTAMP='ts') ORDER BY n DESC, event_type LIMIT 2",
    "SELECT event_type, n, t, w FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, event_type) AS r FROM (SELECT event_type, count(*) AS n, sum(event_id)::DOUBLE AS t, epoch_ns(date_trunc('day', ts)) || '_' || epoch_ns(date_trunc('day', ts) + INTERVAL 1 DAY) AS w FROM events GROUP BY event_type, date_trunc('day', ts))) WHERE r <= 2")
add("global_fraction", "SELECT user_id, count(*) AS n, min(event_id) AS a FROM events GROUP BY user_id, GLOBAL WINDOW TRIGGER WHEN count(*) >= 2.5",
    "SELECT user_id, count(*) AS n, min(event_id)::DOUBLE AS a FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS b FROM events) GROUP BY user_id, b HAVING count(*) = 3")
add("cep_case_history", f"SELECT * {_m} A.event_id AS a, round(AVG(value), 6) AS m, upper(A.event_type) AS t AFTER MATCH SKIP TO NEXT ROW PATTERN (A B) WITHIN '30d' DEFINE B AS CASE WHEN A.value > 50 THEN value < PREV(value) ELSE round(value) > 60 END)",
    f"SELECT event_id AS a, round((value + v) / 2, 6) AS m, upper(event_type) AS t FROM (SELECT event_id, event_type, value, lead(value) {_w} AS v FROM events) WHERE CASE WHEN value > 50 THEN v < value ELSE round(v) > 60 END")


def run(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register only the tables that the query names, so that no other footer is read."""
    q, e = parse(text), Engine(spark)
    for name in {q.table, *[join[1] for join in q.joins]}:
        e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLES[name])
    return e.sql(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(QUERIES["tumbling"][0], spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, text) for name, (text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

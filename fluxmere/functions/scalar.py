"""Scalar functions: name -> (least arguments, most or None, builder of a Column). Errors read as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = lambda c: c.try_cast("double")
L = lambda c: c.try_cast("bigint")
finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def S(c: Column) -> Column:
    """Text. A double has no exponent, a whole one no fraction; text stays as it is. The type test folds away."""
    t = c.cast("string")
    n = t.try_cast("decimal(38,15)")
    plain = F.regexp_replace(n.cast("string"), r"\.?0+$", "")
    exact = n.cast("double").eqNullSafe(t.try_cast("double"))
    return F.when(F.typeof(c).isin("double", "float"), F.when(exact, plain).otherwise(t)).otherwise(t)


def T(c: Column) -> Column:
    return c.try_cast("timestamp")


def _round(x: Column, p: Column | None = None) -> Column:
    if p is None:
        return F.round(D(x), 0)
    s = F.pow(F.lit(10.0), D(p))
    return F.round(D(x) * s, 0) / s


def _trunc(x: Column, p: Column) -> Column:
    s = F.pow(F.lit(10.0), D(p))
    v = D(x) * s
    return F.when(p >= 0, F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) / s)


def _substring(x: Column, start: Column, n: Column | None = None) -> Column:
    size = F.char_length(x)
    at = F.when(start < 0, F.greatest(F.lit(0), size + start)).otherwise(start)
    if n is None:
        return F.when(at >= size, "").otherwise(F.substring(x, at + 1, size))
    return F.when((n <= 0) | (at >= size), "").otherwise(F.substring(x, at + 1, n))


def _pad(side: str):
    def build(x: Column, n: Column, fill: Column | None = None) -> Column:
        t, f = S(x), F.lit(" ") if fill is None else fill
        more = F.repeat(f, F.greatest(F.lit(0), n - F.octet_length(t)).cast("int"))
        more = F.substring(more, F.lit(1), F.greatest(F.lit(0), n - F.octet_length(t)).cast("int"))
        return F.concat(more, t) if side == "l" else F.concat(t, more)

    return build


def _format(x: Column, pattern: Column | None = None, locale: Column | None = None) -> Column:
    p = F.lit("0.00") if pattern is None else pattern
    digits = F.when(F.contains(p, F.lit(".")), F.char_length(F.substring_index(p, ".", -1))).when(p == "0", 0).otherwise(2)
    return F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), D(x))


def _encode(x: Column, how: Column) -> Column:
    return F.when(how == "base64", F.base64(S(x).cast("binary"))).when(how == "hex", F.lower(F.hex(S(x).cast("binary")))).when(how == "url", F.url_encode(S(x)))


def _decode(x: Column, how: Column) -> Column:
    return F.when(how == "base64", F.try_to_binary(x, F.lit("base64")).cast("string")).when(how == "hex", F.unhex(x).cast("string")).when(how == "url", F.try_url_decode(x))


# Date patterns of the dialect and of Spark.
_PATTERNS = (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("HH", "HH"), ("hh", "HH"), ("MI", "mm"), ("SS", "ss"))


def _pattern(p: Column) -> Column:
    for a, b in _PATTERNS:
        p = F.replace(p, F.lit(a), F.lit(b))
    return p


def _units(n: Column, unit: Column) -> Column:
    u = F.lower(unit)
    of = lambda *names: u.isin(*names)
    k = F.when(of("second", "seconds"), 1).when(of("minute", "minutes"), 60).when(of("hour", "hours"), 3600).when(of("day", "days"), 86400).when(of("week", "weeks"), 604800)
    return n * k


def _date_add(sign: int):
    def build(d: Column, n: Column, unit: Column) -> Column:
        t, n, u = T(d), L(n) * sign, F.lower(unit)
        months = F.when(u.isin("month", "months"), n).when(u.isin("year", "years"), 12 * n)
        # months overflow into the next one: day of month counts on from its first day
        first = F.date_trunc("month", t)
        moved = F.add_months(first, months.cast("int")).cast("timestamp")
        over = F.timestamp_seconds(F.unix_seconds(moved) + F.unix_seconds(t) - F.unix_seconds(first))
        plain = F.timestamp_seconds(F.unix_seconds(t) + _units(n, unit))
        return F.date_format(F.coalesce(over, plain), "yyyy-MM-dd HH:mm:ss")

    return build


def _date_diff(a: Column, b: Column, unit: Column) -> Column:
    u = F.lower(unit)
    k = F.coalesce(_units(F.lit(1), unit), F.when(u.isin("month", "months"), 2592000).when(u.isin("year", "years"), 31536000))
    return F.call_function("div", F.unix_seconds(T(a)) - F.unix_seconds(T(b)), k)


def _extract(unit: Column, d: Column) -> Column:
    t, u = T(d), F.lower(unit)
    out = F.when(u == "year", F.year(t)).when(u == "month", F.month(t)).when(u == "day", F.dayofmonth(t)).when(u == "hour", F.hour(t))
    out = out.when(u == "minute", F.minute(t)).when(u == "second", F.second(t)).when(u == "weekday", F.dayofweek(t) - 1)
    return out.when(u == "yearday", F.dayofyear(t))


#: Type names of cast and what they are in Spark.
CASTS = {
    "bigint": "bigint",
    "int64": "bigint",
    "int": "bigint",
    "int32": "int",
    "float": "double",
    "float64": "double",
    "double": "double",
    "bool": "boolean",
    "boolean": "boolean",
}


def _cast(x: Column, kind: Column, name: str | None = None) -> Column:
    if name in ("string", "varchar", "text"):
        return S(x)
    to = CASTS[name]
    return D(x).try_cast(to) if to in ("bigint", "int") else x.try_cast(to)


def _json_type(x: Column) -> Column:
    v = F.try_parse_json(x)
    k = F.schema_of_variant(v)
    return F.when(v.isNull(), "invalid").when(k == "VOID", "null").when(k == "BOOLEAN", "boolean").when(k == "STRING", "string").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("number")


def _all(f):
    def build(*c: Column) -> Column:
        none = c[0].isNull()
        for x in c[1:]:
            none = none | x.isNull()
        return F.when(~none, f(*c) if len(c) > 1 else c[0])

    return build


def _case_when(*a: Column) -> Column:
    out = F.when(a[0], a[1])
    for k in range(2, len(a) - 1, 2):
        out = out.when(a[k], a[k + 1])
    return out.otherwise(a[-1]) if len(a) % 2 else out


def _length(x: Column) -> Column:
    return F.octet_length(S(x)).cast("bigint")


one = lambda f: (1, 1, f)
two = lambda f: (2, 2, f)

MATH = {
    "abs": one(lambda x: F.abs(D(x))),
    "sqrt": one(lambda x: F.when(D(x) >= 0, F.sqrt(D(x)))),
    "acos": one(lambda x: F.when(F.abs(D(x)) <= 1, F.acos(D(x)))),
    "asin": one(lambda x: F.when(F.abs(D(x)) <= 1, F.asin(D(x)))),
    "atan": one(lambda x: F.atan(D(x))),
    "atan2": two(lambda y, x: F.atan2(D(y), D(x))),
    "bitand": two(lambda x, y: L(x).bitwiseAND(L(y))),
    "bitor": two(lambda x, y: L(x).bitwiseOR(L(y))),
    "bitxor": two(lambda x, y: L(x).bitwiseXOR(L(y))),
    "bitnot": one(lambda x: F.bitwise_not(L(x))),
    "ceiling": one(lambda x: F.ceil(D(x)).cast("double")),
    "ceil": one(lambda x: F.ceil(D(x)).cast("double")),
    "cos": one(lambda x: F.cos(D(x))),
    "cosh": one(lambda x: F.cosh(D(x))),
    "exp": one(lambda x: finite(F.exp(D(x)))),
    "floor": one(lambda x: F.floor(D(x)).cast("double")),
    "ln": one(lambda x: F.when(D(x) > 0, F.ln(D(x)))),
    "log": one(lambda x: F.when(D(x) > 0, F.log10(D(x)))),
    "log10": one(lambda x: F.when(D(x) > 0, F.log10(D(x)))),
    "log2": one(lambda x: F.when(D(x) > 0, F.log2(D(x)))),
    "mod": two(lambda x, y: F.try_mod(D(x), D(y))),
    "rand": (0, 0, lambda: F.rand()),
    "round": (1, 2, _round),
    "sign": one(lambda x: F.signum(D(x)).cast("int")),
    "sin": one(lambda x: F.sin(D(x))),
    "sinh": one(lambda x: F.sinh(D(x))),
    "tan": one(lambda x: F.tan(D(x))),
    "tanh": one(lambda x: F.tanh(D(x))),
    "power": two(lambda x, y: finite(F.pow(D(x), D(y)))),
    "pow": two(lambda x, y: finite(F.pow(D(x), D(y)))),
}
TEXT = {
    "concat": (1, None, lambda *c: F.concat(*map(S, c))),
    "length": one(_length),
    "len": one(_length),
    "upper": one(lambda x: F.upper(S(x))),
    "lower": one(lambda x: F.lower(S(x))),
    "trim": one(lambda x: F.regexp_replace(S(x), r"^\s+|\s+$", "")),
    "format": (1, 3, _format),
    "endswith": two(lambda x, y: F.endswith(S(x), S(y))),
    "startswith": two(lambda x, y: F.startswith(S(x), S(y))),
    "indexof": two(lambda x, y: F.call_function("instr", S(x), S(y)).cast("bigint") - 1),
    "substring": (2, 3, lambda x, a, n=None: _substring(S(x), a, n)),
    "replace": (3, 3, lambda x, a, b: F.replace(S(x), S(a), S(b))),
    "split": two(lambda x, d: F.call_function("split", S(x), F.concat(F.lit("\\Q"), d, F.lit("\\E")))),
    "lpad": (2, 3, _pad("l")),
    "rpad": (2, 3, _pad("r")),
    "ltrim": one(lambda x: F.regexp_replace(S(x), r"^[ \t\r\n]+", "")),
    "rtrim": one(lambda x: F.regexp_replace(S(x), r"[ \t\r\n]+$", "")),
    "regexp_matches": two(lambda x, p: F.call_function("rlike", S(x), p)),
    "regexp_replace": (3, 3, lambda x, p, r: F.regexp_replace(S(x), p, r)),
    "regexp_substring": two(lambda x, p: F.call_function("regexp_extract", S(x), p, F.lit(0))),
}
CONVERSION = {
    "hex2dec": one(lambda x: F.conv(S(x), 16, 10).try_cast("bigint")),
    "dec2hex": one(lambda x: F.lower(F.hex(L(x)))),
    "encode": two(_encode),
    "decode": two(_decode),
    "convert_tz": two(lambda x, z: F.from_utc_timestamp(T(x), z)),
    "to_seconds": one(lambda x: F.coalesce(F.unix_seconds(T(x.cast("string"))), L(x.cast("string")))),
    "chr": one(lambda x: F.when(L(x).between(0, 127), F.chr(L(x)))),
    "url_encode": one(lambda x: F.url_encode(S(x))),
    "url_decode": one(lambda x: F.try_url_decode(S(x))),
    "trunc": two(_trunc),
}
DATETIME = {
    "now": (0, 0, lambda: F.current_timestamp()),
    "current_time": (0, 0, lambda: F.date_format(F.current_timestamp(), "HH:mm:ss")),
    "current_date": (0, 0, lambda: F.date_format(F.current_date(), "yyyy-MM-dd")),
    "date_add": (3, 3, _date_add(1)),
    "date_sub": (3, 3, _date_add(-1)),
    "date_diff": (3, 3, _date_diff),
    "date_format": two(lambda x, p: F.call_function("date_format", T(x), _pattern(p))),
    "date_parse": two(lambda x, p: F.date_format(F.try_to_timestamp(S(x), _pattern(p)), "yyyy-MM-dd HH:mm:ss")),
    "extract": two(_extract),
    "unix_timestamp": (0, 1, lambda x=None: F.unix_timestamp() if x is None else F.coalesce(F.unix_seconds(T(x.cast("string"))), L(x.cast("string")))),
    "from_unixtime": one(lambda x: F.date_format(F.timestamp_seconds(L(x)), "yyyy-MM-dd HH:mm:ss")),
    "year": one(lambda x: F.year(T(x))),
    "month": one(lambda x: F.month(T(x))),
    "day": one(lambda x: F.dayofmonth(T(x))),
    "hour": one(lambda x: F.hour(T(x))),
    "minute": one(lambda x: F.minute(T(x))),
    "second": one(lambda x: F.second(T(x))),
    "dayofweek": one(lambda x: F.dayofweek(T(x)) - 1),
    "dayofyear": one(lambda x: F.dayofyear(T(x))),
    "weekofyear": one(lambda x: F.weekofyear(T(x))),
}
JSON = {
    "to_json": one(lambda x: F.to_json(x)),
    "from_json": one(lambda x: F.try_parse_json(x)),
    "json_extract": two(lambda x, p: F.call_function("get_json_object", x, p)),
    "json_valid": one(lambda x: F.try_parse_json(x.cast("string")).isNotNull()),
    "json_type": one(_json_type),
    "json_length": one(lambda x: F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x))).cast("bigint")),
}
HASH = {
    "md5": one(lambda x: F.md5(S(x))),
    "sha1": one(lambda x: F.sha1(S(x))),
    "sha256": one(lambda x: F.sha2(S(x), 256)),
    "sha512": one(lambda x: F.sha2(S(x), 512)),
}
ARRAY = {
    "array_length": one(lambda x: F.size(x).cast("bigint")),
    "array_contains": two(lambda x, v: F.array_contains(x, v)),
    "array_position": two(lambda x, v: F.array_position(x, v)),
    "array_remove": two(lambda x, v: F.array_remove(x, v)),
    "array_distinct": one(F.array_distinct),
    "array_intersect": two(F.array_intersect),
    "array_union": two(F.array_union),
    "array_except": two(F.array_except),
}
# Static type tests are decided by the compiler.
TYPE = {
    "is_null": one(lambda x: x.isNull()),
    "is_not_null": one(lambda x: x.isNotNull()),
}
CONDITION = {
    "if_null": two(lambda x, y: F.coalesce(x, y)),
    "coalesce": (1, None, F.coalesce),
    "null_if": two(lambda x, y: F.nullif(x, y)),
    "greatest": (1, None, _all(F.greatest)),
    "least": (1, None, _all(F.least)),
    "case_when": (2, None, _case_when),
}
EXTRA = {
    "contains": two(lambda x, y: F.contains(S(x), S(y))),
    "hasprefix": two(lambda x, y: F.startswith(S(x), S(y))),
    "hassuffix": two(lambda x, y: F.endswith(S(x), S(y))),
    "flatten": one(F.flatten),
    "int": one(lambda x: D(x).try_cast("bigint")),
    "float": one(D),
    "string": one(lambda x: S(x)),
    "type": one(F.typeof),
    "tobase64": one(lambda x: F.base64(S(x).cast("binary"))),
    "frombase64": one(lambda x: F.try_to_binary(S(x), F.lit("base64")).cast("string")),
    "tojson": one(lambda x: F.to_json(x)),
    "fromjson": one(lambda x: F.try_parse_json(x)),
}
#: Functions by category.
CATEGORIES = {
    "math": MATH,
    "text": TEXT,
    "conversion": CONVERSION,
    "datetime": DATETIME,
    "json": JSON,
    "hash": HASH,
    "array": ARRAY,
    "type": TYPE,
    "condition": CONDITION,
    "extra": EXTRA,
}
SCALARS = {name: entry for group in CATEGORIES.values() for name, entry in group.items()}
#: Functions of an array and a test or value of its elements.
EACH = {
    "all": F.forall,
    "any": F.exists,
    "none": lambda a, f: ~F.exists(a, f),
    "one": lambda a, f: F.size(F.filter(a, f)) == 1,
    "filter": F.filter,
    "map": F.transform,
    "find": lambda a, f: F.get(F.filter(a, f), F.lit(0)),
    "count_each": lambda a, f: F.size(F.filter(a, f)).cast("bigint"),
}
TYPED = {"is_numeric", "is_string", "is_bool", "is_array", "is_object"}

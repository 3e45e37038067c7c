"""Expressions of the dialect as Columns. Arithmetic is in doubles; what can't be computed is NULL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from ..functions.scalar import CASTS, EACH, D, S, _cast, _pattern, finite
from ..plans.errors import SqlError, near
from ..plans.parser import Node, parse

TEXT_CALLS = {"concat", "upper", "lower", "trim", "substring", "replace", "lpad", "rpad", "ltrim", "rtrim", "format", "date_format", "md5", "sha1", "sha256", "sha512", "encode", "decode", "regexp_replace", "regexp_substring"}
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


#: Functions whose second argument is a pattern, and the type of their result; a pattern that can't be read gives NULL.
PATTERNS = {"regexp_matches": "boolean", "regexp_replace": "string", "regexp_substring": "string", "date_format": "string", "date_parse": "string"}


@lru_cache(1000)
def readable(name: str, pattern) -> bool:
    """Whether a literal regular expression or date pattern can be compiled; asked once, on the driver."""
    from py4j.protocol import Py4JJavaError

    spark = SparkSession.active()
    try:
        if name.startswith("regexp"):
            spark._jvm.java.util.regex.Pattern.compile(str(pattern))
        else:
            spark.sql("SELECT 1").select(F.call_function("date_format", F.lit("2024-01-01").cast("timestamp"), _pattern(F.lit(str(pattern))))).collect()
    except (Py4JJavaError, PySparkException):
        return False
    return True


def same(a: Node, b: Node) -> bool:
    """Whether two expressions read alike, wherever they stand."""
    if not isinstance(a, Node) or not isinstance(b, Node):
        if isinstance(a, list | tuple) and isinstance(b, list | tuple):
            return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
        return a == b
    return a.kind == b.kind and same(a.value, b.value) and same(a.args, b.args)


def children(n: Node) -> list[Node]:
    if n.kind == "case":
        operand, whens, other = n.value
        return [x for x in (operand, *[y for w in whens for y in w], other) if x is not None]
    return n.args


def calls(n: Node, kind: str):
    """All calls of one kind in an expression, outermost first."""
    if n.kind == "call" and registry.kind(n.value) == kind:
        yield n
    for c in children(n):
        yield from calls(c, kind)


def check(n: Node, inside: str = "") -> None:
    """Unknown functions, argument counts, and nesting that has no meaning."""
    if n.kind == "call":
        registry.lookup(n.value, len(n.args), n.at)
        kind = registry.kind(n.value)
        if inside == "aggregate" and kind in ("aggregate", "analytic"):
            raise SqlError("semantic", f"{n.value} inside an aggregate", *n.at)
        if inside == "analytic" and kind == "analytic":
            raise SqlError("semantic", f"{n.value} inside an analytic function", *n.at)
        inside = kind if kind in ("aggregate", "analytic") else inside
    for c in children(n):
        check(c, inside)


class Compiler:
    """``names``: column by lower-case reference (also alias.column); ``special``: Columns of finished calls."""

    def __init__(self, df: DataFrame, order: Column, qualifiers: dict[str, dict[str, str]] | None = None):
        self.df, self.order, self.qualifiers = df, order, qualifiers or {}
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.special: list[tuple[Node, Column]] = []
        self.keys: list[tuple[Node, Column]] = []
        self.grouped = False
        self.elements: list[Column] = []

    def type_of(self, n: Node):
        if n.kind == "col":
            try:
                return self.df.select(self.column(n)).schema[0].dataType
            except SqlError:
                return None
        if n.kind == "lit":
            return T.StringType() if isinstance(n.value, str) else T.DoubleType()
        if n.kind == "call" and n.value in TEXT_CALLS:
            return T.StringType()
        return None

    def text(self, n: Node) -> bool:
        return isinstance(self.type_of(n), T.StringType) or (n.kind == "bin" and n.value in ("+", "||") and any(self.text(a) for a in n.args))

    def column(self, n: Node) -> Column:
        path, at = list(n.value), 0
        if len(path) > 1 and path[0] in self.qualifiers:
            scope, name = self.qualifiers[path[0]], path[1]
            if name not in scope:
                raise SqlError("semantic", f"unknown column {path[0]}.{name}", *n.at, hint=near(name, scope))
            out, kind, at = F.col(f"`{scope[name]}`"), self.types[scope[name]], 2
        else:
            found = [c for c in self.types if c == path[0]] or [c for c in self.types if c.lower() == str(path[0]).lower()]
            if not found:
                raise SqlError("semantic", f"unknown column {path[0]}", *n.at, hint=near(str(path[0]), self.types))
            owners = {s[path[0]] for s in self.qualifiers.values() if path[0] in s}
            if len(owners) > 1:
                raise SqlError("semantic", f"column {path[0]} is ambiguous", *n.at, hint="qualify it")
            out, kind, at = F.col(f"`{found[0]}`"), self.types[found[0]], 1
        for step in path[at:]:
            key = step[1] if isinstance(step, tuple) else step
            if isinstance(kind, T.ArrayType) and isinstance(key, int):
                out, kind = F.try_element_at(out, F.lit(key + 1 if key >= 0 else key)), kind.elementType
            elif isinstance(kind, T.MapType):
                out, kind = F.try_element_at(out, F.lit(key)), kind.valueType
            elif isinstance(kind, T.StructType) and key in kind.names:
                out, kind = out.getField(key), kind[key].dataType
            elif isinstance(kind, T.VariantType):
                return F.try_variant_get(out, "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k[1] if isinstance(k, tuple) else k}" for k in path[at:]), "string")
            else:
                return F.lit(None)
        return out

    def __call__(self, n: Node) -> Column:
        for known, col in self.special:
            if known is n:
                return col
        for key, col in self.keys:
            if same(key, n):
                return col
        if self.grouped and n.kind != "lit" and not any(calls(n, "aggregate")) and not self._on_keys(n):
            return F.max_by(Compiler.row(self, n), self.order)
        return getattr(self, f"_{n.kind}")(n)

    def _on_keys(self, n: Node) -> bool:
        if any(same(k, n) for k, _ in self.keys) or any(s is n for s, _ in self.special):
            return True
        if n.kind == "col":
            return False
        return all(self._on_keys(c) for c in children(n))

    def row(self, n: Node) -> Column:
        """An expression over single rows, also inside an aggregate."""
        held = self.grouped, self.keys
        self.grouped, self.keys = False, []
        try:
            return self(n)
        finally:
            self.grouped, self.keys = held

    def _lit(self, n: Node) -> Column:
        return F.lit(n.value)

    def _col(self, n: Node) -> Column:
        return self.column(n)

    def _star(self, n: Node) -> Column:
        return F.lit(1)

    def _un(self, n: Node) -> Column:
        return ~self(n.args[0]) if n.value == "not" else -D(self(n.args[0]))

    def _bin(self, n: Node) -> Column:
        a, b = n.args
        o = n.value
        if o in ("and", "or"):
            x, y = self(a), self(b)
            return x & y if o == "and" else x | y
        if o in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(o, a, b)
        if o == "||" or (o == "+" and (self.text(a) or self.text(b))):
            return F.concat(S(self(a)), S(self(b)))
        x, y = D(self(a)), D(self(b))
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y), "^": lambda: finite(F.pow(x, y))}[o]()

    def compare(self, o: str, a: Node, b: Node) -> Column:
        for x, y in ((a, b), (b, a)):
            if x.kind == "lit" and x.value is None:
                return self(y).isNull() if o == "=" else self(y).isNotNull() if o == "!=" else F.lit(None).cast("boolean")
        x, y = self(a), self(b)
        ta, tb = self.type_of(a), self.type_of(b)
        if isinstance(ta, T.StringType) != isinstance(tb, T.StringType) and ta is not None and tb is not None:
            text, other = (ta, tb) if isinstance(ta, T.StringType) else (tb, ta)
            if isinstance(other, NUMBERS):
                p, q = D(x), D(y)
                number = {"=": p == q, "!=": p != q, "<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[o]
                words = {"=": S(x) == S(y), "!=": S(x) != S(y)}.get(o, F.lit(None).cast("boolean"))
                return F.when(p.isNotNull() & q.isNotNull(), number).otherwise(words)
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[o]

    def _null(self, n: Node) -> Column:
        c = self(n.args[0])
        return c.isNotNull() if n.value else c.isNull()

    def _like(self, n: Node) -> Column:
        if n.args[1].kind != "lit":
            raise SqlError("semantic", "LIKE takes a literal pattern", *n.at)
        c = S(self(n.args[0])).like(str(n.args[1].value).replace("\\", "\\\\"))
        return ~c if n.value else c

    def _in(self, n: Node) -> Column:
        c = self(n.args[0]).isin(*[self(x) for x in n.args[1:]])
        return ~c if n.value else c

    def _between(self, n: Node) -> Column:
        a, lo, hi = n.args
        c = self.compare(">=", a, lo) & self.compare("<=", a, hi)
        return ~c if n.value else c

    def _case(self, n: Node) -> Column:
        operand, whens, other = n.value
        out = None
        for test, value in whens:
            t = self(test) if operand is None else self.compare("=", operand, test)
            out = F.when(t, self(value)) if out is None else out.when(t, self(value))
        return out.otherwise(self(other))

    def element(self, x: Column, body: Node) -> Column:
        self.elements.append(x)
        try:
            return self(body)
        finally:
            self.elements.pop()

    def _elem(self, n: Node) -> Column:
        if not self.elements:
            raise SqlError("semantic", "# stands for an element inside braces only", *n.at)
        out = self.elements[-1]
        for step in n.value:
            out = out.getField(step)
        return out

    def _call(self, n: Node) -> Column:
        build = registry.lookup(n.value, len(n.args), n.at)
        kind = registry.kind(n.value)
        if kind == "aggregate":
            args = [] if n.args and n.args[0].kind == "star" else [self.row(a) for a in n.args]
            return build(args, self.order)
        if n.value == "cast":
            to = str(n.args[1].value).lower() if n.args[1].kind in ("lit", "col") else ""
            to = n.args[1].value[-1].lower() if n.args[1].kind == "col" else to
            if to not in CASTS and to not in ("string", "varchar", "text"):
                raise SqlError("semantic", f"cast to unknown type {to}", *n.at, hint=near(to, [*CASTS, "string"]))
            return _cast(self(n.args[0]), None, to)
        if n.value in ("length", "len") and not self.elements:
            c = self(n.args[0])
            if isinstance(self.df.select(c).schema[0].dataType, T.ArrayType | T.MapType):
                return F.when(c.isNotNull(), F.size(c)).cast("bigint")
        if n.value in PATTERNS and n.args[1].kind == "lit" and not readable(n.value, n.args[1].value):
            return F.lit(None).cast(PATTERNS[n.value])
        if n.value in EACH:
            if n.args[1].kind != "each":
                raise SqlError("semantic", f"{n.value} takes an array and a test in braces", *n.at)
            return EACH[n.value](self(n.args[0]), lambda x: self.element(x, n.args[1].args[0]))
        if n.value == "expr":
            if n.args[0].kind != "lit":
                raise SqlError("semantic", "expr takes a literal text", *n.at)
            return self(parse(f"SELECT {n.args[0].value} FROM t").items[0][0])
        if n.value in registry.TYPED:
            kinds = {"is_numeric": NUMBERS, "is_string": (T.StringType,), "is_bool": (T.BooleanType,), "is_array": (T.ArrayType,), "is_object": (T.StructType, T.MapType)}[n.value]
            c = self(n.args[0])
            held = self.df.select(c).schema[0].dataType
            if isinstance(held, T.VariantType):
                want = {"is_numeric": "BIGINT|DOUBLE|DECIMAL.*", "is_string": "STRING", "is_bool": "BOOLEAN", "is_array": "ARRAY.*", "is_object": "OBJECT.*"}[n.value]
                return F.schema_of_variant(c).rlike(f"^({want})")
            return c.isNotNull() & F.lit(isinstance(held, kinds))
        if kind in ("analytic", "special"):
            raise SqlError("semantic", f"{n.value} isn't allowed here", *n.at)
        return build(*[self(a) for a in n.args])

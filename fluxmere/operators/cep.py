"""MATCH_RECOGNIZE: patterns over the rows of a partition, in order."""

from __future__ import annotations

import operator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import SqlError
from ..plans.parser import Match, Node
from .ordered import by_key
from .pyscalar import SCALARS

AGGREGATES = {"sum", "avg", "count", "min", "max"}
STEPS = {"prev", "next", "first", "last", *AGGREGATES, "classifier", "match_number"}
DEFAULT_WITHIN = 3600.0
#: Runs of one match attempt that differ in what conditions can see; beyond it the query ends with an error.
RUNS = 10_000


class Automaton:
    """States are numbered; ``moves[s]`` lists (symbol or None, next state) in order of preference."""

    def __init__(self, pattern, subset: dict[str, list[str]]):
        self.moves: list[list[tuple]] = []
        self.reluctant, self.subset, self.symbols = False, subset, set()
        self.final = self.state()
        self.start = self.build(pattern, self.final)
        self.ready = [self.closure(s) for s in range(len(self.moves))]

    def state(self, *moves) -> int:
        self.moves.append(list(moves))
        return len(self.moves) - 1

    def build(self, p, then: int) -> int:
        kind = p[0]
        if kind == "sym":
            if p[1] in self.subset:
                return self.build(("alt", [("sym", s) for s in self.subset[p[1]]]), then)
            self.symbols.add(p[1])
            return self.state((p[1], then))
        if kind == "seq":
            for part in reversed(p[1]):
                then = self.build(part, then)
            return then
        if kind == "alt":
            return self.state(*[(None, self.build(x, then)) for x in p[1]])
        if kind == "permute":
            return self.state(*[(None, self.build(("seq", list(x)), then)) for x in permutations(p[1])])
        _, inner, lo, hi, lazy = p
        self.reluctant |= lazy
        if hi is None:
            loop = self.state()
            body = self.build(inner, loop)
            self.moves[loop] = [(None, body), (None, then)]
            at = loop
        else:
            at = then
            for _ in range(hi - lo):
                at = self.state((None, self.build(inner, at)), (None, then))
        for _ in range(lo):
            at = self.build(inner, at)
        return at

    def closure(self, state: int) -> list[int]:
        """States with a symbol to read, or the final one, reachable without reading."""
        out, seen, stack = [], set(), [state]
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            if s == self.final or any(sym for sym, _ in self.moves[s]):
                out.append(s)
            stack.extend(t for sym, t in reversed(self.moves[s]) if sym is None)
        return out


class Tracked:
    """What conditions read of the rows matched so far: per symbols and column, running count, sum, extremes and last value.

    Runs in one state that agree in these can't be told apart by any later condition, so one of them goes.
    """

    def __init__(self):
        self.keys: list[tuple] = []  # (names of symbols or None for all, column or None for rows)
        self.labels = False

    def index(self, names, column) -> int:
        key = (names, column)
        if key not in self.keys:
            self.keys.append(key)
        return self.keys.index(key)

    def empty(self) -> tuple:
        return tuple((0, 0.0, None, None, None) for _ in self.keys)

    def step(self, sums: tuple, rows: dict, at: int, sym: str) -> tuple:
        out = list(sums)
        for k, (names, column) in enumerate(self.keys):
            if names is not None and sym not in names:
                continue
            n, total, low, high, last = out[k]
            v = 1 if column is None else rows[column][at]
            if v is None:
                out[k] = (n, total, low, high, None)
                continue
            number = total + v if isinstance(v, int | float) else total
            try:
                low, high = v if low is None or v < low else low, v if high is None or v > high else high
            except TypeError:
                pass
            out[k] = (n + 1, number, low, high, v)
        return tuple(out)


class Frame:
    """What an expression sees: a partition's rows by column, ``size`` matched rows from ``start`` on, and a current row.

    Matched rows follow each other, so a place in the match is a row. ``sums`` are those of Tracked;
    ``symbols`` the label of each matched row.
    """

    __slots__ = ("rows", "start", "size", "at", "number", "sums", "symbols", "last")

    def __init__(self, rows, start, size, at, number, sums, symbols, last):
        self.rows, self.start, self.size, self.at, self.number = rows, start, size, at, number
        self.sums, self.symbols, self.last = sums, symbols, last


OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
MATH = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": lambda x, y: x - y * int(x / y), "^": operator.pow}


def safe(f):
    """What can't be computed is None."""

    def call(*args):
        try:
            return f(*args)
        except (ArithmeticError, ValueError, TypeError, LookupError, AttributeError):
            return None

    return call


def closure(n: Node, subset: dict, tracked: Tracked):
    """A Python function of a Frame. NULL and errors read as None; comparisons with None are false."""
    if n.kind == "call" and n.value in STEPS:
        return step(n, subset, tracked)
    if n.kind == "lit":
        return lambda f: n.value
    if n.kind == "col":
        if len(n.value) == 1:
            return lambda f, c=n.value[0]: f.rows[c][f.at] if 0 <= f.at < len(f.rows[c]) else None
        sym = n.value[0].upper()
        k = tracked.index(frozenset(subset.get(sym, [sym])), n.value[1])
        return lambda f: f.sums[k][4]
    if n.kind == "case":
        operand, whens, other = n.value
        sub = lambda x: closure(x, subset, tracked)
        tests = [(sub(t if operand is None else Node("bin", "=", [operand, t])), sub(v)) for t, v in whens]
        rest = sub(other) if other is not None else lambda f: None
        return lambda f: next((v for t, v in tests if t(f)), rest)(f)
    sub = [closure(a, subset, tracked) for a in n.args]
    if n.kind == "bin":
        a, b = sub
        if n.value == "and":
            return lambda f: bool(a(f)) and bool(b(f))
        if n.value == "or":
            return lambda f: bool(a(f)) or bool(b(f))
        if n.value in OPS:
            if any(x.kind == "lit" and x.value is None for x in n.args):
                return (lambda f: a(f) is None and b(f) is None) if n.value == "=" else (lambda f: (a(f) is None) != (b(f) is None))
            compare = safe(OPS[n.value])
            return lambda f: (x := a(f)) is not None and (y := b(f)) is not None and bool(compare(x, y))
        if n.value == "||":
            return lambda f: None if (x := a(f)) is None or (y := b(f)) is None else SCALARS["concat"](x, y)
        compute = safe(lambda x, y, o=MATH[n.value]: o(float(x), float(y)))
        return lambda f: None if (x := a(f)) is None or (y := b(f)) is None else compute(x, y)
    if n.kind == "un":
        return (lambda f: not sub[0](f)) if n.value == "not" else (lambda f: None if (x := sub[0](f)) is None else -x)
    if n.kind == "null":
        return lambda f: (sub[0](f) is None) != bool(n.value)
    if n.kind == "between":
        return lambda f: None not in (x := [s(f) for s in sub]) and (x[1] <= x[0] <= x[2]) != bool(n.value)
    if n.kind == "in":
        return lambda f: (x := sub[0](f)) is not None and (x in [s(f) for s in sub[1:]]) != bool(n.value)
    if n.kind == "like" and n.args[1].kind == "lit":
        like = SCALARS["like"]
        return lambda f: (x := sub[0](f)) is not None and like(x, n.args[1].value) != bool(n.value)
    if n.kind == "call" and n.value in SCALARS:
        call = safe(SCALARS[n.value])
        return lambda f: call(*[s(f) for s in sub])
    raise SqlError("semantic", f"{n.value or n.kind} can't be used in a pattern", *n.at)


def step(n: Node, subset: dict, tracked: Tracked):
    if n.value == "classifier":
        tracked.labels = True
        return lambda f: f.symbols[f.at - f.start] if f.symbols and 0 <= f.at - f.start < len(f.symbols) else f.last
    if n.value == "match_number":
        return lambda f: f.number
    arg = n.args[0] if n.args else Node("star")
    if arg.kind not in ("col", "star"):
        raise SqlError("semantic", f"{n.value} in a pattern takes a column", *n.at)
    if len(n.args) > 1 and (n.args[1].kind != "lit" or not isinstance(n.args[1].value, int)):
        raise SqlError("semantic", f"{n.value} takes a whole number of rows", *n.at)
    k = n.args[1].value if len(n.args) > 1 else 1
    column = arg.value[-1] if arg.kind == "col" else None
    if n.value in ("prev", "next"):
        move = -k if n.value == "prev" else k
        return lambda f: f.rows[column][f.at + move] if 0 <= f.at + move < len(f.rows[column]) else None
    if n.value in ("first", "last"):
        # over all rows of the match, whatever symbol qualifies the column; the offset is clamped
        def pick(f):
            if not f.size:
                return None
            i = max(0, min(k, f.size) - 1)
            return f.rows[column][f.start + (i if n.value == "first" else f.size - 1 - i)]

        return pick
    names = frozenset(subset.get(arg.value[0].upper(), [arg.value[0].upper()])) if arg.kind == "col" and len(arg.value) > 1 else None
    key = tracked.index(names, column)
    return {
        "count": lambda f: f.sums[key][0],
        "sum": lambda f: float(f.sums[key][1]),
        "avg": lambda f: float(f.sums[key][1]) / f.sums[key][0] if f.sums[key][0] else None,
        "min": lambda f: f.sums[key][2],
        "max": lambda f: f.sums[key][3],
    }[n.value]


def history_free(n: Node) -> bool:
    if n.kind == "call" and n.value in STEPS or n.kind == "col" and len(n.value) > 1:
        return False
    if n.kind == "case":
        operand, whens, other = n.value
        return all(history_free(x) for x in (operand, *[y for w in whens for y in w], other) if x is not None)
    return all(history_free(a) for a in n.args)


def reach(n: Node, name: str) -> int:
    """How many rows an expression looks back (``prev``) or ahead (``next``)."""
    if n.kind == "case":
        operand, whens, other = n.value
        return max((reach(x, name) for x in (operand, *[y for w in whens for y in w], other) if x is not None), default=0)
    own = (int(n.args[1].value) if len(n.args) > 1 else 1) if n.kind == "call" and n.value == name else 0
    return max([own, *(reach(a, name) for a in n.args)])


def labels(cell) -> list[str]:
    out = []
    while cell is not None:
        out.append(cell[0])
        cell = cell[1]
    return out[::-1]


def attempt(auto: Automaton, rows: dict, tests: dict, tracked: Tracked, times: list[float], within: float, start: int, number: int, open_end: bool):
    """(labels of the match that begins at ``start`` or None, whether rows still to come may change that).

    Runs are (state, labels as linked cells, Tracked sums), preferred ones first; of runs that no later
    condition can tell apart the first stays.
    """
    n, at, best = len(times), start, None
    live = [(s, None, tracked.empty()) for s in auto.ready[auto.start] if s != auto.final]
    while live and at < n and times[at] - times[start] <= within:
        nxt, seen, done = [], set(), None
        for state, cell, sums in live:
            for sym, to in auto.moves[state]:
                if sym is None:
                    continue
                now = tracked.step(sums, rows, at, sym) if tracked.keys else sums
                if not tests[sym](Frame(rows, start, at - start + 1, at, number, now, None, sym)):
                    continue
                here = (sym, cell)
                for s in auto.ready[to]:
                    if s == auto.final:
                        done = done or here
                        continue
                    key = (s, now, sym if tracked.labels else None)
                    if key in seen:
                        continue
                    if len(nxt) >= RUNS:
                        raise ValueError(f"a match attempt has over {RUNS} runs that its conditions tell apart; bound the pattern or WITHIN")
                    seen.add(key)
                    nxt.append((s, here, now))
        if done:
            best = done
            if auto.reluctant:
                return labels(best), False
        live, at = nxt, at + 1
    return (labels(best) if best else None), bool(live) and at >= n and open_end


def matches(auto: Automaton, rows: dict, tests: dict, tracked: Tracked, times: list[float], within: float, skip: tuple, start: int = 0, number: int = 0, open_end: bool = False, ahead: int = 0, begins=None):
    """(number, first row, labels) of each match from row ``start`` on; then (None, row to go on from, None).

    With an open end, it stops at the first attempt that later rows could still change. ``begins`` has, for
    each row, the next one on which a first symbol's condition holds, where that is known.
    """
    n = len(times)
    while start < n:
        if begins is not None:
            start = begins[start]
            if start >= n:
                break
        found, waits = attempt(auto, rows, tests, tracked, times, within, start, number + 1, open_end)
        if waits or (open_end and start + (len(found) if found else 1) + ahead > n):
            break
        if found is None:
            start += 1
            continue
        number += 1
        yield number, start, found
        kind, sym = skip
        if kind == "past":
            start += len(found)
        elif kind == "next":
            start += 1
        else:
            names = set(auto.subset.get(sym, [sym]))
            spots = [i for i, s in enumerate(found) if s in names]
            start += (spots[0] if kind == "first" else spots[-1]) + 1 if spots else len(found)
    yield None, start, None


def _seconds(values) -> list[float]:
    out = []
    for v in values:
        if hasattr(v, "timestamp"):
            out.append(v.timestamp())
        else:
            x = float(v)
            out.append(x / (1e9 if abs(x) > 1e17 else 1e6 if abs(x) > 1e14 else 1e3 if abs(x) > 1e11 else 1.0))
    return out


def flat(subset: dict[str, list[str]]) -> dict[str, list[str]]:
    """Subsets with nested ones spelled out; a subset that contains itself, however far down, is an error."""

    def parts(k: str, inside: tuple) -> list[str]:
        if k in inside:
            raise SqlError("semantic", f"SUBSET {k} contains itself")
        return [s for x in subset[k] for s in (parts(x, (*inside, k)) if x in subset else [x])]

    out = {k: list(dict.fromkeys(parts(k, ()))) for k in subset}
    for k, v in out.items():
        if not 1 <= len(v) <= 8:
            raise SqlError("semantic", f"SUBSET {k} needs 1 to 8 other symbols")
    return out


class Recognizer:
    """A compiled MATCH_RECOGNIZE: the columns it needs, its result's schema, and the fold of a partition's rows."""

    def __init__(self, df: DataFrame, m: Match, compiler, order: list[str]):
        self.m, self.subset = m, flat(m.subset)
        self.auto = Automaton(m.pattern, self.subset)
        for s in m.define:
            if s not in self.auto.symbols and s not in self.subset:
                raise SqlError("semantic", f"DEFINE names {s}, which PATTERN doesn't have")
        self.source = list(df.columns)
        # tests without history are computed by Spark before the fold
        self.pre = {s: e for s, e in m.define.items() if history_free(e)}
        df = df.withColumns({f"_d_{s}": F.coalesce(compiler.row(e), F.lit(False)) for s, e in self.pre.items()}) if self.pre else df
        self.keys = [compiler.row(p) for p in m.partition]
        self.df = df.withColumn("_keys", F.struct(*self.keys) if self.keys else F.lit(1))
        self.within = m.within if m.within is not None else DEFAULT_WITHIN
        self.measures = [(alias or (e.value[-1] if e.kind == "col" else e.value), e) for e, alias in m.measures]
        self.final = [e.over == "final" for _, e in self.measures]
        self.every = m.all_rows or not self.measures
        self.fields = [f for f in df.schema.fields if f.name in self.source] if self.every else []
        self.schema = T.StructType([*self.fields, *[T.StructField(a, self.kind(e)) for a, e in self.measures]])
        self.by = [c for c, _ in m.order] + [c for c in order if c not in [x for x, _ in m.order]]
        self.tracked, self.told = Tracked(), Tracked()
        self.behind = max((reach(e, "prev") for e in [*m.define.values(), *[e for _, e in self.measures]]), default=0)
        self.ahead = max((reach(e, "next") for e in [*m.define.values(), *[e for _, e in self.measures]]), default=0)
        tests = {s: closure(e, self.subset, self.tracked) for s, e in m.define.items() if s not in self.pre}
        funcs = [closure(e, self.subset, self.told) for _, e in self.measures]  # unknown functions fail here, not in a worker
        self.tests, self.funcs = tests, funcs

    def __getstate__(self) -> dict:
        """What a worker needs: all but the frame."""
        return {k: v for k, v in self.__dict__.items() if k not in ("df", "keys")}

    def kind(self, e: Node):
        if e.kind == "col":
            return self.df.schema[e.value[-1]].dataType if e.value[-1] in self.df.columns else T.StringType()
        if e.kind == "call":
            if e.value in ("match_number", "count", "length", "len"):
                return T.LongType()
            if e.value in ("classifier", "concat", "upper", "lower", "trim", "substring", "replace"):
                return T.StringType()
            return self.kind(e.args[0]) if e.value in ("prev", "next", "first", "last", "min", "max", "coalesce", "if_null", "null_if", "greatest", "least") and e.args else T.DoubleType()
        if e.kind == "lit":
            return T.StringType() if isinstance(e.value, str) else T.DoubleType()
        if e.kind == "case":
            return self.kind(e.value[1][0][1])
        return T.BooleanType() if e.kind in ("null", "in", "between", "like") or e.value in (*OPS, "and", "or", "not") else T.StringType() if e.value == "||" else T.DoubleType()

    def fold(self, pdf, number: int = 0, skipped: int = 0, open_end: bool = False):
        """(result rows, row to go on from, matches so far) of a partition's rows; ``skipped`` rows are done, but can be looked back at."""
        import pandas as pd

        rows = {c: [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in pdf[c].tolist()] for c in self.source}
        tests = dict.fromkeys(self.auto.symbols, lambda f: True)
        for s in self.m.define:
            flags = pdf[f"_d_{s}"].tolist() if s in self.pre else None
            for one in self.subset.get(s, [s]):
                tests[one] = (lambda f, flags=flags: flags[f.at]) if flags is not None else self.tests[s]
        out, start = [], skipped
        times = _seconds(pdf[self.by[0]].tolist())
        for k, start, found in matches(self.auto, rows, tests, self.tracked, times, self.within, self.m.skip, skipped, number, open_end, self.ahead, self.begins(pdf)):
            if k is None:
                break
            number, sums = k, [self.told.empty()]
            for i, s in enumerate(found):
                sums.append(self.told.step(sums[-1], rows, start + i, s))
            for i in range(len(found)) if self.every else [len(found) - 1]:
                at = start + i
                values = [f(Frame(rows, start, len(found) if last else i + 1, at, number, sums[-1] if last else sums[i + 1], found, found[i])) for f, last in zip(self.funcs, self.final, strict=True)]
                out.append([*(rows[f.name][at] for f in self.fields), *values])
        return out, start, number

    def begins(self, pdf) -> list[int] | None:
        """For each row, the first one from there on that a match can begin with, if Spark has computed the conditions."""
        import numpy as np

        symbols = {sym for s in self.auto.ready[self.auto.start] for sym, _ in self.auto.moves[s] if sym}
        tested = {one: s for s in self.m.define for one in self.subset.get(s, [s])}
        if not all(tested.get(s) in self.pre for s in symbols):
            return None
        can = np.zeros(len(pdf), bool)
        for s in symbols:
            can |= pdf[f"_d_{tested[s]}"].to_numpy(dtype=bool)
        at = np.where(can, np.arange(len(pdf)), len(pdf))
        return np.minimum.accumulate(at[::-1])[::-1].tolist()

    def frame(self, out: list):
        """Result rows as pandas, in the types of the schema."""
        import pandas as pd

        pdf = pd.DataFrame(out, columns=[f.name for f in self.schema.fields])
        whole = {f.name: "Int64" for f in self.schema.fields if isinstance(f.dataType, T.LongType | T.IntegerType)}
        return pdf.astype({**whole, **{f.name: "float64" for f in self.schema.fields if isinstance(f.dataType, T.DoubleType)}})

    def sort(self, pdf):
        return pdf.sort_values(self.by, kind="stable").reset_index(drop=True)


def recognize(df: DataFrame, m: Match, compiler, order: list[str]) -> DataFrame:
    """Bounded input: a fold over each partition's rows in order, which holds rows from the first open attempt on."""
    r = Recognizer(df, m, compiler, order)

    def step(rows, held, last):
        import pandas as pd

        rest, skipped, number = held or (None, 0, 0)
        rows = pd.concat([rest, rows], ignore_index=True) if rest is not None else rows
        out, start, number = r.fold(rows, number, skipped, not last)
        keep = max(0, start - r.behind)
        return (r.frame(out) if out else None), (rows.iloc[keep:].reset_index(drop=True), start - keep, number)

    return by_key(r.df, r.keys, r.by, r.schema, step)

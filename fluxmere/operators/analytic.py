"""Stateful functions over rows in order of arrival, as window functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from ..functions.scalar import D
from ..plans.errors import SqlError
from ..plans.parser import Node
from .ordered import by_key, in_parts

#: Calls that look back to a few rows, and their first argument that is looked at.
LOOKS = {"lag": 0, "latest": 0, "changed_col": 1, "changed_cols": 2, "had_changed": 1}
#: The farthest lag over a sequence in parts.
FARTHEST = 1000


def literal(n: Node, default=None):
    if n.kind != "lit":
        raise SqlError("semantic", "a literal is expected here", *n.at)
    return n.value if n.value is not None else default


@dataclass
class Look:
    """What a call looks at: (name, column that holds it), whether NULLs are skipped, and how many rows back."""

    cells: list[tuple[str, str]]
    skip: bool
    step: int = 1

    @property
    def columns(self) -> list[Column]:
        return [F.col(c) for _, c in self.cells]


def look(df: DataFrame, n: Node, compiler, name: str) -> tuple[DataFrame, Look]:
    """The rows with what a call of LOOKS looks at in columns of their own."""
    at = LOOKS[n.value]
    args = n.args[at:] if n.value in ("changed_cols", "had_changed") else n.args[at : at + 1]
    if any(a.kind == "star" for a in args):
        found = [(c, F.col(f"`{c}`")) for c in compiler.df.columns]
    else:
        found = [(str(a.value[-1]) if a.kind == "col" else f"c{i}", compiler.row(a)) for i, a in enumerate(args)]
    cells = [(c, f"{name}_i{i}") for i, (c, _) in enumerate(found)]
    df = df.withColumns({i: col for (_, i), (_, col) in zip(cells, found, strict=True)})
    if n.value == "lag":
        step = int(literal(n.args[1], 1)) if len(n.args) > 1 else 1
        return df, Look(cells, bool(literal(n.args[3])) if len(n.args) > 3 else True, step)
    return df, Look(cells, n.value == "latest" or bool(literal(n.args[at - 1])))


def cut(df: DataFrame, found: list[tuple[Node, str]], compiler, order: list[str], part: str, cuts) -> tuple[DataFrame, dict[int, Look]]:
    """Deal the rows by parts of their sequence for the calls without PARTITION BY and WHEN, so that no task has all.

    Returns the looks by call, none if nothing was cut; else the rows have copies of earlier ones, told by
    ``{part}_c``. acc_*, whose sums of doubles depend on their order, and own functions take the sequence whole.
    """
    looks, held = {}, df
    for n, name in found:
        bare = not n.over or (not isinstance(n.over, str) and not n.over.partition and n.over.when is None)
        if n.value in LOOKS and registry.custom(n.value) is None and bare:
            wider, seen = look(held, n, compiler, name)
            if 1 <= seen.step <= FARTHEST:
                held, looks[id(n)] = wider, (n, seen)
    # a plan that may give other rows when it is read again can't be cut
    if not looks or not held._jdf.queryExecution().analyzed().deterministic() or not (at := cuts(df)):
        return df, {}
    reach: dict[str | None, int] = {}
    for n, seen in looks.values():
        for c in [c for _, c in seen.cells] if seen.skip else [None]:
            reach[c] = max(reach.get(c, 0), seen.step)
        if n.value == "had_changed":
            reach.setdefault(None, 1)
    held = in_parts(held, part, at, order, [c for _, seen in looks.values() for _, c in seen.cells], reach, f"{part}_c")
    return held, {k: seen for k, (_, seen) in looks.items()}


def evaluate(df: DataFrame, n: Node, compiler, order: list[str], name: str, parts: tuple[str, Look] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Add the column of one call. Returns the names by suffix; changed_cols has one a source column.

    ``parts``: the column and the look of a call over rows that were ``cut``.
    """
    over = n.over
    keys = [compiler.row(p) for p in over.partition] if over and not isinstance(over, str) else []
    when = compiler.row(over.when) if over and not isinstance(over, str) and over.when is not None else None
    part, flag = f"{name}_k", f"{name}_w"
    df = df.withColumn(part, F.col(parts[0]) if parts else F.struct(*keys) if keys else F.lit(1))
    df = df.withColumn(flag, F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    w = Window.partitionBy(part, flag).orderBy(*order)
    running, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c, skip: F.last(c, True).over(before) if skip else F.lag(c).over(w)
    first = F.row_number().over(w) == 1

    def change(c: Column, skip: bool) -> Column:
        seen = F.last(c, True).over(before) if skip else F.lag(c).over(w)
        differs = c.isNotNull() & ~c.eqNullSafe(seen) if skip else ~c.eqNullSafe(seen)
        # the first row always counts as a change, but no column holds a NULL that changed
        return first | differs if n.value == "had_changed" or not skip else differs

    if parts:
        seen = parts[1]
    elif n.value in LOOKS and registry.custom(n.value) is None:
        df, seen = look(df, n, compiler, name)
    out: dict[str, Column] = {}
    if made := registry.custom(n.value):
        cols = {f"{name}_x{i}": compiler.row(a) for i, a in enumerate(n.args)}
        df, inputs, new = df.withColumns(cols), list(cols), made.build
        schema = T.StructType([*df.schema.fields, T.StructField(f"{name}_p", T._parse_datatype_string(made.returns))])

        def step(pdf, state, last):
            state = state or new()
            cells = [clean(pdf[c]) for c in inputs]
            pdf[f"{name}_p"] = typed([state.apply(*x) for x in zip(*cells, strict=True)] if cells else [state.apply() for _ in range(len(pdf))], schema[-1].dataType)
            return pdf, state

        df = by_key(df, [F.col(part), F.col(flag)], order, schema, step)
        out[""] = F.when(F.col(flag), F.col(f"{name}_p"))
    elif n.value == "lag":
        nulls = "IGNORE NULLS" if seen.skip else "RESPECT NULLS"
        by = ", ".join(f"`{o}`" for o in order)
        got = F.expr(f"lag(`{seen.cells[0][1]}`, {seen.step}) {nulls} OVER (PARTITION BY `{part}`, `{flag}` ORDER BY {by})")
        if len(n.args) > 2 and n.args[2].value is not None:
            got = F.coalesce(got, compiler.row(n.args[2]))
        out[""] = got
    elif n.value == "latest":
        got = F.last(seen.columns[0], True).over(running)
        out[""] = F.coalesce(got, compiler.row(n.args[1])) if len(n.args) > 1 else got
    elif n.value == "changed_col":
        c = seen.columns[0]
        out[""] = F.when(change(c, seen.skip), c)
    elif n.value == "had_changed":
        tests = [change(c, seen.skip) for c in seen.columns]
        got = tests[0]
        for t in tests[1:]:
            got = got | t
        out[""] = got
    elif n.value == "changed_cols":
        prefix = literal(n.args[0])
        for (c, _), col in zip(seen.cells, seen.columns, strict=True):
            out[f"{prefix}{c}"] = F.when(change(col, seen.skip), col)
    else:
        x = compiler.row(n.args[0])
        start = F.coalesce(compiler.row(n.args[1]), F.lit(False)) if len(n.args) > 1 else F.lit(True)
        reset = F.coalesce(compiler.row(n.args[2]), F.lit(False)) if len(n.args) > 2 else F.lit(False)
        df = df.withColumns({f"{name}_x": x, f"{name}_s": start, f"{name}_r": reset})
        df = df.withColumn(f"{name}_e", F.sum(F.col(f"{name}_r").cast("int")).over(running))
        epoch = Window.partitionBy(part, flag, f"{name}_e").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"{name}_on", F.max((F.col(f"{name}_s") & ~F.col(f"{name}_r")).cast("int")).over(epoch))
        live = (F.col(f"{name}_on") == 1) & ~F.col(f"{name}_r")
        v = F.when(live, F.col(f"{name}_x"))
        out[""] = {
            "acc_sum": lambda: F.coalesce(F.sum(D(v)).over(epoch), F.lit(0.0)), "acc_max": lambda: F.max(D(v)).over(epoch), "acc_min": lambda: F.min(D(v)).over(epoch),
            "acc_count": lambda: F.count(v).over(epoch), "acc_avg": lambda: F.avg(D(v)).over(epoch),
        }[n.value]()
    names = {k: f"{name}_{k or 'v'}" for k in out}
    df = df.withColumns({names[k]: c for k, c in out.items()})
    if when is not None:
        # rows outside WHEN repeat the last result of the partition, a NULL result too
        fill = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        for c in names.values():
            df = df.withColumn(c, F.last(F.when(F.col(flag), F.struct(F.col(c).alias("v"))), True).over(fill)["v"])
    return df, names


class Applied:
    """A user's stateful function."""

    def __init__(self, cls):
        self.made = cls()

    def __call__(self, *values):
        return (self.made.apply(*values),)


class Lag:
    def __init__(self, step: int, skip: bool, default: bool):
        self.step, self.skip, self.default, self.held = step, skip, default, []

    def __call__(self, x, default=None):
        got = self.held[-self.step] if len(self.held) >= self.step else None
        if x is not None or not self.skip:
            self.held = [*self.held, x][-self.step :]
        return (default if got is None and self.default else got,)


class Latest:
    held = None

    def __call__(self, x, default=None):
        self.held = self.held if x is None else x
        return (default if self.held is None else self.held,)


class Changes:
    """changed_col, changed_cols and had_changed: which values differ from the last one kept."""

    def __init__(self, skip: bool, flag: bool):
        self.skip, self.flag, self.held, self.first = skip, flag, None, True

    def __call__(self, *values):
        held = self.held if self.held is not None else [None] * len(values)
        if self.skip:
            moved = [v is not None and v != h for v, h in zip(values, held, strict=True)]
            self.held = [h if v is None else v for v, h in zip(values, held, strict=True)]
        else:
            moved = [self.first or v != h for v, h in zip(values, held, strict=True)]
            self.held = list(values)
        first, self.first = self.first, False
        return (first or any(moved),) if self.flag else tuple(v if m else None for v, m in zip(values, moved, strict=True))


class Accumulator:
    """acc_*: over the rows since the last reset, from the first start on."""

    def __init__(self, name: str):
        self.name = name
        self.clear()

    def clear(self) -> None:
        self.on, self.n, self.total, self.low, self.high = False, 0, 0.0, None, None

    def __call__(self, raw, number, start, reset):
        if reset:
            self.clear()
        else:
            self.on = self.on or bool(start)
            if self.on and raw is not None:
                self.n += self.name == "acc_count" or number is not None
                if number is not None:
                    self.total += number
                    self.low = number if self.low is None else min(self.low, number)
                    self.high = number if self.high is None else max(self.high, number)
        value = {"acc_sum": self.total, "acc_count": self.n, "acc_min": self.low, "acc_max": self.high}
        return (value[self.name] if self.name in value else self.total / self.n if self.n else None,)


def streamed(df: DataFrame, found: list[Node], compiler, order: list[str], name: str) -> tuple[DataFrame, list[dict[str, str]]]:
    """The calls ``found`` over a stream, whose state Spark keeps for each partition; the same results as ``evaluate``.

    All calls of a query have one PARTITION BY. A micro-batch's rows of a partition are taken in order.
    """
    from ..streaming.state import stateful

    if any(not same_partition(found[0], n) for n in found):
        raise SqlError("streaming", "stateful functions of a streaming query need one and the same PARTITION BY", *found[0].at)
    keys = [compiler.row(p) for p in found[0].over.partition] if found[0].over and not isinstance(found[0].over, str) else []
    source = list(df.columns)
    columns, makers, args, gates, names, kinds = {}, [], [], [], [], []
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(c: Column) -> str:
        columns[f"{name}_{len(columns)}"] = c
        return f"{name}_{len(columns) - 1}"

    def sources(nodes: list[Node]) -> list[tuple[str, Column]]:
        if any(a.kind == "star" for a in nodes):
            return [(c, F.col(f"`{c}`")) for c in compiler.df.columns]
        return [(str(a.value[-1]) if a.kind == "col" else f"c{i}", compiler.row(a)) for i, a in enumerate(nodes)]

    for k, n in enumerate(found):
        when = n.over.when if n.over and not isinstance(n.over, str) else None
        gates.append(column(F.coalesce(compiler.row(when), F.lit(False))) if when is not None else None)
        if n.value == "lag":
            more = len(n.args) > 2 and n.args[2].value is not None
            step = int(literal(n.args[1], 1)) if len(n.args) > 1 else 1
            skip = bool(literal(n.args[3])) if len(n.args) > 3 else True
            makers.append(lambda step=step, skip=skip, more=more: Lag(step, skip, more))
            args.append([column(compiler.row(n.args[0])), *([column(compiler.row(n.args[2]))] if more else [])])
            outs = [("", args[-1][0])]
        elif n.value == "latest":
            makers.append(Latest)
            args.append([column(compiler.row(a)) for a in n.args])
            outs = [("", args[-1][0])]
        elif n.value in ("changed_col", "changed_cols", "had_changed"):
            at = 1 if n.value == "changed_cols" else 0
            prefix = literal(n.args[0]) if at else ""
            skip = bool(literal(n.args[at]))
            cols = sources(n.args[at + 1 :])
            makers.append(lambda skip=skip, flag=n.value == "had_changed": Changes(skip, flag))
            args.append([column(c) for _, c in cols])
            outs = [("", "boolean")] if n.value == "had_changed" else [("" if n.value == "changed_col" else f"{prefix}{c}", a) for (c, _), a in zip(cols, args[-1], strict=True)]
        elif made := registry.custom(n.value):
            makers.append(lambda cls=made.build: Applied(cls))
            args.append([column(compiler.row(a)) for a in n.args])
            outs = [("", made.returns)]
        else:
            x = compiler.row(n.args[0])
            rest = [F.coalesce(compiler.row(n.args[i]), F.lit(False)) if len(n.args) > i else F.lit(i == 1) for i in (1, 2)]
            makers.append(lambda kind=n.value: Accumulator(kind))
            args.append([column(c) for c in (x, D(x), *rest)])
            outs = [("", "bigint" if n.value == "acc_count" else "double")]
        names.append({suffix: f"{name}_r{k}_{suffix or 'v'}" for suffix, _ in outs})
        kinds.append([kind for _, kind in outs])
    df = df.withColumns({**columns, "_keys": F.struct(*keys) if keys else F.lit(1)})
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([f for f in df.schema.fields if f.name in source])
    for made, kind in zip(names, kinds, strict=True):
        for out, k in zip(made.values(), kind, strict=True):
            schema.add(T.StructField(out, types[k] if k in types else T._parse_datatype_string(k)))
    by, inputs = [o for o in order if o in source], list(columns)

    def fold(pdf, held):
        pdf = pdf.sort_values(by, kind="stable").reset_index(drop=True)
        machines, last = held or ([m() for m in makers], [None] * len(makers))
        cells = {c: clean(pdf[c]) for c in inputs}
        for k, machine in enumerate(machines):
            out = []
            for i in range(len(pdf)):
                if gates[k] is None or cells[gates[k]][i]:
                    last[k] = machine(*(cells[a][i] for a in args[k]))
                out.append(last[k] if last[k] is not None else (None,) * len(names[k]))
            for j, c in enumerate(names[k].values()):
                pdf[c] = typed([r[j] for r in out], schema[c].dataType)
        return pdf[[f.name for f in schema.fields]], (machines, last)

    return stateful(df, schema, fold), names


def same_partition(a: Node, b: Node) -> bool:
    from .compile import same

    of = lambda n: n.over.partition if n.over and not isinstance(n.over, str) else []
    return same(of(a), of(b))


def clean(column) -> list:
    """A pandas column as a list, with None for every kind of missing value."""
    import pandas as pd

    return [None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x for x in column.tolist()]


def typed(values: list, kind):
    """A list as a pandas column that Arrow takes for ``kind``, None allowed."""
    import pandas as pd

    if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return pd.array(values, dtype="Int64")
    return pd.Series(values, dtype="boolean" if isinstance(kind, T.BooleanType) else "float64" if isinstance(kind, T.DoubleType | T.FloatType) else "object")

"""The engine: register views, compile query text to a DataFrame or start it as a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import registry
from .operators import analytic, cep, ordered, windows
from .operators.compile import Compiler, calls, check, same
from .plans.errors import SqlError, near
from .plans.parser import Node, Query, parse

#: A lookup table of up to so many bytes, by its plan's estimate, is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


@dataclass
class View:
    df: DataFrame
    order: list[str] = field(default_factory=list)


def default_name(n: Node, i: int) -> str:
    if n.kind == "col":
        return str(n.value[-1] if not isinstance(n.value[-1], tuple) else n.value[-1][1])
    return n.value if n.kind == "call" else f"expr_{i}"


class Engine:
    """``order`` of a view is how its rows arrive: the columns that sort them, the last one unique."""

    def __init__(self, spark: SparkSession):
        self.spark, self.views = spark, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def register(self, name: str, df: DataFrame, order: list[str] | None = None) -> Engine:
        self.views[name.lower()] = View(df, order or [c for c in ("ts", "event_id") if c in df.columns] or df.columns[:1])
        return self

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> Engine:
        """Replace the rows of a lookup table that share a key with ``rows``."""
        old = self.views[name.lower()]
        kept = old.df.join(rows.select(*key), key, "left_anti")
        return self.register(name, kept.unionByName(rows), old.order)

    def view(self, name: str) -> View:
        if name.lower() in self.views:
            return self.views[name.lower()]
        if self.spark.catalog.tableExists(name):
            return self.register(name, self.spark.table(name)).views[name.lower()]
        raise SqlError("semantic", f"unknown table {name}", hint=near(name, self.views))

    def sql(self, text: str) -> DataFrame:
        return Plan(self, parse(text)).run()

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().toString()


class Plan:
    """One query: enrich, filter, then a direct, windowed or pattern path."""

    def __init__(self, engine: Engine, q: Query, streaming: bool = False):
        self.engine, self.q, self.streaming = engine, q, streaming
        base = engine.view(q.table)
        self.df, self.order = base.df, base.order
        for e in (*[x for x, _ in q.items], q.where, q.having, *q.group):
            if e is not None and q.match is None:
                check(e)
        if q.where is not None and any(calls(q.where, "aggregate")):
            raise SqlError("semantic", "aggregates aren't allowed in WHERE")
        self.qualifiers = {q.alias or q.table: {c: c for c in self.df.columns}}
        self.hidden, self.cut = 0, None

    @property
    def kind(self) -> str:
        if self.q.match is not None:
            return "cep"
        aggregates = any(any(calls(e, "aggregate")) for e, _ in self.q.items) or self.q.window or self.q.group
        return "window" if aggregates else "direct"

    def compiler(self, df: DataFrame | None = None) -> Compiler:
        df = self.df if df is None else df
        order = [c for c in self.order if c in df.columns]
        return Compiler(df, F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.lit(1), self.qualifiers)

    def run(self) -> DataFrame:
        for join in self.q.joins:
            self.enrich(*join)
        if self.q.match is not None:
            return self.patterns()
        return self.windowed() if self.kind == "window" else self.direct()

    def enrich(self, how: str, table: str, alias: str, on: Node) -> None:
        """An equi-join with at most one match: the last row of a key in the table's order; NULL meets NULL."""
        view = self.engine.view(table)
        keys, stack = [], [on]
        while stack:
            n = stack.pop()
            if n.kind == "bin" and n.value == "and":
                stack += reversed(n.args)
            elif n.kind == "bin" and n.value == "=":
                sides = {(x.value[0] == alias and len(x.value) > 1): x for x in n.args if x.kind == "col"}
                if set(sides) != {True, False}:
                    raise SqlError("semantic", f"ON compares the stream with {alias}", *n.at)
                keys.append((sides[False], sides[True].value[1]))
            else:
                raise SqlError("semantic", "ON takes equalities joined by AND", *n.at)
        order = [F.col(f"`{c}`").desc_nulls_last() for c in view.order if c not in [k for _, k in keys]]
        # a table whose order is its key has no last row: the greatest by all its columns, so that reruns agree
        order = order or [F.to_json(F.struct(*[F.col(f"`{c}`") for c in view.df.columns])).desc()]
        last = F.row_number().over(W.partitionBy(*[k for _, k in keys]).orderBy(*order))
        right = view.df.withColumn("_rn", last).filter("_rn = 1").drop("_rn")
        renamed = {c: f"{alias}__{c}" if c in self.df.columns else c for c in right.columns}
        right = right.select(*[F.col(f"`{c}`").alias(new) for c, new in renamed.items()])
        size = int(str(view.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        right = F.broadcast(right) if size <= BROADCAST_BYTES else right
        left = self.compiler()
        test = None
        for mine, theirs in keys:
            t = left(mine).eqNullSafe(right[renamed[theirs]])
            test = t if test is None else test & t
        self.df = self.df.join(right, test, how)
        self.qualifiers = {**self.qualifiers, alias: renamed}

    # direct
    def analytics(self, df: DataFrame, nodes: list[Node], c: Compiler) -> DataFrame:
        if df.isStreaming:
            found = [x for n in nodes for x in calls(n, "analytic") if not any(s is x for s, _ in c.special)]
            if found:
                df, all_names = analytic.streamed(df, found, c, self.order, "_a")
                for call, names in zip(found, all_names, strict=True):
                    if call.value == "changed_cols":
                        self.spread[id(call)] = names
                    else:
                        c.special.append((call, F.col(f"`{names['']}`")))
            return df
        fresh = []
        for call in [x for n in nodes for x in calls(n, "analytic")]:
            if not any(s is call for s, _ in c.special):
                self.hidden += 1
                fresh.append((call, f"_a{self.hidden}"))
        order, part = [o for o in self.order if o in df.columns], f"_p{self.hidden}"
        df, looks = analytic.cut(df, fresh, c, order, part, self.cuts)
        for cut in (True, False):
            for call, name in fresh:
                if (id(call) in looks) != cut:
                    continue
                df, names = analytic.evaluate(df, call, c, order, name, (part, looks[id(call)]) if cut else None)
                if call.value == "changed_cols":
                    self.spread[id(call)] = names
                else:
                    c.special.append((call, F.col(f"`{names['']}`")))
            if cut and looks:
                df = df.filter(~F.col(f"{part}_c"))
        return df

    def cuts(self, df: DataFrame) -> list[Column]:
        """Where the sequence of all rows is cut, found once a query; results of windows aren't computed for it and stay whole."""
        if self.kind == "direct" and self.cut is None:
            self.cut = ordered.cuts(df, [o for o in self.order if o in df.columns])
        return self.cut or []

    def direct(self) -> DataFrame:
        q, self.spread = self.q, {}
        c = self.compiler()
        df = self.df
        if q.where is not None and any(calls(q.where, "analytic")):
            df = self.analytics(df, [q.where, *[e for e, _ in q.items]], c)
            df = df.filter(c(q.where))
        else:
            df = df.filter(c(q.where)) if q.where is not None else df
            df = self.analytics(df, [e for e, _ in q.items], c)
        out, names = self.projected(c)
        exploded = [i for i, (e, _) in enumerate(q.items) if e.kind == "call" and e.value == "unnest"]
        df = df.select(*out)
        for i in exploded:
            df = self.unnest(df, names[i])
        changes = [e for e, _ in q.items if e.kind == "call" and e.value in ("changed_col", "changed_cols")]
        if changes and len(changes) == len(q.items):
            some = F.lit(False)
            for col in df.columns:
                some = some | F.col(f"`{col}`").isNotNull()
            df = df.filter(some)
        return self.ordered(df)

    def unnest(self, df: DataFrame, name: str) -> DataFrame:
        """A row an element; objects spread their fields. A NULL or empty array gives no row."""
        from pyspark.sql import types as T

        element = df.schema[name].dataType.elementType
        rest = [c for c in df.columns if c != name]
        df = df.withColumn(name, F.explode(F.col(f"`{name}`")))
        return df.select(*rest, f"`{name}`.*") if isinstance(element, T.StructType) else df

    def projected(self, c: Compiler) -> tuple[list[Column], list[str]]:
        out, names = [], []
        for i, (e, alias) in enumerate(self.q.items):
            if e.kind == "star":
                scope = self.qualifiers[e.value] if e.value else {x: x for x in c.df.columns}
                cols = [F.col(f"`{v}`").alias(k) for k, v in scope.items() if not v.startswith("_")]
                out += cols
                names += list(scope)
            elif e.kind == "call" and e.value == "changed_cols":
                for k, v in self.spread[id(e)].items():
                    out.append(F.col(f"`{v}`").alias(k))
                    names.append(k)
            else:
                name = alias or default_name(e, i)
                col = c(e.args[0]) if e.kind == "call" and e.value == "unnest" else c(e)
                out.append(col.alias(name))
                names.append(name)
        if len(set(names)) != len(names):
            raise SqlError("semantic", f"output column {next(n for n in names if names.count(n) > 1)} appears twice", hint="use AS")
        return out, names

    def ordered(self, df: DataFrame, batch: list[str] | None = None) -> DataFrame:
        """DISTINCT, ORDER BY and LIMIT, within each window's result if there is a window; windows come in order.

        On the direct path of a stream, DISTINCT and LIMIT count over the whole stream, and a
        micro-batch is ordered when it is delivered.
        """
        q = self.q
        for name, _ in q.order:
            if name not in df.columns:
                raise SqlError("semantic", f"ORDER BY names {name}, which isn't an output column", hint=near(name, df.columns))
        by = [F.col(f"`{n}`").desc() if d else F.col(f"`{n}`").asc() for n, d in q.order]
        if q.distinct:
            df = df.dropDuplicates()
        if batch and q.limit is not None:
            shown = [c for c in df.columns if c not in batch]
            w = W.partitionBy(*batch).orderBy(*(by or [F.col(f"`{c}`") for c in shown]))
            df = df.withColumn("_top", F.row_number().over(w)).filter(F.col("_top") <= q.limit).drop("_top")
        if by and not df.isStreaming:
            df = df.orderBy(*(batch or []), *by)
        if q.limit is not None and not batch:
            df = df.limit(q.limit)
        return df

    # windows
    def windowed(self) -> DataFrame:
        out, batch = self.aggregated(*self.assigned())
        return self.ordered(out, batch).drop(*batch)

    def option(self, name: str) -> float:
        return windows.seconds(self.q.options.get(name, "0s"))

    def assigned(self) -> tuple[DataFrame, list, list[Column]]:
        """(rows with what marks their window, the groups and their names, Columns of the window to group by).

        On a stream, counting and trigger windows, and windows with ALLOWEDLATENESS, are state operators that
        hand on the rows of finished windows: ``released`` is set, and each micro-batch is grouped on its own.
        """
        q = self.q
        df, w, late, self.released = self.df, q.window, 0.0, False
        c = self.compiler()
        df = df.filter(c(q.where)) if q.where is not None else df
        timed = w is not None and w.kind in ("tumbling", "sliding", "session")
        if timed:
            stamp = q.options.get("TIMESTAMP")
            if stamp is not None and stamp not in df.columns:
                raise SqlError("semantic", f"TIMESTAMP names {stamp}, which isn't a column", hint=near(stamp, df.columns))
            df = windows.time_column(df, stamp, q.options.get("TIMEUNIT")) if stamp else df.withColumn("_time", F.current_timestamp())
            if self.streaming:
                ooo, late = self.option("MAXOUTOFORDERNESS"), self.option("ALLOWEDLATENESS")
                # a clock that runs far ahead must not close everyone's windows
                df = df.filter(F.unix_micros("_time") <= F.unix_micros(F.current_timestamp()) + int((ooo + 86_400) * 1_000_000))
                df = windows.idle(df, self.option("IDLETIMEOUT")) if stamp and "IDLETIMEOUT" in q.options else df
                df = df.withWatermark("_time", f"{int((ooo + late) * 1000)} milliseconds")
                df = windows.beating(df)
        elif w is not None and w.kind == "counting" and "TIMESTAMP" in q.options:
            raise SqlError("semantic", "a counting window takes no event time")
        groups = [(g, default_name(g, i)) for i, g in enumerate(q.group)]
        for i, (g, _) in enumerate(groups):
            named = next((a for e, a in q.items if a and same(e, g)), None)
            groups[i] = (g, named or groups[i][1])
        c = self.compiler(df)
        keys = [c.row(g) for g, _ in groups]
        order = [o for o in self.order if o in df.columns]
        if self.streaming and w is not None and (w.kind in ("counting", "global") or late):
            from .streaming import state

            self.released = True
            if w.kind == "counting":
                return state.counted(df, keys, order, int(float(w.args[0])), self.option("STATETTL")), groups, [F.col("_bucket")]
            if w.kind == "global":
                df, _, fold = windows.trigger_columns(df, w, keys, c)
                return state.triggered(df, order, fold, self.option("STATETTL")), groups, [F.col("_bucket")]
            return state.fired(df, w, keys, late, state.spans_of(w, [windows.seconds(a) for a in w.args])), groups, [F.col("_window")]
        if w is not None and w.kind == "global":
            return windows.global_windows(df, w, keys, c, order), groups, [F.col("_bucket")]
        if w is not None:
            df, extra = windows.assign(df, w, keys, order, self.streaming)
            return df, groups, extra
        return df, groups, []

    def aggregated(self, df: DataFrame, groups: list, extra: list[Column]) -> tuple[DataFrame, list[str]]:
        """(the result with the columns of its windows, those columns)."""
        q, w, self.spread = self.q, self.q.window, {}
        c = self.compiler(df)
        c.grouped = True
        c.keys = [(g, F.col(f"`{n}`")) for g, n in groups]
        inner = [c.row(g).alias(n) for g, n in groups]
        over_results = [n for e, _ in q.items for n in calls(e, "analytic")]
        bounds = w is not None and w.kind in ("tumbling", "sliding", "session")
        ends = {"window_start": "start", "window_end": "end", "window_id": "id"}
        nanos = lambda x: F.unix_micros(x) * 1000
        items, later = [], []
        for i, (e, alias) in enumerate(q.items):
            name = alias or default_name(e, i)
            if e.kind == "call" and e.value in ends:
                lo, hi = (F.col("_window.start"), F.col("_window.end")) if bounds else (F.min(self._arrival()), F.max(self._arrival()))
                value = {"start": lambda lo=lo, hi=hi: nanos(lo), "end": lambda lo=lo, hi=hi: nanos(hi), "id": lambda lo=lo, hi=hi: F.concat_ws("_", nanos(lo), nanos(hi))}[ends[e.value]]()
                if bounds:
                    later.append((name, value))
                    continue
                items.append(value.alias(name))
            elif any(calls(e, "analytic")):
                later.append((name, e))
                continue
            elif any(same(g, e) for g, _ in groups):
                later.append((name, F.col(f"`{next(n for g, n in groups if same(g, e))}`")))
                continue
            else:
                items.append(c(e).alias(name))
            later.append((name, F.col(f"`{name}`")))
        hidden = []
        if q.having is not None:
            aliases = {a: F.col(f"`{a}`") for _, a in q.items if a}
            for n in calls(q.having, "aggregate"):
                hidden.append((n, f"_h{len(hidden)}"))
                items.append(c(n).alias(hidden[-1][1]))
        analytic_args = []
        for call in over_results:
            for n in calls(call, "aggregate"):
                analytic_args.append((n, f"_n{len(analytic_args)}"))
                items.append(c(n).alias(analytic_args[-1][1]))
        grouped = df.groupBy(*inner, *extra)
        out = grouped.agg(*(items or [F.count(F.lit(1)).alias("_rows")]))
        if q.having is not None:
            h = Compiler(out, F.lit(1))
            h.special = [(n, F.col(f"`{x}`")) for n, x in hidden]
            h.keys = [(Node("col", [a]), col) for a, col in aliases.items()] + [(g, F.col(f"`{n}`")) for g, n in groups]
            out = out.filter(h(q.having))
        if over_results and df.isStreaming:
            raise SqlError("streaming", "stateful functions over window results run on bounded input only")
        if over_results:
            a = Compiler(out, F.lit(1))
            a.special = [(n, F.col(f"`{x}`")) for n, x in analytic_args]
            a.keys = [(g, F.col(f"`{n}`")) for g, n in groups]
            spot = out.withColumn("_at", F.unix_micros("_window.start") if bounds else F.col("_bucket") if extra else F.lit(0))
            a.df, held, self.order = spot, self.order, ["_at"]
            for call in over_results:
                if call.over is None:
                    from .plans.parser import Over

                    call.over = Over([g for g, _ in groups])
            a.types = {f.name: f.dataType for f in spot.schema.fields}
            out = self.analytics(spot, [e for _, e in later if isinstance(e, Node)], a)
            self.order = held
            later = [(n, a(e) if isinstance(e, Node) else e) for n, e in later]
        batch = (["_window"] if bounds else ["_bucket"]) if extra else []
        return out.select(*[e.alias(n) for n, e in later], *[F.col(b) for b in batch]), batch

    def _arrival(self) -> Column:
        return F.col(f"`{self.order[0]}`").cast("timestamp")

    # patterns
    def patterns(self) -> DataFrame:
        q = self.q
        if q.group or q.having is not None:
            raise SqlError("semantic", "MATCH_RECOGNIZE can't be grouped")
        c = self.compiler()
        df = self.df.filter(c(q.where)) if q.where is not None else self.df
        if self.streaming:
            from .streaming import state

            out = state.recognized(cep.Recognizer(df, q.match, self.compiler(df), self.order), self.option("STATETTL"))
        else:
            out = cep.recognize(df, q.match, self.compiler(df), self.order)
        self.df, self.qualifiers = out, {q.table: {x: x for x in out.columns}}
        self.spread = {}
        c = self.compiler(out)
        return self.ordered(out.select(*self.projected(c)[0]))


def register_function(name: str, build, least: int = 1, most: int | None = 1, kind: str = "scalar") -> None:
    registry.register(name, build, least, most, kind)

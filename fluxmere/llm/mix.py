"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import fresh, listed, small_batches, stored, weighted_cuts

WORD = "[^ \\t-\\r]+"
BITS, TEXT_BITS = 60, 40
BROADCAST = 100_000  # cells up to which their table is broadcast
NEAR = 2000  # a source may miss its target by one part in so many


def quotas(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """``share`` of all sizes by weight; none above ``cap`` times its source, the excess reshared."""
    total, out, active = share * sum(sizes.values()), {}, dict(weights)
    while active:
        rest, w = total - sum(out.values()), sum(active.values())
        over = [s for s in active if rest * active[s] / w > cap * sizes[s]]
        if not over:
            out |= {s: rest * x / w for s, x in active.items()}
            break
        for s in over:
            out[s] = cap * sizes[s]
            del active[s]
    return {s: float(out[s]) for s in weights}


def min_cost_flow(supply: dict, members: dict, quota: dict, repeats: int, caps: dict | None = None, base: dict | None = None) -> dict:
    """{(pattern, source): words}: cheapest paths level by level, pass r over a pattern's words costs r a word.

    ``caps`` bounds what one edge carries, ``base`` is what a pattern's words cost on top. Costs rise
    with each pass, so a pattern's words are all used once before any is repeated, in whichever of its
    sources. What patterns can route together is a polymatroid, so filling the cost levels in order,
    each by augmenting paths, is optimal. Paths are searched over sources: ``via`` holds, for two of
    them, the patterns that can move words from one to the other, so a search doesn't grow with the patterns.
    """
    caps, base = caps or {}, base or {}
    left, flow, used = dict(quota), {}, dict.fromkeys(supply, 0.0)
    dead: set = set()  # sources from which none with an open quota is reached; none comes back to life
    via: dict = {s: {} for s in quota}
    room = lambda p, s: caps.get((p, s), float("inf")) - flow.get((p, s), 0.0)

    def move(p, s, words: float) -> None:
        flow[(p, s)] = flow.get((p, s), 0.0) + words
        out, into = flow[(p, s)] > 1e-9, room(p, s) > 1e-9
        for t in members[p]:
            if t != s:
                for a, b, ok in ((s, t, out and room(p, t) > 1e-9), (t, s, into and flow.get((p, t), 0.0) > 1e-9)):
                    if ok:
                        via[a].setdefault(b, {})[p] = None
                    elif p in via[a].get(b, ()):
                        del via[a][b][p]

    starts = sorted(supply, key=str)
    for level in range(1, repeats + max(base.values(), default=0) + 1):
        for start in starts:
            passes = min(repeats, level - base.get(start, 0))
            while supply[start] * passes - used[start] > 1e-9:
                # breadth first: from the pattern over its sources; on over flow already placed
                came, end = {s: None for s in members[start] if s not in dead and room(start, s) > 1e-9}, []
                queue = deque(came)
                while queue:
                    x = queue.popleft()
                    if left.get(x, 0.0) > 1e-9:
                        end = [x]  # a source may be null
                        break
                    for t, ps in via[x].items():
                        if ps and t not in came and t not in dead:
                            came[t] = (x, next(iter(ps)))
                            queue.append(t)
                if not end:
                    dead.update(came)
                    break
                (last,), path = end, []
                x = last
                while came[x] is not None:
                    path.append((came[x][1], came[x][0], x))
                    x = came[x][0]
                amount = min(supply[start] * passes - used[start], left[last], room(start, x), *[min(flow[(p, a)], room(p, b)) for p, a, b in path])
                move(start, x, amount)
                for p, a, b in path:
                    move(p, a, -amount)
                    move(p, b, amount)
                left[last] -= amount
                used[start] += amount
    return flow


def pattern_of(sources: Column) -> Column:
    """A number for a set of sources, a null source among them."""
    return F.xxhash64(F.array_sort(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n")))))


def repeated(slim: DataFrame) -> DataFrame:
    """(h, held) of texts that stand in several rows: their sources, each with its least doc_id."""
    per = slim.filter("h IS NOT NULL").groupBy("h", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    held = per.groupBy("h").agg(F.collect_list(F.struct("source", "first")).alias("held"), F.sum("n").alias("n"))
    return stored(held.filter("n > 1").select("h", "held"), "mix-repeated")


def located(df: DataFrame, held: DataFrame, doc_id: str, source: str, h: str, out: list[str]) -> DataFrame:
    """Add a row's membership pattern, its class (0: first of its text in its source, 1: a further copy), and seeded place."""
    pattern, copy, key = out
    k, inside = fresh(df, "_h", "_held")
    joined = df.join(held.select(F.col("h").alias(k), F.col("held").alias(inside)), F.col(h) == F.col(k), "left")
    mine = F.filter(inside, lambda x: x["source"].eqNullSafe(F.col(source)))
    sources = F.coalesce(F.transform(inside, lambda x: x["source"]), F.array(F.col(source)))
    first = F.col(inside).isNull() | F.col(doc_id).eqNullSafe(F.get(mine, F.lit(0))["first"])
    place = F.shiftleft(F.pmod(F.xxhash64(h, F.lit(SEED)), F.lit(1 << TEXT_BITS)), BITS - TEXT_BITS) + F.pmod(F.xxhash64(doc_id, source, F.lit(SEED)), F.lit(1 << (BITS - TEXT_BITS)))
    return joined.withColumns({pattern: pattern_of(sources), copy: F.when(first, 0).otherwise(1), key: place}).drop(k, inside)


SEED = 20240229


class Mix:
    """A planned mix: which of a table's rows each source takes, and how often.

    Sources overlap where one text stands in several: a text's membership pattern is the set of
    sources it is found in. A pattern's words cost 1 a word the first time they are taken, for any of
    its sources, 2 the second time and so on; further copies of a text within one source cost a pass
    more. Min-cost flow routes each pattern's words to the quotas of its sources, so a text isn't taken
    from two of them while words not yet taken are left; no row is taken over ``cap`` times. Within
    each (pattern, source), rows stand on a circle by a seeded hash, equal texts of all sources at
    one place. Sources begin one behind the other and take their rows onwards; ends are found by
    histogram refinement down to one row, and what a row too large for the rest leaves open is
    filled with whole cells and then rows that fit, until the source is within 1/2000 of its target or none fits.

    The driver plans sources and patterns, all that occur, never rows. A pattern that only one text
    has is as large on the driver as any other. Same rows, same
    result. Equal rows (doc_id, source and text) stand at one place and are taken alike. A row of
    size 0 is taken as its place says.
    """

    def __init__(self, slim: DataFrame, share: float, cap: int, weights: tuple):
        """``slim``: doc_id, source, size, h (a hash of the text, null if there is none)."""
        self.cap, self.spark = cap, slim.sparkSession
        slim = stored(slim.select("doc_id", "source", "size", "h"), "mix")
        self.held = repeated(slim)
        base = located(slim, self.held, "doc_id", "source", "h", ["pattern", "copy", "key"])
        base = stored(base, "mix-placed")
        sums = base.groupBy("pattern", "copy", "source").agg(F.sum("size").cast("double").alias("w"), F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
        sizes: dict = {}
        for r in sums:
            sizes[r["source"]] = sizes.get(r["source"], 0.0) + (r["w"] or 0.0)
        order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
        self.sizes = sizes
        self.target = quotas(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, cap)
        self.flow(sums)
        self.place(base)

    def flow(self, sums) -> None:
        supply, members, caps, extra = {}, {}, {}, {}
        self.least = {(r["pattern"], r["copy"], r["source"]): r["least"] for r in sums}
        self.words = words = {(r["pattern"], r["copy"], r["source"]): r["w"] or 0.0 for r in sums}
        for (p, c, s), w in sorted(words.items(), key=str):
            supply[(p, c)] = max(supply.get((p, c), 0.0), w) if not c else supply.get((p, c), 0.0) + w
            members.setdefault((p, c), []).append(s)
            caps[((p, c), s)] = self.cap * w
            extra[(p, c)] = c
        single = {(r["pattern"], r["copy"], r["source"]) for r in sums if r["n"] == 1}
        self.open = dict.fromkeys(self.target, 0.0)  # words of a source's flow that no part of a cell can take
        most = max([self.cap * len(m) for m in members.values()], default=1) + 1
        routed = min_cost_flow(supply, members, dict(self.target), most, caps, extra)
        self.cells = []  # (pattern, copy, source, whole passes, start of its circle, rest of its words)
        for (p, c), ss in members.items():
            begin = 0.0
            for s in ss:
                w, f = words[(p, c, s)], routed.get(((p, c), s), 0.0)
                passes = min(self.cap, int(f / w + 1e-9)) if w else 0
                start = int((begin / supply[(p, c)] % 1.0) * (1 << TEXT_BITS)) << (BITS - TEXT_BITS) if not c and supply[(p, c)] else 0
                rest = max(0.0, f - passes * w) if w and passes < self.cap else 0.0
                if (p, c, s) in single:
                    self.open[s] += rest
                    rest = 0.0
                self.cells.append([p, c, s, passes, start, rest])
                begin += f

    def whole(self, short: dict, taken: dict) -> None:
        """Fill what sources are short of by whole cells that fit, those of the least repeated texts first, then the largest."""
        times: dict = {}
        for i, (p, c, _, passes, *_) in enumerate(self.cells):
            times[(p, c)] = times.get((p, c), c) + passes + (i in taken)
        mine: dict = {}
        for i, c in enumerate(self.cells):
            if i not in taken and c[3] < self.cap and 0 < self.words[tuple(c[:3])] <= short[c[2]]:
                mine.setdefault(c[2], []).append(i)
        for s, cells in mine.items():
            heap = [(times[tuple(self.cells[i][:2])], -self.words[tuple(self.cells[i][:3])], i) for i in cells]
            heapify(heap)
            while heap and short[s] >= max(1.0, self.target[s] / NEAR):
                n, w, i = heappop(heap)
                c = self.cells[i]
                if -w > short[s] or c[3] >= self.cap:
                    continue
                if times[tuple(c[:2])] > n:  # another source took it meanwhile
                    heappush(heap, (times[tuple(c[:2])], w, i))
                    continue
                c[3] += 1
                times[tuple(c[:2])] += 1
                short[s] += w
                heappush(heap, (times[tuple(c[:2])], w, i))

    def joined(self, df: DataFrame, pattern: str, copy: str, source: str, ranges: dict | None = None) -> DataFrame:
        """Add _cell, _passes, _start, _source_size, _target and _ranges; the table has a row a cell."""
        rows = [(p, c, s, i, n, a, int(self.sizes[s]), self.target[s], [tuple(map(int, x)) for x in (ranges or {}).get(i, ())]) for i, (p, c, s, n, a, _) in enumerate(self.cells)]
        table = listed(self.spark, rows, "_p long, _c int, _s string, _cell int, _passes int, _start long, _source_size long, _target double, _ranges array<struct<lo:long,hi:long,most:long,layer:long>>")
        test = (F.col(pattern) == F.col("_p")) & (F.col(copy) == F.col("_c")) & F.col(source).eqNullSafe(F.col("_s"))
        return df.join(F.broadcast(table) if len(rows) <= BROADCAST else table, test, "left").drop("_p", "_c", "_s")

    def place(self, base: DataFrame) -> None:
        full = (1 << 62) - 1
        at = self.joined(base, "pattern", "copy", "source").select("_cell", "size", F.pmod(F.col("key") - F.col("_start"), F.lit(1 << BITS)).alias("at"))
        self.ranges: dict = {}
        wanted = {i: c[5] for i, c in enumerate(self.cells) if c[5] > 1e-6}
        short: dict = dict(self.open)
        ends = {}
        for i, (cut, below) in weighted_cuts(at, "_cell", "at", "size", wanted, BITS, dict.fromkeys(wanted, 0.0), near=False).items() if wanted else ():
            self.ranges[i] = [(0, cut, full, 0)]
            ends[i] = cut
            short[self.cells[i][2]] += wanted[i] - below
        self.whole(short, self.ranges)
        # each turn halves what a source is short of, by its largest row that fits or by a run of small ones,
        # cell by cell: first those with most words behind their end
        queue: dict = {}
        for i, c in sorted(enumerate(self.cells), key=lambda x: (-(1 - ends.get(x[0], 0) / (1 << BITS)) * self.words[tuple(x[1][:3])], x[0])):
            if c[3] < self.cap and self.words[tuple(c[:3])]:
                queue.setdefault(c[2], []).append(i)
        window, picked, widths, layers = 4096, {}, {}, {}
        while True:
            live = {}
            for s, cells in queue.items():
                while cells and self.least[tuple(self.cells[cells[0]][:3])] > short[s]:
                    cells.pop(0)  # none of its rows fits, now or later
                while cells and ends.setdefault(cells[0], 0) >= 1 << BITS:
                    # a circle that is used up begins another pass, if its rows may be taken once more
                    layers[cells[0]] = layers.get(cells[0], 0) + 1
                    if self.cells[cells[0]][3] + layers[cells[0]] < self.cap:
                        ends[cells[0]], picked[cells[0]] = 0, set()
                        widths[cells[0]] = 1 << (BITS - 12)
                    else:
                        cells.pop(0)
                if cells and short[s] >= max(1.0, self.target[s] / NEAR):
                    live[cells[0]] = int(short[s])
                    widths.setdefault(cells[0], 1 << (BITS - 12))
                    picked.setdefault(cells[0], set())
                    self.ranges.setdefault(cells[0], [])
            if not live:
                break
            table = listed(self.spark, [(i, x, ends[i], ends[i] + widths[i], sorted(picked[i])) for i, x in live.items()], "_i int, _short long, _from long, _to long, _done array<long>")
            fit = at.join(F.broadcast(table), F.col("_cell") == F.col("_i")).filter((F.col("at") >= F.col("_from")) & (F.col("size") > 0) & (F.col("size") <= F.col("_short")) & ~F.array_contains("_done", F.col("at")))
            # equal rows are taken together, so places are summed
            near = fit.filter(F.col("at") < F.col("_to")).groupBy("_cell", "at", "_short").agg(F.sum("size").alias("w")).filter("w <= _short")
            best = {r["_cell"]: r for r in near.groupBy("_cell").agg(F.count("*").alias("n"), F.sum("w").alias("all"), F.max("w").alias("w"), F.min_by("at", F.struct(-F.col("w"), F.col("at"))).alias("at")).collect()}
            runs = {}
            for i, x in live.items():
                s, b = self.cells[i][2], best.get(i)
                if b is not None and 2 * b["w"] >= x:
                    self.ranges[i].append((b["at"], b["at"] + 1, full, layers.get(i, 0)))
                    picked[i].add(b["at"])
                    short[s] -= float(b["w"])
                elif b is not None and b["all"] >= x:
                    runs[i] = float(x)
                elif widths[i] < 1 << BITS:
                    widths[i] = min(1 << BITS, widths[i] * window)
                elif b is not None:  # all that fit together are less than what is missing
                    runs[i] = float(x)
                else:
                    ends[i] = 1 << BITS
            if runs:
                for i, (cut, below) in weighted_cuts(fit, "_cell", "at", "size", runs, BITS, dict.fromkeys(runs, 0.0), near=False).items():
                    self.ranges[i].append((ends[i], cut, live[i], layers.get(i, 0)))
                    short[self.cells[i][2]] -= below
                    # rows of this run are taken; larger ones before its end stay open to no one
                    ends[i] = cut if below else 1 << BITS

    def takes(self, df: DataFrame, doc_id: str, source: str, size: str, h: str, out: tuple = ("source_size", "target", "takes")) -> DataFrame:
        """Add to any rows of the table their source's size and target, and how often they are taken."""
        pattern, copy, key = fresh(df, "_pattern", "_copy", "_place")
        rows = self.joined(located(df, self.held, doc_id, source, h, [pattern, copy, key]), pattern, copy, source, self.ranges)
        at = F.pmod(F.col(key) - F.col("_start"), F.lit(1 << BITS))
        hits = F.filter("_ranges", lambda x: (x["lo"] <= at) & (at < x["hi"]) & (F.col(size) <= x["most"]))
        again = F.coalesce(F.size(F.array_distinct(F.transform(hits, lambda x: x["layer"]))), F.lit(0))
        rows = rows.withColumns({out[0]: F.col("_source_size"), out[1]: F.col("_target"), out[2]: F.col("_passes") + again})
        return rows.drop(pattern, copy, key, "_cell", "_passes", "_start", "_source_size", "_target", "_ranges")


def counted(text: str) -> dict[str, Column]:
    return {"size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "h": F.when(F.col(text).isNotNull(), F.xxhash64(text, F.lit(1)))}


def plan_mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple = (5, 2, 1), text: str = "text") -> Mix:
    """Plan for ``docs`` (doc_id, source, text): sources by code point, null last, weigh ``weights`` in turn."""
    return Mix(docs.select("doc_id", "source", *[c.alias(n) for n, c in counted(text).items()]), share, cap, weights)


def mix_documents(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple = (5, 2, 1)) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) a row of ``docs``; other columns aren't read."""
    slim = stored(docs.select("doc_id", "source", *[c.alias(n) for n, c in counted("text").items()]), "mix-rows")
    out = Mix(slim, share, cap, weights).takes(slim, "doc_id", "source", "size", "h")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"))


def op7(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; all columns as they were.

    The plan reads ids, sources, sizes and hashes; texts are read once more, to be handed on.
    """
    small_batches(spark)
    plan = plan_mix(docs)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("row"), "doc_id", "source", *[c.alias(n) for n, c in counted("text").items()])
    rows = plan.takes(rows, "doc_id", "source", "size", "h").filter("takes > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("takes")))).select("row.*")

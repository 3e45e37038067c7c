"""Operators whose state Spark keeps for each key of a stream: a fold over a key's rows, and what is built on it."""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "held binary"


def stateful(df: DataFrame, schema, fold, ttl: float = 0.0) -> DataFrame:
    """``fold(rows, held)`` gives (rows out or None, what to hold on to or None) for each ``_keys`` of a micro-batch.

    State is stored with the stream's checkpoint, so a lost executor's keys go on elsewhere. With a
    ``ttl``, a key without rows for so many seconds is forgotten.
    """

    def run(key, parts, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else None
        out, held = fold(pd.concat(list(parts), ignore_index=True), held)
        if held is not None:
            state.update((pickle.dumps(held),))
            if ttl:
                state.setTimeoutDuration(max(1, int(ttl * 1000)))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    return df.groupBy("_keys").applyInPandasWithState(run, schema, STATE, "append", "ProcessingTimeTimeout" if ttl else "NoTimeout")


def counted(df: DataFrame, keys: list[Column], order: list[str], n: int, ttl: float) -> DataFrame:
    """Counting windows: rows of each key in full buckets of ``n``, with their ``_bucket``; a rest is held."""
    df = df.withColumn("_keys", F.struct(*keys) if keys else F.lit(1))
    schema = T.StructType([*df.schema.fields, T.StructField("_bucket", T.LongType())])

    def fold(pdf, held):
        import pandas as pd

        rest, done = held or (None, 0)
        pdf = pdf.sort_values(order, kind="stable")
        rows = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf.reset_index(drop=True)
        full = len(rows) // n
        out = rows.iloc[: full * n].copy()
        out["_bucket"] = done + out.index // n
        return out, (rows.iloc[full * n :], done + full)

    return stateful(df, schema, fold, ttl)


def triggered(df: DataFrame, order: list[str], fold_rows, ttl: float) -> DataFrame:
    """Trigger windows: ``fold_rows(rows, aggregates so far)`` numbers firings; rows since the last one are held."""
    schema = T.StructType([*df.schema.fields, T.StructField("_bucket", T.LongType())])

    def fold(pdf, held):
        import pandas as pd

        rest, done, running = held or (None, 0, None)
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        numbers, running = fold_rows(pdf, running)
        pdf["_bucket"] = [done + k for k in numbers[:-1]]
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        fired = done + numbers[-1]
        return pdf[pdf["_bucket"] < fired], (pdf[pdf["_bucket"] >= fired], fired, running)

    return stateful(df, schema, fold, ttl)


def recognized(r, ttl: float) -> DataFrame:
    """Patterns: a key's rows are held from the first attempt on that later rows may still change."""

    def fold(pdf, held):
        import pandas as pd

        rest, skipped, number = held or (None, 0, 0)
        rows = r.sort(pdf)
        rows = pd.concat([rest, rows], ignore_index=True) if rest is not None else rows
        out, start, number = r.fold(rows, number, skipped, True)
        keep = max(0, start - r.behind)
        return (r.frame(out) if out else None), (rows.iloc[keep:].reset_index(drop=True), start - keep, number)

    return stateful(r.df, r.schema, fold, ttl)


def fired(df: DataFrame, w, keys: list[Column], lateness: float, spans) -> DataFrame:
    """Event-time windows that fire at the watermark and again, whole, with each micro-batch that brings late rows.

    ``df`` has a watermark on ``_time`` that trails by MAXOUTOFORDERNESS and ``lateness``; a window fires
    once the watermark without the lateness has passed its end, and its rows are held until the
    watermark itself has. Rows come out with their ``_window``, all rows of a window at once.
    ``spans(times)`` gives the (start, end) of each time's windows, in microseconds.
    """
    window = T.StructType([T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())])
    df = df.withColumn("_keys", F.struct(*keys) if keys else F.lit(1)).withColumn("_us", F.unix_micros("_time"))
    schema = T.StructType([*df.schema.fields, T.StructField("_lo", T.LongType()), T.StructField("_hi", T.LongType())])
    late = int(lateness * 1000)

    def run(key, parts, state):
        import pandas as pd

        rows, before = pickle.loads(state.get[0]) if state.exists else (None, set())
        new = pd.concat(list(parts), ignore_index=True) if not state.hasTimedOut else None
        mark = state.getCurrentWatermarkMs()
        if new is not None:
            # rows whose windows all lie behind the watermark are too late
            new = new.iloc[sorted({i for _, hi, at in spans(new["_us"].tolist()) if -(-hi // 1000) > mark for i in at})].copy()
            new["_new"] = True
            rows = pd.concat([rows, new], ignore_index=True) if rows is not None and len(rows) else new
        if rows is None or not len(rows):
            if state.exists:
                state.remove()
            return
        held, out, done, wake = [], [], set(), []
        for lo, hi, at in spans(rows["_us"].tolist()):
            part = rows.iloc[at]
            end = -(-hi // 1000)
            if end <= mark:
                part = part[~part["_new"].astype(bool)]
                if not len(part):
                    continue
            if end <= mark + late and (bool(part["_new"].any()) or (lo, hi) not in before):
                whole = part.assign(_lo=lo, _hi=hi)
                out.append(whole)
            if end <= mark + late:
                done.add((lo, hi))
            if end > mark:
                held += at
                wake.append(end if end <= mark + late else max(end - late, mark + 1))
        keep = rows.iloc[sorted(set(held))].copy()
        keep["_new"] = False
        if len(keep):
            state.update((pickle.dumps((keep, done)),))
            state.setTimeoutTimestamp(int(max(min(wake), mark + 1)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.concat(out, ignore_index=True)[[f.name for f in schema.fields]]

    found = df.groupBy("_keys").applyInPandasWithState(run, schema, STATE, "append", "EventTimeTimeout")
    found = found.withColumn("_window", F.struct(F.timestamp_micros("_lo").alias("start"), F.timestamp_micros("_hi").alias("end")).cast(window))
    return found.drop("_lo", "_hi", "_us", "_keys")


def spans_of(w, sizes: list[float]):
    """(start, end, places) of the windows over times in microseconds: tumbling, sliding or session."""
    size = int(sizes[0] * 1_000_000)

    def fixed(slide: int):
        def spans(times: list[int]):
            found: dict = {}
            for i, t in enumerate(times):
                lo = t - t % slide
                while lo > t - size:
                    found.setdefault((lo, lo + size), []).append(i)
                    lo -= slide
            return [(lo, hi, at) for (lo, hi), at in sorted(found.items())]

        return spans

    def sessions(times: list[int]):
        out: list = []
        for i in sorted(range(len(times)), key=times.__getitem__):
            if out and times[i] < out[-1][1]:
                out[-1][1] = max(out[-1][1], times[i] + size)
                out[-1][2].append(i)
            else:
                out.append([times[i], times[i] + size, [i]])
        return out

    if w.kind == "session":
        return sessions
    return fixed(int(sizes[1] * 1_000_000) if w.kind == "sliding" else size)

"""Aggregates: name -> (least arguments, most, builder(args, order) of a Column). Rows come in ``order``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import D, S


def ordered(x: Column, order: Column) -> Column:
    """Non-null values of a group as an array, in order of arrival."""
    pairs = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
    return F.transform(pairs, lambda p: p["x"])


def _percentile(x: Column, p: Column | None, _order) -> Column:
    p = F.lit(0.95) if p is None else p
    values = F.sort_array(F.collect_list(D(x)))
    return F.get(values, F.floor(p * (F.size(values) - 1)).cast("int"))


_zero = lambda c: F.coalesce(c, F.lit(0.0))

AGGREGATES = {
    "sum": (1, 1, lambda a, o: F.sum(D(a[0]))),
    "avg": (1, 1, lambda a, o: F.avg(D(a[0]))),
    "min": (1, 1, lambda a, o: F.min(D(a[0]))),
    "max": (1, 1, lambda a, o: F.max(D(a[0]))),
    "count": (0, 1, lambda a, o: F.count(a[0] if a else F.lit(1))),
    "stddev": (1, 1, lambda a, o: _zero(F.stddev_samp(D(a[0])))),
    "stddevs": (1, 1, lambda a, o: _zero(F.stddev_samp(D(a[0])))),
    "var": (1, 1, lambda a, o: _zero(F.var_pop(D(a[0])))),
    "vars": (1, 1, lambda a, o: _zero(F.var_samp(D(a[0])))),
    "median": (1, 1, lambda a, o: _zero(F.median(D(a[0])))),
    "percentile": (1, 2, lambda a, o: _percentile(a[0], a[1] if len(a) > 1 else None, o)),
    "collect": (1, 1, lambda a, o: ordered(a[0], o)),
    "first_value": (1, 1, lambda a, o: F.min_by(a[0], o)),
    "last_value": (1, 1, lambda a, o: F.max_by(a[0], o)),
    "merge_agg": (1, 1, lambda a, o: F.array_join(ordered(S(a[0]), o), ",")),
    "deduplicate": (1, 1, lambda a, o: F.array_distinct(ordered(a[0], o))),
    "nth_value": (2, 2, lambda a, o: F.try_element_at(ordered(a[0], o), a[1].cast("int"))),
    "expression": (1, 1, lambda a, o: F.max_by(a[0], o)),
}
ANALYTICS = {
    "lag": (1, 4),
    "latest": (1, 2),
    "changed_col": (2, 2),
    "had_changed": (2, None),
    "changed_cols": (3, None),
    "acc_sum": (1, 3),
    "acc_max": (1, 3),
    "acc_min": (1, 3),
    "acc_count": (1, 3),
    "acc_avg": (1, 3),
}

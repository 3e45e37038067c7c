"""All functions by name, and those that users add."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..plans.errors import SqlError, near
from .aggregate import AGGREGATES, ANALYTICS, ordered
from .scalar import CATEGORIES, EACH, SCALARS, TYPED

SPECIAL = {
    "window_start": (0, 0),
    "window_end": (0, 0),
    "window_id": (0, 0),
    "unnest": (1, 1),
    "expr": (1, 1),
    "cast": (2, 2),
    **{k: (1, 1) for k in TYPED},
    **{k: (2, 2) for k in EACH},
}
KINDS = ("scalar", "aggregate", "analytic")


@dataclass(frozen=True)
class Custom:
    """kind: scalar (Columns to Column), aggregate ((args, order) to Column) or analytic (a class with apply)."""

    name: str
    kind: str
    least: int
    most: int | None
    build: Any
    returns: str = ""
    aliases: tuple = ()


_CUSTOM: dict[str, Custom] = {}


def register(name: str, build, least: int = 1, most: int | None = 1, kind: str = "scalar", aliases: tuple = (), returns: str = "") -> None:
    """Add a function, at any time. ``build`` makes Columns; wrap Python code in an Arrow-batched pandas_udf first.

    Names and aliases have no case; none of them may be built in or be another function's.
    """
    if kind not in KINDS:
        raise SqlError("function", f"can't register a function of kind {kind}")
    name, aliases = name.lower(), tuple(a.lower() for a in aliases)
    unregister(name)
    for n in (name, *aliases):
        if n in known():
            raise SqlError("function", f"{n} is {'another function' if n in _CUSTOM else 'built in'}")
    made = Custom(name, kind, least, most, build, returns, aliases)
    _CUSTOM.update(dict.fromkeys((name, *aliases), made))


def register_aggregate(name: str, cls, returns: str, least: int = 1, most: int | None = 1, aliases: tuple = ()) -> None:
    """Add an aggregate in Python: ``cls(*parameters)`` for each group, ``add(value)`` a row in order, ``result()``.

    Arguments but the first are the parameters. A group's values meet in one array.
    """
    from pyspark.sql import functions as F

    def build(args, order):
        @F.pandas_udf(returns)
        def fold(groups, *parameters):
            import pandas as pd

            out = []
            for i, values in enumerate(groups):
                made = cls(*(p.iat[i] for p in parameters))
                for v in values if values is not None else ():
                    made.add(v)
                out.append(made.result())
            return pd.Series(out)

        # a parameter is one value a group: the last row's
        return fold(ordered(args[0], order), *(F.max_by(a, order) for a in args[1:]))

    register(name, build, least, most, "aggregate", aliases, returns)


def register_analytic(name: str, cls, returns: str, least: int = 1, most: int | None = 1, aliases: tuple = ()) -> None:
    """Add a stateful function: ``cls()`` for each partition, ``apply(*arguments)`` a row in order gives the row's result."""
    register(name, cls, least, most, "analytic", aliases, returns)


def unregister(name: str) -> bool:
    made = _CUSTOM.get(name.lower())
    for n in (made.name, *made.aliases) if made else ():
        del _CUSTOM[n]
    return made is not None


def custom(name: str) -> Custom | None:
    return _CUSTOM.get(name.lower())


def known() -> set[str]:
    return {*SCALARS, *AGGREGATES, *ANALYTICS, *SPECIAL, *_CUSTOM}


def listed(category: str | None = None) -> list[str]:
    """Names of all functions, or of one category: those of CATEGORIES, aggregate, analytic, special, custom."""
    groups = {**{k: set(v) for k, v in CATEGORIES.items()}, "aggregate": set(AGGREGATES), "analytic": set(ANALYTICS), "special": set(SPECIAL), "custom": set(_CUSTOM)}
    if category is not None and category not in groups:
        raise SqlError("function", f"unknown category {category}", hint=near(category, groups))
    return sorted(known() if category is None else groups[category])


def kind(name: str) -> str:
    if name in _CUSTOM:
        return _CUSTOM[name].kind
    return "aggregate" if name in AGGREGATES else "analytic" if name in ANALYTICS else "special" if name in SPECIAL else "scalar"


def lookup(name: str, n: int, at: tuple = (0, 0)):
    """The builder of ``name`` for ``n`` arguments, or an error with a hint."""
    if name not in known():
        raise SqlError("function", f"unknown function {name}", *at, hint=near(name, known()))
    if name in _CUSTOM:
        least, most, build = _CUSTOM[name].least, _CUSTOM[name].most, _CUSTOM[name].build
    elif name in SCALARS:
        least, most, build = SCALARS[name]
    elif name in AGGREGATES:
        least, most, build = AGGREGATES[name]
    else:
        (least, most), build = (ANALYTICS | SPECIAL)[name], None
    if n < least or (most is not None and n > most):
        raise SqlError("function", f"{name} takes {least}{'' if most == least else ' to ' + str(most) if most else ' or more'} arguments, not {n}", *at)
    return build

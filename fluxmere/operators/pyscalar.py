"""Scalar functions of the dialect in Python, for the folds that can't be Columns. None in gives None out; errors are the caller's."""

from __future__ import annotations

import math
import re


def text(x) -> str:
    """Text as Columns print it: a whole double without its fraction, truth in lower case."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return str(x)


def strict(f):
    """NULL as soon as one argument is."""
    return lambda *a: None if any(x is None for x in a) else f(*a)


def _round(x, places=0):
    """Halves away from zero."""
    scale = 10.0 ** int(places)
    return math.copysign(math.floor(abs(float(x)) * scale + 0.5) / scale, float(x))


def _substring(x, start, n=None):
    x, start = text(x), int(start)
    start = max(0, len(x) + start) if start < 0 else start
    return x[start:] if n is None else x[start : start + max(0, int(n))]


def _like(x, pattern) -> bool:
    """% is any run, _ any sign."""
    rule = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in str(pattern))
    return re.fullmatch(rule, text(x), re.DOTALL) is not None


def _first(*a):
    return next((x for x in a if x is not None), None)


SCALARS = {
    "abs": strict(lambda x: abs(float(x))),
    "ceil": strict(lambda x: float(math.ceil(float(x)))),
    "ceiling": strict(lambda x: float(math.ceil(float(x)))),
    "floor": strict(lambda x: float(math.floor(float(x)))),
    "round": strict(_round),
    "sqrt": strict(lambda x: math.sqrt(float(x))),
    "power": strict(lambda x, y: float(x) ** float(y)),
    "pow": strict(lambda x, y: float(x) ** float(y)),
    "mod": strict(lambda x, y: math.fmod(float(x), float(y))),
    "exp": strict(lambda x: math.exp(float(x))),
    "ln": strict(lambda x: math.log(float(x))),
    "log": strict(lambda x: math.log10(float(x))),
    "log10": strict(lambda x: math.log10(float(x))),
    "log2": strict(lambda x: math.log2(float(x))),
    "sign": strict(lambda x: (float(x) > 0) - (float(x) < 0)),
    "concat": strict(lambda *a: "".join(map(text, a))),
    "upper": strict(lambda x: text(x).upper()),
    "lower": strict(lambda x: text(x).lower()),
    "trim": strict(lambda x: text(x).strip()),
    "length": strict(lambda x: len(text(x).encode())),
    "len": strict(lambda x: len(text(x).encode())),
    "substring": strict(_substring),
    "replace": strict(lambda x, a, b: text(x).replace(text(a), text(b))),
    "startswith": strict(lambda x, y: text(x).startswith(text(y))),
    "endswith": strict(lambda x, y: text(x).endswith(text(y))),
    "like": strict(_like),
    "coalesce": _first,
    "if_null": _first,
    "null_if": lambda x, y: None if x == y else x,
    "greatest": strict(max),
    "least": strict(min),
    "is_null": lambda x: x is None,
    "is_not_null": lambda x: x is not None,
}

"""Declared schemas: defaults, required fields and types, with bad rows set apart."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import SqlError

# Type names of the dialect and Spark's.
TYPES = {"int": "bigint", "int64": "bigint", "float": "double", "float32": "double", "float64": "double", "bool": "boolean", "string": "string", "time": "timestamp"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    default: Any = None


def validate(df: DataFrame, fields: list[Field], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good rows have the declared types and defaults; bad ones an array ``problems``.

    Numeric types stand for each other. With ``strict``, a column that isn't declared is an error.
    """
    extra = [c for c in df.columns if c not in {f.name for f in fields}]
    if strict and extra:
        raise SqlError("schema", f"undeclared columns: {', '.join(extra)}")
    problems, out = [], [F.col(f"`{c}`") for c in extra]
    for f in fields:
        kind = TYPES.get(f.type)
        raw = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        value = raw if kind is None else raw.try_cast(kind)
        problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{f.name} isn't of type {f.type}")))
        if f.default is not None:
            value = F.coalesce(value, F.lit(f.default))
        elif f.required:
            problems.append(F.when(raw.isNull(), F.lit(f"{f.name} is required")))
        out.append(value.alias(f.name))
    checked = df.withColumn("problems", F.array_compact(F.array(*problems)))
    return checked.filter(F.size("problems") == 0).select(*out), checked.filter(F.size("problems") > 0)

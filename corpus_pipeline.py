"""A corpus pipeline over ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxmere.llm import langid, minhash, mix, packing, toxicity
from fluxmere.llm.util import stored

STAGES = [
    ("language_id", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", minhash.stage),
    ("mix_sources", mix.stage),
    ("pack", packing.stage),
]
#: Learned models and near-copy groups have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: where each piece of each kept document is packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

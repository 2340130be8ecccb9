"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratawave.llm import exact, language, mixing, packing, simhash
from stratawave.llm.common import stored, table

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("language_id", language.stage),
    ("exact_dedup", exact.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mix_sources", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces after all stages; each stage's result is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

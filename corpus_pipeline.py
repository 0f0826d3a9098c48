"""The corpus pipeline: quality filter, near-duplicates, shared passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm._shared import table
from linkwright.llm.packing import pack_stage
from linkwright.llm.pii import mask_stage
from linkwright.llm.quality import quality_stage
from linkwright.llm.simhash import keep_one
from linkwright.llm.substring import dedup_stage
from linkwright.sources.staging import staged

STAGES = [
    ("quality", quality_stage),
    ("near_dedup", keep_one),
    ("substring_dedup", dedup_stage),
    ("pii", mask_stage),
    ("packing", pack_stage),
]

#: The fitted field, minimum-hash windows and tokenizer can't be told in SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read back as the next one's input.

    Nulls, empty and repeated texts, repeated ids, empty tables and extra columns are treated as each stage's docstring says.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

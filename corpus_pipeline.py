"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, a table after each stage.

Defined cases, the same for all stages: an empty table gives an empty table; columns beyond those of documents, whatever their names, pass through all
stages but packing; a null text counts as empty, so the quality rules drop it; rows that repeat a doc_id are each judged by their own text; a row without a
doc_id is kept or dropped by quality rules and decontamination like any other, loses no lines and is never dropped as a near-duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fightlake.llm import decontam, line_dedup, packing, repetition, simhash
from fightlake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; n_chars follows the text."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # names that the operator gives its counts
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(own) if own else docs)
    size = "case when n_dropped > 0 then length(text) else n_chars end as n_chars"
    return kept.selectExpr(*[size if c == "n_chars" else f"`{own.get(c, c)}` as `{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SimHash and the tokeniser can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

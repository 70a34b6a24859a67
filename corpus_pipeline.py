"""A cleaning pipeline over `documents`: toxicity filter, exact and near-duplicate removal, packing for training.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Nulls count as empty texts; repeated
rows and empty tables pass through every stage; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordcheck.llm.common import materialize, table
from recordcheck.llm.exact import exact_duplicates
from recordcheck.llm.packing import pack
from recordcheck.llm.simhash import drop_near_copies
from recordcheck.llm.toxicity import score_toxicity


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with columns that bear an operator's result names moved aside."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def _back(rows: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select(*[rows[f"__own_{c}"].alias(c) if c in names else rows[c] for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from `labels` and the documents it covers."""
    new = ("score", "predicted")
    scored = score_toxicity(_aside(docs, new), table(spark, sf_dir, "labels"))
    return _back(scored.filter("predicted = 0"), docs, new)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts, the one with the largest doc_id."""
    new = ("keep_id", "group_size", "kept", "text_sha256")
    return _back(exact_duplicates(_aside(docs, new)).filter("kept"), docs, new)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL has neither the model, the fingerprints' components nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

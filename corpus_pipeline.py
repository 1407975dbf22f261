"""The corpus pipeline: language ID, near-dedup, decontamination, PII and packing over documents.

Every stage takes all that its predecessor kept, with all columns; all but the last return
the columns of documents. In every stage: an empty table gives an empty one; very long
texts are taken whole; extra columns, also of names that the operators use, pass through
unchanged (the last stage drops them); repeated rows stay repeated except in near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborql.llm import decontaminate, langid, near_dedup, packing, pii
from arborql.llm.common import materialize, table

#: Per cent of common word shingles from which the pipeline takes two documents for near copies; op1_near_dedup has its own.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose two best languages tie or nearly tie.

    Without any row that has both a lang and a letter nothing can be learned, and all rows go.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; of rows that repeat its doc_id and text one.

    Null and empty texts, and rows with a null doc_id, are in no group and stay.
    """
    return near_dedup.deduplicated(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts, and all if the benchmark is empty, stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts, and n_chars of the texts that change; null stays null. Overlapping finds become one."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row for each piece of a document; a null or empty text is one piece, the end token."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]
#: SQL can't express trained language ID, disguised personal data or BPE; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

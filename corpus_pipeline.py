"""Corpus pipeline: toxicity, quality rules, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
:func:`run` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import common, mixing, near, packing, quality, queries, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null and empty texts have the score of a text without features and stay; repeated rows
    and rows with null ids are scored like any other; all columns stay as they are.
    """
    return toxicity.kept(docs, queries.toxicity_model(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go.

    Null, empty and very short texts are rejected; repeated rows share one verdict.
    """
    return quality.kept(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays.

    That of the smallest id (nulls last; rows of one id by a hash of the text). Rows that
    repeat id and text become one; an id that comes with several texts is several documents.
    """
    return near.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) to the target weights, in random order.

    A null source is a source; rows of null or repeated ids draw for themselves.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row a piece.

    Null and empty texts are the end id alone; repeated rows are packed once each.
    """
    pieces = packing.pack(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Toxicity scores and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{name}")
    return docs

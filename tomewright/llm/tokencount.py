"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content (null is the empty text; no
other change, since any could change the count) and the SHA-256 of the vocabulary file.
Stored counts are joined by digest, only distinct misses are encoded, and they are
appended to the cache.

Copies collapse in the map-side half of the aggregate that makes texts distinct, so a
text that a third of all rows repeat crosses the shuffle once a task. The join back
carries digests and the input's other columns, never texts; its hot digests are left to
adaptive skew-join splitting.

Defined results: null and empty texts have 0 tokens; repeated rows stay; an empty table
gives an empty result; input columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import col, fresh, without, written
from .tokens import encoder, vocabulary_path

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version_of(tokenizer: str) -> str:
    """The digest of a vocabulary file."""
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def _stored(spark, cache: str, version: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    # two writers may have appended the same digest
    return found.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode_misses(texts: DataFrame, tokenizer: str, version: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = encoder(tokenizer).count
        for batch in batches:
            sizes = [count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                names=["digest", "version", "n_tokens"],
            )

    return texts.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def _content(text_col: str) -> Column:
    return F.coalesce(col(text_col).cast("string"), F.lit(""))


def store(df: DataFrame, cache: str, text_col: str = "text", tokenizer: str | None = None) -> None:
    """Append the counts of the distinct texts that ``cache`` does not hold yet."""
    path = tokenizer or vocabulary_path("byte_bpe_50k.json")
    version = version_of(path)
    content = _content(text_col)
    texts = df.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    # distinct before the join, so that copies collapse on the map side; the join finds them dealt by digest
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if (stored := _stored(df.sparkSession, cache, version)) is not None:
        misses = misses.join(stored, "digest", "left_anti")
    _encode_misses(misses, path, version).write.mode("append").parquet(cache)


def count_tokens(
    df: DataFrame,
    cache: str,
    text_col: str = "text",
    tokenizer: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8) and ``n_tokens``; new counts are appended to ``cache``.

    ``cache`` is a folder that all executors reach. ``keep_text=False`` leaves the text
    out of the result, and so out of the join.
    """
    version = version_of(tokenizer or vocabulary_path("byte_bpe_50k.json"))
    spark = df.sparkSession
    digest, content = fresh(df, "_t_digest"), _content(text_col)
    store(df, cache, text_col, tokenizer)
    # a table of its own, so that the join's two sides are plain exchanges, which can be split
    counts = written(_stored(spark, cache, version), "token-counts").select(col("digest").alias(digest), "n_tokens")
    gone = ["n_bytes", "n_tokens"] + ([] if keep_text else [text_col])
    keep = without(df, *gone)
    rows = df.select(*keep, F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias(digest))
    return rows.join(counts, digest, "left").select(*keep, "n_bytes", "n_tokens")

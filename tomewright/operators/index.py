"""The inverted index: postings, document lengths, document frequencies, BM25.

Document frequencies are global over all entity types while the number of documents is
per type, so a term may be in more entities than a type has: negative idf is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import tokens

K1, B, HIT_IDF = 1.2, 0.75, 0.15
KEY = ["entity_type", "entity_id"]


def postings(entities: DataFrame) -> DataFrame:
    """(entity_type, entity_id, term, tf, len) of (entity_type, entity_id, text), an entity being one row.

    Every posting has its entity's length, so that ranking needs no join for it.
    """
    words = entities.select(*KEY, tokens(F.col("text")).alias("words"))
    return (
        words.select(*KEY, F.size("words").cast("long").alias("len"), F.explode("words").alias("term"))
        .groupBy(*KEY, "term")
        .agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    )


def doc_stats(posted: DataFrame) -> DataFrame:
    """(entity_type, entity_id, len): tokens an entity is indexed under."""
    return posted.groupBy(*KEY).agg(F.sum("tf").alias("len"))


def term_df(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """(entity_type, n, avgdl); an average of 0 counts as 1."""
    return stats.groupBy("entity_type").agg(
        F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avgdl")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def store(entities: DataFrame, path: str, target: str = "term") -> None:
    """Write the index of ``entities``: postings by type, dealt and sorted by term, lengths, totals.

    Sorted files let a query's term predicate skip row groups. Terms are dealt by ranges of
    (term, hash of the entity): a rare term lies in one file, one that every document has is
    cut over as many as its postings fill.
    """
    spread = F.xxhash64(*KEY)
    dealt = postings(entities).repartitionByRange(target, spread).sortWithinPartitions("entity_type", target)
    dealt.write.mode("overwrite").partitionBy("entity_type").parquet(f"{path}/postings")
    stored, _, _ = load(entities.sparkSession, path)
    doc_stats(stored).write.mode("overwrite").partitionBy("entity_type").parquet(f"{path}/stats")
    _, stats, _ = load(entities.sparkSession, path)
    corpus_stats(stats).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def load(spark, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(postings, lengths, totals by type) of a stored index."""
    posted = spark.read.schema("entity_id long, term string, tf long, len long, entity_type string").parquet(f"{path}/postings")
    stats = spark.read.schema("entity_id long, len long, entity_type string")
    totals = spark.read.schema("entity_type string, n long, avgdl double")
    return (
        posted.select(*KEY, "term", "tf", "len"),
        _if_there(stats, f"{path}/stats", [*KEY, "len"]),
        _if_there(totals, f"{path}/totals", ["entity_type", "n", "avgdl"]),
    )


def _if_there(reader, path: str, columns: list[str]) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return reader.parquet(path).select(*columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def bm25_of(
    posted: DataFrame, terms: list[str], entity_types: list[str], totals: DataFrame | None = None
) -> DataFrame:
    """(entity_type, entity_id, score, hits): BM25 over the distinct ``terms``; hits are the rarer terms met.

    ``totals`` are stored (entity_type, n, avgdl); without them they come from all postings.
    Only the query's terms are read (the predicate reaches a Parquet index), and nothing is
    shuffled but partial sums. The frequencies of the query's terms (one row a term) and the
    totals (one row a type) are broadcast: their sizes are bounded by the query.
    """
    matched = posted.where(F.col("term").isin(sorted(set(terms))))
    kinds = F.col("entity_type").isin(entity_types)
    if totals is None:
        totals = corpus_stats(doc_stats(posted.where(kinds)))
    found = (
        matched.where(kinds)
        .join(F.broadcast(term_df(matched)), "term")
        .join(F.broadcast(totals.where(kinds).select("entity_type", "n", "avgdl")), "entity_type")
    )
    weight = idf(F.col("n"), F.col("df"))
    gain = weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return found.groupBy(*KEY).agg(
        F.sum(gain).alias("score"),
        F.array_sort(F.collect_set(F.when(weight > HIT_IDF, F.col("term")))).alias("hits"),
    )


def bm25(posted: DataFrame, terms: list[str], entity_type: str, totals: DataFrame | None = None) -> DataFrame:
    """(entity_id, score, hits) of one type: see :func:`bm25_of`."""
    return bm25_of(posted, terms, [entity_type], totals).drop("entity_type")


def upsert(posted: DataFrame, entities: DataFrame) -> DataFrame:
    """The index after ``entities`` are written: their old postings go, the new ones come."""
    kept = posted.join(entities.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(postings(entities))


def remove(posted: DataFrame, keys: DataFrame) -> DataFrame:
    """The index without the entities of ``keys`` (entity_type, entity_id)."""
    return posted.join(keys.select(*KEY).distinct(), KEY, "left_anti")

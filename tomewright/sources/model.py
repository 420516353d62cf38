"""The knowledge-base model over the fixture tables.

files = documents (+ labels), notes = benchmark, chunks = lines of documents, logs =
events, chats = conversations, workspaces = languages, folders = sources; flags, tags and
times follow stated rules on the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _common(key: str) -> list:
    k = F.col(key)
    return [
        (k % 17 == 0).alias("pinned"),
        (k % 29 == 0).alias("deleted"),
        F.expr(f"TIMESTAMP '2024-01-01' + make_dt_interval(CAST({key} % 180 AS INT))").alias("updated_at"),
        F.array(F.concat(F.lit("tag"), k % 7), F.concat(F.lit("Topic"), k % 5)).alias("tags"),
    ]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    exts = F.array(*[F.lit(x) for x in ("md", "txt", "html", "csv", "pdf")])
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("workspace"),
        F.col("source").alias("folder"),
        F.substring("text", 1, 40).alias("title"),
        F.get(exts, (F.col("doc_id") % 5).cast("int")).alias("ext"),
        F.col("n_chars").alias("size"),
        "text",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("starred"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("private"),
        *_common("doc_id"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"),
        F.lit("en").alias("workspace"),
        F.concat(F.lit("folder"), F.col("item_id") % 3).alias("folder"),
        F.substring("text", 1, 40).alias("title"),
        "text",
        (F.col("item_id") % 4 == 0).alias("starred"),
        F.lit(False).alias("private"),
        *_common("item_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold a character other than a blank, numbered per document."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
        .where(F.length(F.trim("text")) > 0)
        .select(
            (F.col("doc_id") * 10_000_000 + F.col("idx")).alias("chunk_id"),
            F.col("doc_id").alias("file_id"),
            F.col("lang").alias("workspace"),
            F.col("idx").cast("long").alias("idx"),
            "text",
        )
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_type, entity_id, text) of everything that is indexed."""

    def of(df: DataFrame, kind: str, key: str, text) -> DataFrame:
        return df.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), text.alias("text"))

    return (
        of(files(spark, sf_dir), "file", "id", F.col("text"))
        .unionByName(of(notes(spark, sf_dir), "note", "id", F.concat_ws("\n", "title", "title", "text")))
        .unionByName(of(chunks(spark, sf_dir), "chunk", "chunk_id", F.col("text")))
    )


_COMMON_SQL = """{k} % 17 = 0 AS pinned, {k} % 29 = 0 AS deleted,
  TIMESTAMP '2024-01-01' + to_days(CAST({k} % 180 AS INT)) AS updated_at,
  ['tag' || ({k} % 7), 'Topic' || ({k} % 5)] AS tags"""

#: DuckDB definitions of the same views.
MODEL_SQL = f"""files AS (
  SELECT d.doc_id AS id, lang AS workspace, source AS folder, substr(text, 1, 40) AS title,
    ['md', 'txt', 'html', 'csv', 'pdf'][CAST(d.doc_id % 5 AS INT) + 1] AS ext, n_chars AS size, text,
    coalesce(quality = 1, FALSE) AS starred, coalesce(toxic = 1, FALSE) AS private,
    {_COMMON_SQL.format(k="d.doc_id")}
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), notes AS (
  SELECT item_id AS id, 'en' AS workspace, 'folder' || (item_id % 3) AS folder, substr(text, 1, 40) AS title, text,
    item_id % 4 = 0 AS starred, FALSE AS private, {_COMMON_SQL.format(k="item_id")}
  FROM benchmark
), chunks AS (
  SELECT doc_id * 10000000 + idx - 1 AS chunk_id, doc_id AS file_id, lang AS workspace, idx - 1 AS idx, ls[idx] AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS idx
        FROM documents)
  WHERE length(trim(ls[idx], ' ')) > 0
), entities AS (
  SELECT 'file' AS entity_type, id AS entity_id, text FROM files
  UNION ALL SELECT 'note', id, title || chr(10) || title || chr(10) || text FROM notes
  UNION ALL SELECT 'chunk', chunk_id, text FROM chunks
)"""

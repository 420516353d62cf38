"""Registered queries of streams, sequential operators, exports and sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import crypto
from tomewright.operators import nlp
from tomewright.operators import search as S
from tomewright.plans import retrieval as R
from tomewright.sources import model as M
from tomewright.sources import storage
from tomewright.streaming import events as E

T = M.table


def events_daily_window(spark: SparkSession, d: str) -> DataFrame:
    stream = E.event_stream(spark, f"{d}/event[s].parquet")
    return E.run_to_end(E.daily_windows(stream), "complete", "daily")


def events_running_counters(spark: SparkSession, d: str) -> DataFrame:
    stream = E.event_stream(spark, f"{d}/event[s].parquet")
    spent = F.when(F.col("event_type").isin("error", "click"), -F.col("value")).otherwise(F.col("value"))
    changes = stream.select("user_id", "ts", "event_id", spent.alias("value"))
    out = E.run_to_end(E.running_counters(changes), "update", "counters", key="user_id")
    return out.select("user_id", F.round("used", 4).alias("used"), "n")


def events_queue(spark: SparkSession, d: str) -> DataFrame:
    stream = E.event_stream(spark, f"{d}/event[s].parquet")
    return E.run_to_end(E.queue(stream), "complete", "queue")


def note_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as saves of one note a user: value times 10 is the size, errors are forced saves."""
    stream = E.event_stream(spark, f"{d}/event[s].parquet").select(
        F.col("user_id").alias("note"), "ts", (F.col("value") * 10).alias("size"), (F.col("event_type") == "error").alias("forced")
    )
    return E.run_to_end(E.versions(stream), "append", "versions")


def lock_leases(spark: SparkSession, d: str) -> DataFrame:
    stream = E.event_stream(spark, f"{d}/event[s].parquet").select(
        F.concat(F.lit("doc"), F.col("event_id") % 40).alias("resource"), "ts", F.col("user_id").alias("holder")
    )
    return E.run_to_end(E.leases(stream, 3600), "append", "leases")


def think_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages cut into pieces of 7 characters with a think span before the text."""
    talks = T(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("a<think>secret</think>"), "text").alias("t")
    )
    cut = talks.select(
        "id",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 7).cast("int")), lambda i: F.substr(F.col("t"), i * 7 + 1, F.lit(7)))
        ).alias("seq", "piece"),
    )
    return E.think_filtered(cut, "id", "seq", "piece").select("id", F.md5("text").alias("digest"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The retrieved contexts (eight at most) and the sentences that answer from them."""
    rows, _, totals = R.stored(spark, d)
    found = S.retrieve(rows, M.chunks(spark, d), M.files(spark, d), R.Q, totals=totals).join(
        M.chunks(spark, d).select("chunk_id", "text"), "chunk_id"
    )
    rows = found.orderBy(F.desc("score"), "chunk_id").collect()  # top_k rows
    out = nlp.answer(R.Q, [{"id": r["chunk_id"], "text": r["text"], "score": r["score"]} for r in rows])
    return spark.createDataFrame([(R.Q, out["sentences"], out["citations"], out["confidence"])], "question string, sentences array<string>, citations array<long>, confidence double")


def compare_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "benchmark").orderBy("item_id").limit(3).collect()
    out = nlp.compare([r["text"] for r in rows])
    return spark.createDataFrame([(r["item_id"], u, out["common"]) for r, u in zip(rows, out["unique"])], "item_id long, unique array<string>, common array<string>")


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the first 80 vectors, as a graph view shows them."""
    rows = T(spark, d, "embeddings").orderBy("vec_id").limit(80).collect()
    k = int(min(5, max(2, round((len(rows) / 2) ** 0.5))))
    labels = nlp.kmeans(np.array([r["embedding"] for r in rows]), k, 14)
    return spark.createDataFrame([(r["vec_id"], int(c)) for r, c in zip(rows, labels)], "vec_id long, cluster int")


def export_paths(spark: SparkSession, d: str) -> DataFrame:
    out = storage.export_workspace(M.files(spark, d), M.notes(spark, d))
    return out.select("workspace", "path", F.md5("content").alias("digest"))


def backup_round_trip(spark: SparkSession, d: str) -> DataFrame:
    names = ("region", "nation", "benchmark")
    path = storage.scratch(spark, "backup")
    storage.backup({n: T(spark, d, n) for n in names}, path)
    back = storage.restore(spark, path)
    out = None
    for n in names:
        one = back[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = bytes(range(32))
    sealed = T(spark, d, "benchmark").select("item_id", crypto.seal(F.col("text").cast("binary"), key).alias("e"))
    return sealed.select("item_id", F.md5(crypto.unseal(F.col("e"), key)).alias("digest"), F.octet_length("e").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        events_daily_window, events_running_counters, events_queue, note_versions, lock_leases, think_stream, extractive_answer,
        compare_keywords, kmeans_clusters, export_paths, backup_round_trip, sealed_round_trip,
    )
}

_SAFE = "regexp_replace(coalesce(title, 'untitled'), '[\\\\/:*?\"<>|\\s]+', '-', 'g')"
ORACLE_SQL = {
    "events_daily_window": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "events_running_counters": """WITH d AS (
  SELECT user_id, CASE WHEN event_type IN ('error', 'click') THEN -value ELSE value END AS x, ts, event_id FROM events
), s AS (SELECT user_id, x, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM d)
SELECT user_id, round(sum(x) - least(0, min(s)), 4) + 0 AS used, count(*) AS n FROM s GROUP BY user_id""",
    "events_queue": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, bool_or(event_type = 'error') AS urgent FROM events GROUP BY user_id",
    "think_stream": "SELECT conv_id || '-' || turn AS id, md5('a' || text) AS digest FROM conversations",
    "export_paths": f"""WITH {M.MODEL_SQL}
SELECT workspace, 'notes/' || coalesce(folder, 'root') || '/' || id || '-' || {_SAFE} || '.md' AS path, md5('# ' || title || chr(10) || chr(10) || text || chr(10)) AS digest FROM notes WHERE NOT deleted
UNION ALL SELECT workspace, 'files/' || coalesce(folder, 'root') || '/' || id || '-' || {_SAFE} || '.txt', md5(text) FROM files WHERE NOT deleted""",
    "backup_round_trip": "SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'benchmark', count(*) FROM benchmark",
    "sealed_round_trip": "SELECT item_id, md5(text) AS digest, strlen(text) + 32 AS n FROM (SELECT item_id, text FROM benchmark)",
}

"""The registered queries of this subpackage and their SQL.

Each ``opN_<name>`` applies one operator with production parameters to its whole table
and derives the columns that are compared from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, dac, langid, mixing, packing, quality, simhash, tokencount, toxicity
from .common import scratch_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.score(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = _remainder(3) == 1
    model = langid.fit(docs.where(~held), "doc_id", "text", "lang")
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return langid.predict(rows, model)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = _remainder(5) != 0
    return toxicity.fit(docs.where(learned), labels.where(learned))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (_remainder(5) == 0).alias("held_out"), "text"
    )
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], talks.schema)
    packed = written(chat.packs(talks.unionByName(extra)), "chat-packs")
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.conversations(packed).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    dac.write(table(spark, sf_dir, "documents"), path)
    return dac.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = scratch_path(spark, "token-counts")
    tokencount.store(docs.where(_remainder(8) == 0), cache)  # an earlier load: these are found, not encoded again
    counted = tokencount.count_tokens(docs, cache, keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


_STOP_SQL = ", ".join("'" + w + "'" for w in quality.stop_words())

OP1_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
         list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), k AS (
  SELECT rid, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS gram FROM g
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM k) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(5)) AS o) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS n_ellipsis
  FROM w LEFT JOIN c ON w.rid = c.rid
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2 AND 14
       AND n_symbols / n_words <= 0.1
       AND (n_words < 25 OR n_stop / n_words >= 0.04)
       AND n_dup_lines / n_lines <= 0.5
       AND n_bullet / n_lines <= 0.9
       AND n_ellipsis / n_lines <= 0.5 AS kept
FROM b
"""

OP5_SQL = """
WITH s AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, power(n, 0.5) * ((SELECT sum(n) FROM s) / (SELECT sum(power(n, 0.5)) FROM s)) / n AS rate
  FROM s
), m AS (
  SELECT source, greatest(1, CAST(ceil(rate / 16) AS INT)) AS parts, rate FROM r
), k AS (
  SELECT source, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)))
           OVER (PARTITION BY source ORDER BY k) AS c
  FROM m, (SELECT unnest(range(0, 101)) AS k)
), d AS (
  SELECT row_number() OVER () AS rowid,
         coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|'
           || (row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1) AS key, *
  FROM documents
), u AS (
  SELECT rowid, source,
         CAST('0x' || substr(md5('17|' || key || '|' || part), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d
  JOIN (SELECT source AS src, unnest(range(1, parts + 1)) AS part FROM m) p ON d.source IS NOT DISTINCT FROM p.src
), c AS (
  SELECT u.rowid, count(k.k) AS copies
  FROM u LEFT JOIN k ON u.source IS NOT DISTINCT FROM k.source AND k.c <= u.u GROUP BY u.rowid
)
SELECT d.* EXCLUDE (rowid, key), CAST(copy AS INT) AS copy,
       CAST('0x' || substr(md5('17:order|' || key || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM d
JOIN (SELECT rowid, unnest(range(1, copies + 1)) AS copy FROM c) x ON d.rowid = x.rowid
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language": op2_language,
    "op3_nearest": op3_nearest,
    "op4_simhash": op4_simhash,
    "op5_source_mix": op5_source_mix,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op5_source_mix": OP5_SQL,
}

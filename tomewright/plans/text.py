"""Registered text queries with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions import format as D
from tomewright.functions import text as X
from tomewright.operators import nlp
from tomewright.plans.retrieval import tokens_sql
from tomewright.sources import model as M

T = M.table


def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    out = X.normalize_whitespace(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    out = T(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


def markdown_to_text(spark: SparkSession, d: str) -> DataFrame:
    out = X.markdown_to_text(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.md5(out).alias("digest"))


def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    out = T(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def word_count_reading(spark: SparkSession, d: str) -> DataFrame:
    words = X.word_count(F.col("text"))
    return T(spark, d, "documents").select("doc_id", words.cast("long").alias("words"), X.reading_minutes(words).alias("minutes"))


def truncate_slug(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "part").select("p_partkey", X.truncate(F.col("p_name"), 12).alias("short"), X.slug(F.col("p_name")).alias("slug"))


def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", F.md5(X.escape_html(F.col("html"))).alias("digest"))


def preview_kinds(spark: SparkSession, d: str) -> DataFrame:
    exts = F.array(*[F.lit(x) for x in ("PDF", "md", "py", "log", "zip", "conf", "dat")])
    mimes = F.array(*[F.lit(x) for x in ("", "image/x", "text/odd", "audio/y", "application/z")])
    docs = T(spark, d, "documents").select("doc_id", F.get(exts, (F.col("doc_id") % 7).cast("int")).alias("ext"), F.get(mimes, (F.col("doc_id") % 5).cast("int")).alias("mime"))
    return docs.select("doc_id", X.preview_kind(F.col("ext"), F.col("mime")).alias("kind"))


def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * 104729 + 13
    return T(spark, d, "orders").select("o_orderkey", X.format_bytes(n).alias("shown"))


def normalize_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" #A,b, a ,"), F.concat(F.lit("tag"), F.col("item_id") % 3), F.lit(", #"), F.substring("text", 1, 50))
    return T(spark, d, "benchmark").select("item_id", F.array_join(X.normalize_tags(raw), "|").alias("tags"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", X.safe_file_name(F.col("url")).alias("name"), X.extension(F.col("url")).alias("ext"))


def think_strip(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<think>why "), F.col("turn"), F.lit("</think>"), F.col("text"), F.lit("<Thinking>no</thinking></think>"))
    return T(spark, d, "conversations").select("conv_id", "turn", F.md5(X.strip_think(said)).alias("digest"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return T(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k > 50).alias("n_big"))


def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered context blocks of the first eight notes, cut to 320 characters, in one string."""
    w = Window.orderBy("item_id")
    first = T(spark, d, "benchmark").orderBy("item_id").limit(8).withColumn("i", F.row_number().over(w))
    block = F.concat(F.lit("["), "i", F.lit("] "), X.truncate(F.regexp_replace("text", r"\s+", " "), 320))
    return first.select("i", block.alias("b")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), "\n\n").alias("prompt")
    )


def citations_numbered(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = T(spark, d, "documents").withColumn("i", F.row_number().over(w)).where(F.col("i") <= 6)
    return ranked.select("lang", "i", "doc_id", X.truncate(F.col("text"), 260).alias("snippet"))


def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events framed for a stream and parsed back from the frames."""
    data = F.concat(F.lit("data: "), F.col("props"))
    frame = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\n"), data, F.lit("\n\n"))
    framed = T(spark, d, "events").select("event_id", frame.alias("frame"))
    block = F.explode(F.filter(F.split("frame", "\n\n"), lambda b: b != ""))
    parsed = framed.select("event_id", block.alias("b"))
    return parsed.select(
        "event_id",
        F.regexp_extract("b", "(?m)^event: (.*)$", 1).alias("event"),
        F.get_json_object(F.regexp_extract("b", "(?m)^data: (.*)$", 1), "$.k").cast("long").alias("k"),
    )


def tf_idf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Per language, the ten most frequent index terms."""
    terms = T(spark, d, "documents").select("lang", F.explode(X.tokens(F.col("text"))).alias("term"))
    n = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 10).select("lang", "term", "n")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return nlp.chunks(T(spark, d, "documents")).select("doc_id", "idx", "heading", F.length("text").alias("n"), F.md5("text").alias("digest"))


def textrank_summary(spark: SparkSession, d: str) -> DataFrame:
    return nlp.summaries(T(spark, d, "benchmark"), "item_id", "text", 3)


def document_outline(spark: SparkSession, d: str) -> DataFrame:
    return nlp.outlines(T(spark, d, "benchmark"), "item_id", "text")


def display_events(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events")
    ago = D.time_ago(F.col("ts") - F.expr("make_dt_interval(CAST(event_id % 500 AS INT))"), F.lit("2024-01-31").cast("timestamp"))
    return events.select("event_id", ago.alias("ago"), D.duration(F.col("event_id") * 100 + 37).alias("took"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "customer").select(
        "c_custkey", D.color(F.col("c_name")).alias("color"), D.initials(F.col("c_name")).alias("initials")
    )


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", D.excerpt(F.col("text")).alias("excerpt"))


def address_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of generated IPv4 addresses, counted."""
    n = F.col("o_orderkey") * 2_654_435_761 % 4_294_967_296
    parts = [(F.shiftright(n, k) % 256).cast("string") for k in (24, 16, 8, 0)]
    classes = T(spark, d, "orders").select(D.address_class(F.concat_ws(".", *parts)).alias("class"))
    return classes.groupBy("class").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        display_events, display_names, excerpts, address_classes,
        normalize_ws, html_to_text, html_title, markdown_to_text, split_sentences, word_count_reading, truncate_slug,
        escape_html, preview_kinds, format_bytes, normalize_tags, file_names, think_strip, json_props, prompt_blocks,
        citations_numbered, sse_frames, tf_idf_terms, document_chunks, textrank_summary, document_outline,
    )
}

_NWS = "trim(regexp_replace(regexp_replace(replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_STRIP = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), "
    "'</(p|div|li|h[1-6]|tr|section|article|blockquote|pre)>', chr(10), 'gi'), '<[^>]*>', '', 'g')"
)
_ENT = _STRIP
for _p, _c in X.HTML_ENTITIES + (("&amp;", "&"),):
    _ENT = f"regexp_replace({_ENT}, '{_p}', '{_c.replace(chr(39), chr(39) * 2)}', 'gi')"
_MD = "text"
for _p, _c, _f in (
    ("```.*?```", " ", "gs"), ("`([^`]+)`", "\\1", "g"), ("!\\[[^\\]]*\\]\\([^)]*\\)", " ", "g"), ("\\[([^\\]]+)\\]\\([^)]*\\)", "\\1", "g"),
    ("(?m)^\\s{0,3}#{1,6}\\s+", "", "g"), ("(?m)^\\s*>\\s?", "", "g"), ("[*_~]{1,3}", "", "g"), ("\\|", " ", "g"), ("\\r\\n?", "\n", "g"), ("\\n{3,}", "\n\n", "g"),
):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_c}', '{_f}')"
_SENT = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([。！？!?；;])\\s*', '\\1' || chr(1), 'g'), "
    "'\\.\\s+([A-Z0-9])', '.' || chr(1) || '\\1', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 1)"
)
_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PREVIEW_KINDS.items())

ORACLE_SQL = {
    "display_events": f"""WITH e AS (SELECT event_id, event_id * 100 + 37 AS ms, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(ts - to_days(CAST(event_id % 500 AS INT))) / 1e6 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN '{D.JUST_NOW}' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' 分钟前' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' 小时前'
  WHEN s < 172800 THEN '{D.YESTERDAY}' WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || ' 天前' WHEN s < 31536000 THEN CAST(floor(s / 2592000) AS BIGINT) || ' 个月前'
  ELSE CAST(floor(s / 31536000) AS BIGINT) || ' 年前' END AS ago,
  CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000) || ' s'
  ELSE CAST(floor(ms / 60000) AS BIGINT) || ' 分 ' || CAST(floor(ms % 60000 / 1000 + 0.5) AS BIGINT) || ' 秒' END AS took FROM e""",
    "display_names": f"""WITH h AS (SELECT c_custkey, c_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda a, c: (a * 31 + c) & 4294967295) AS h, list_filter(regexp_split_to_array(trim(c_name), '[\\s._-]+'), lambda p: p <> '') AS p FROM customer)
SELECT c_custkey, {list(D.PALETTE)}[CAST(h % 10 AS INT) + 1] AS color, CASE WHEN len(p) >= 2 THEN upper(p[1][1] || p[2][1]) ELSE upper(substr(trim(c_name), 1, 2)) END AS initials FROM h""",
    "excerpts": """WITH e AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 110 THEN s ELSE substr(s, 1, 109) || '…' END AS excerpt FROM e""",
    "address_classes": """WITH n AS (SELECT o_orderkey * 2654435761 % 4294967296 AS v FROM orders)
SELECT CASE WHEN v = 0 THEN 'unspecified' WHEN v >> 24 = 127 THEN 'loopback' WHEN v >> 16 = 169 * 256 + 254 THEN 'link-local'
  WHEN v >> 24 = 10 OR v >> 20 = 172 * 16 + 1 OR v >> 16 = 192 * 256 + 168 THEN 'private' WHEN v >> 22 = 100 * 4 + 1 THEN 'shared'
  WHEN v >> 17 = (198 * 256 + 18) / 2 THEN 'benchmark' WHEN v >> 28 = 14 THEN 'multicast' WHEN v >> 28 = 15 THEN 'reserved' ELSE 'public' END AS class, count(*) AS n
FROM n GROUP BY 1""",
    "normalize_ws": f"SELECT doc_id, md5({_NWS.format(t='text')}) AS digest, length({_NWS.format(t='text')}) AS n FROM documents",
    "html_to_text": f"SELECT page_id, md5({_NWS.format(t=_ENT)}) AS digest, length({_NWS.format(t=_ENT)}) AS n FROM pages",
    "html_title": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages",
    "markdown_to_text": f"SELECT doc_id, md5(regexp_replace({_MD}, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents",
    "split_sentences": f"SELECT doc_id, len({_SENT}) AS n, md5(array_to_string({_SENT}, '|')) AS digest FROM documents",
    "word_count_reading": f"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[{X.HAN}]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS words FROM documents)
SELECT doc_id, words, CAST(greatest(1, floor(words / 380 + 0.5)) AS INT) AS minutes FROM w""",
    "truncate_slug": """SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE substr(p_name, 1, 11) || '…' END AS short,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""",
    "escape_html": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages",
    "preview_kinds": f"""WITH f AS (SELECT doc_id, lower(['PDF', 'md', 'py', 'log', 'zip', 'conf', 'dat'][CAST(doc_id % 7 AS INT) + 1]) AS e,
  ['', 'image/x', 'text/odd', 'audio/y', 'application/z'][CAST(doc_id % 5 AS INT) + 1] AS m FROM documents)
SELECT doc_id, coalesce(CASE e {_KINDS} END, CASE WHEN e = 'py' THEN 'code' WHEN e = 'conf' THEN 'text' END,
  CASE WHEN m LIKE 'image/%' THEN 'image' WHEN m LIKE 'audio/%' THEN 'audio' WHEN m LIKE 'video/%' THEN 'video' WHEN m LIKE 'text/%' THEN 'text' END, 'binary') AS kind FROM f""",
    "format_bytes": """WITH f AS (SELECT o_orderkey, o_orderkey * o_orderkey * 104729 + 13 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
  WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS shown FROM f""",
    "normalize_tags": """WITH RECURSIVE r AS (SELECT item_id, list_filter(list_transform(list_filter(list_transform(
  string_split(' #A,b, a ,tag' || (item_id % 3) || ', #' || substr(text, 1, 50), ','), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: substr(regexp_replace(x, '^#+', ''), 1, 32)), lambda x: x <> '') AS ts FROM benchmark),
g AS (SELECT item_id, ts, 1 AS i, CAST([] AS VARCHAR[]) AS o FROM r
  UNION ALL SELECT item_id, ts, i + 1, CASE WHEN list_contains(list_transform(o, lambda x: lower(x)), lower(ts[i])) THEN o ELSE list_append(o, ts[i]) END FROM g WHERE i <= len(ts))
SELECT item_id, array_to_string(o[1:20], '|') AS tags FROM g WHERE i = len(ts) + 1""",
    "file_names": """WITH b AS (SELECT page_id, url, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages)
SELECT page_id, CASE WHEN substr(trim(regexp_replace(regexp_replace(base, '[\\x00-\\x1f<>:"|?*]', '_', 'g'), '\\s+', ' ', 'g')), 1, 180) = '' THEN 'untitled'
  ELSE substr(trim(regexp_replace(regexp_replace(base, '[\\x00-\\x1f<>:"|?*]', '_', 'g'), '\\s+', ' ', 'g')), 1, 180) END AS name,
  lower(regexp_extract(url, '^.+\\.([^.]*)$', 1)) AS ext FROM b""",
    "think_strip": "SELECT conv_id, turn, md5(regexp_replace(regexp_replace('<think>why ' || turn || '</think>' || text || '<Thinking>no</thinking></think>', '<think(ing)?>.*?</think(ing)?>', '', 'gis'), '</?think(ing)?>', '', 'gi')) AS digest FROM conversations",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) > 50) AS n_big FROM events GROUP BY event_type",
    "prompt_blocks": """WITH f AS (SELECT row_number() OVER (ORDER BY item_id) AS i, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM benchmark ORDER BY item_id LIMIT 8)
SELECT string_agg('[' || i || '] ' || CASE WHEN length(t) <= 320 THEN t ELSE substr(t, 1, 319) || '…' END, chr(10) || chr(10) ORDER BY i) AS prompt FROM f""",
    "citations_numbered": """WITH r AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS i, doc_id, text FROM documents)
SELECT lang, i, doc_id, CASE WHEN length(text) <= 260 THEN text ELSE substr(text, 1, 259) || '…' END AS snippet FROM r WHERE i <= 6""",
    "sse_frames": "SELECT event_id, event_type AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "tf_idf_terms": f"""WITH t AS (SELECT lang, unnest({tokens_sql("text")}) AS term FROM documents), n AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, term, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 10""",
}

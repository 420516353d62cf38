"""Registered queries of the index, ranked search, retrieval and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions import text as X
from tomewright.functions import vector as V
from tomewright.operators import index as I
from tomewright.operators import search as S
from tomewright.sources import model as M
from tomewright.sources import storage

Q = "Therhean ering stea license"
TERMS = X.py_tokens(Q)

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS) + "]"
_RUNS = X.RUNS.replace("+#.-]", "+#.\\-]")


def tokens_sql(text: str, stop: bool = True) -> str:
    runs = f"regexp_extract_all(lower(coalesce({text}, '')), '{_RUNS}')"
    pairs = (
        f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[{X.CJK}]') AND length(r) > 1 "
        "THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"
    )
    if not stop:
        return pairs
    return (
        f"list_filter({pairs}, lambda t: (length(t) > 1 OR regexp_matches(t, '^[{X.CJK}]')) "
        f"AND NOT list_contains({_STOP}, t))"
    )


INDEX_SQL = f"""{M.MODEL_SQL}, posted AS (
  SELECT entity_type, entity_id, term, count(*) AS tf
  FROM (SELECT entity_type, entity_id, unnest({tokens_sql("text")}) AS term FROM entities) GROUP BY ALL
), stats AS (SELECT entity_type, entity_id, sum(tf) AS len FROM posted GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term
), totals AS (SELECT entity_type, count(*) AS n, coalesce(nullif(avg(len), 0), 1) AS avgdl FROM stats GROUP BY entity_type
)"""


def bm25_sql(name: str, kind: str, terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    gain = (
        "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 "
        "/ (tf + 1.2 * (0.25 + 0.75 * coalesce(len, avgdl) / avgdl))"
    )
    return f""", {name} AS (
  SELECT p.entity_id, sum({gain}) AS score,
    coalesce(list_sort(list(p.term) FILTER (ln(1 + (n - df + 0.5) / (df + 0.5)) > 0.15)), []) AS hits
  FROM posted p JOIN dfs USING (term) LEFT JOIN stats s ON s.entity_type = p.entity_type AND s.entity_id = p.entity_id
    JOIN totals t ON t.entity_type = p.entity_type
  WHERE p.entity_type = '{kind}' AND p.term IN ({wanted}) GROUP BY p.entity_id
)"""


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, totals) of all entities, built once an application and folder.

    The index is a table in the shared folder: queries read the terms they ask for.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = storage.scratch(spark, "index")
        I.store(M.entities(spark, d), path)
        _STORED[key] = path
    return I.load(spark, _STORED[key])


def posted(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d)[0]


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Build and store the whole index, then count its rows by type."""
    path = storage.scratch(spark, "index")
    I.store(M.entities(spark, d), path)
    return I.load(spark, path)[0].groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("tf").alias("tokens"))


def _args(spark: SparkSession, d: str, kind: str) -> tuple:
    rows, _, totals = stored(spark, d)
    return rows, TERMS, kind, totals


def _bm25(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = I.bm25(*_args(spark, d, kind))
        return found.select("entity_id", F.round("score", 6).alias("score"), F.array_join("hits", ",").alias("hits"))

    return run


def _bm25_oracle(kind: str) -> str:
    return (
        f"WITH {INDEX_SQL}{bm25_sql('b', kind, TERMS)} "
        "SELECT entity_id, round(score, 6) AS score, array_to_string(hits, ',') AS hits FROM b"
    )


def bm25_files(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the twenty best documents of a keyword query, with highlighted snippets."""
    found = I.bm25(*_args(spark, d, "file"))
    best = found.orderBy(F.desc(F.round("score", 6)), "entity_id").limit(20)
    docs = M.files(spark, d).select(F.col("id").alias("entity_id"), "title", "text")
    terms = X.query_terms(Q)
    return best.join(docs, "entity_id").select(
        "entity_id",
        "title",
        F.round("score", 6).alias("score"),
        X.highlight(X.snippet(F.col("text"), terms, 120, 220), terms).alias("snippet"),
    )


def bm25_chunks_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = S.chunk_rollup(I.bm25(*_args(spark, d, "chunk")), M.chunks(spark, d))
    return rolled.select(
        "file_id", F.round("chunk_score", 6).alias("chunk_score"), "best_chunk", F.array_join("top_chunks", ",").alias("top_chunks")
    )


def term_df_top(spark: SparkSession, d: str) -> DataFrame:
    return I.term_df(posted(spark, d)).orderBy(F.desc("df"), "term").limit(100)


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d)[1]


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    out = I.corpus_stats(stored(spark, d)[1])
    return out.select("entity_type", "n", F.round("avgdl", 6).alias("avgdl"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = M.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.size(X.all_tokens(F.col("text"))).cast("long").alias("n_all"),
        F.size(X.tokens(F.col("text"))).cast("long").alias("n_terms"),
        F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("n_distinct"),
    )


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rewrite every seventh note with its text doubled and no title; document lengths after."""
    base = I.postings(M.entities(spark, d).where(F.col("entity_type") == "note"))
    changed = M.notes(spark, d).where(F.col("id") % 7 == 0)
    new = changed.select(
        F.lit("note").alias("entity_type"), F.col("id").alias("entity_id"), F.concat_ws(" ", "text", "text").alias("text")
    )
    return I.doc_stats(I.upsert(base, new))


def index_remove(spark: SparkSession, d: str) -> DataFrame:
    base = I.postings(M.entities(spark, d).where(F.col("entity_type") == "note"))
    gone = M.notes(spark, d).where(F.col("id") % 3 == 0).select(
        F.lit("note").alias("entity_type"), F.col("id").alias("entity_id")
    )
    return I.term_df(I.remove(base, gone))


def _hybrid(**kw):
    def run(spark: SparkSession, d: str) -> DataFrame:
        extra = dict(kw)
        if extra.pop("acl", False):
            extra["allowed_files"] = M.files(spark, d).where(~F.col("private")).select("id")
            extra["allowed_notes"] = M.notes(spark, d).where(F.col("id") % 5 != 0).select("id")
        if extra.pop("vectors", False):
            extra["vector_scores"] = chunk_vector_scores(spark, d)
        rows, _, totals = stored(spark, d)
        found = S.search_all(
            rows, M.files(spark, d), M.notes(spark, d), M.chunks(spark, d), Q, M.AS_OF, totals=totals, **extra
        )
        return found.limit(50).select("type", "id", "title", "score")

    return run


def _title_boost_sql(title: str) -> str:
    parts = " + ".join(
        f"CASE WHEN instr(lower({title}), '{t.lower()}') = 1 THEN 2.2 WHEN instr(lower({title}), '{t.lower()}') > 1 THEN 1.1 ELSE 0 END"
        for t in X.query_terms(Q)
    )
    return f"least(6, {parts})"


_TAG_SQL = "len(list_filter(tags, lambda t: " + " OR ".join(f"contains(lower(t), '{t.lower()}')" for t in X.query_terms(Q)) + "))"
_DAYS = f"(epoch_us(TIMESTAMP '{M.AS_OF}') - epoch_us(updated_at)) / 86400e6"
_RECENCY_SQL = f"CASE WHEN {_DAYS} <= 1 THEN 0.35 WHEN {_DAYS} <= 7 THEN 0.22 WHEN {_DAYS} <= 30 THEN 0.12 WHEN {_DAYS} <= 180 THEN 0.04 ELSE 0 END"
_BOOST_SQL = f"{_TAG_SQL} * 0.9 + CASE WHEN pinned THEN 0.5 ELSE 0 END + CASE WHEN starred THEN 0.3 ELSE 0 END + {_RECENCY_SQL}"


def _items_sql(files: str = "", notes: str = "", vectors: bool = False, words: bool = True) -> str:
    """Common table expressions up to ``items`` (type, id, title, updated_at, score)."""
    keep = "" if words else " WHERE FALSE"
    near = f"""SELECT vec_id * 10000000 AS chunk_id, list_sum(list_transform(list_zip(embedding, qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS s
  FROM embeddings, (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"""
    vector = (
        f"SELECT file_id AS id, 0 AS own, 0 AS chunk, s * 4.2 AS vector FROM (SELECT * FROM ({near}) WHERE s >= 0.08 ORDER BY s DESC, chunk_id LIMIT 80) JOIN chunks USING (chunk_id)"
        if vectors
        else "SELECT 0, 0, 0, 0 WHERE FALSE"
    )
    return f"""WITH {INDEX_SQL}{bm25_sql("fb", "file", TERMS)}{bm25_sql("cb", "chunk", TERMS)}{bm25_sql("nb", "note", TERMS)}, s AS (
  SELECT id, sum(own) + sum(chunk) * 0.85 + max(vector) AS base FROM (
    SELECT entity_id AS id, score AS own, 0 AS chunk, 0 AS vector FROM fb{keep}
    UNION ALL SELECT file_id, 0, score, 0 FROM (SELECT * FROM cb{keep}) JOIN chunks ON chunk_id = entity_id
    UNION ALL {vector}) GROUP BY id
), items AS (
  SELECT 'file' AS type, id, title, updated_at, base + {_title_boost_sql("title")} + {_BOOST_SQL} AS score
  FROM files JOIN s USING (id) WHERE NOT deleted {files}
  UNION ALL
  SELECT 'note', id, title, updated_at, score + {_title_boost_sql("title")} * 1.15 + {_BOOST_SQL}
  FROM notes JOIN (SELECT * FROM nb{keep}) nb ON nb.entity_id = id WHERE NOT deleted {notes}
)"""


def _hybrid_oracle(files: str = "", notes: str = "", vectors: bool = False, words: bool = True) -> str:
    return f"""{_items_sql(files, notes, vectors, words)}
SELECT type, id, title, round(score, 4) AS score FROM items WHERE score > 0
ORDER BY round(items.score, 4) DESC, updated_at DESC, type, id LIMIT 50"""


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of files of two kinds, with the total, matched terms and highlighted snippets."""
    files, notes, chunks = M.files(spark, d), M.notes(spark, d), M.chunks(spark, d)
    rows, _, totals = stored(spark, d)
    found = S.search_all(rows, files, notes, chunks, Q, M.AS_OF, totals=totals, types=("file",), exts=["MD", "txt"])
    shown = S.with_snippets(S.page(found, 10, 10), files, notes, chunks, Q)
    return shown.select("type", "id", "score", F.array_join("hits", ",").alias("hits"), "best_chunk", "total", "snippet")


def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return S.recent(M.files(spark, d), 7, M.AS_OF).select("id", F.col("updated_at").cast("date").cast("string").alias("day"))


def suggest_tags(spark: SparkSession, d: str) -> DataFrame:
    return S.suggest_tags(M.files(spark, d), M.notes(spark, d), "TA", 8)


def retrieve_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval for a user who may not see private files, from a least score on."""
    rows, _, totals = stored(spark, d)
    open_ = M.files(spark, d).where(~F.col("private")).select("id")
    return S.retrieve(
        rows, M.chunks(spark, d), M.files(spark, d), Q, chunk_vector_scores(spark, d), 20, totals=totals, allowed_files=open_, min_score=2.0
    )


def retrieve_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval within four files, one of them trashed: each of the others is represented."""
    rows, _, totals = stored(spark, d)
    found = S.retrieve(rows, M.chunks(spark, d), M.files(spark, d), "zzz qqq", None, 6, file_ids=[3, 5, 11, 29], totals=totals)
    return found.select("chunk_id", "file_id", "score")


def fuzzy_fallback(spark: SparkSession, d: str) -> DataFrame:
    return S.fallback(M.files(spark, d), M.notes(spark, d), "hean ")


def suggest_union(spark: SparkSession, d: str) -> DataFrame:
    return S.suggest(M.files(spark, d), M.notes(spark, d), "the", 8).select("type", "id", "title")


def chunk_vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dot products of the vector of id 0 with all vectors, which belong to first lines."""
    vectors = M.table(spark, d, "embeddings").select("vec_id", "embedding")
    query = vectors.where(F.col("vec_id") == 0).select(F.col("embedding").alias("q"))  # one row
    return vectors.crossJoin(F.broadcast(query)).select(
        (F.col("vec_id") * 10_000_000).alias("chunk_id"), V.dot(F.col("embedding"), F.col("q")).alias("score")
    )


def rrf_retrieve(spark: SparkSession, d: str) -> DataFrame:
    rows, _, totals = stored(spark, d)
    return S.retrieve(
        rows, M.chunks(spark, d), M.files(spark, d), Q, chunk_vector_scores(spark, d), top_k=20, totals=totals
    )


_HITS_SQL = " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in sorted(set(TERMS)))
RRF_SQL = f"""WITH {INDEX_SQL}{bm25_sql("cb", "chunk", TERMS)}, w AS (
  SELECT entity_id AS chunk_id, score AS bm25, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, entity_id)) AS wr
  FROM cb ORDER BY score DESC, entity_id LIMIT 200
), q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0
), dots AS (
  SELECT vec_id * 10000000 AS chunk_id,
    list_sum(list_transform(list_zip(embedding, qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS score
  FROM embeddings, q
), v AS (
  SELECT chunk_id, score AS vec, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS vr
  FROM dots WHERE score > 0.05 ORDER BY score DESC, chunk_id LIMIT 200
), fused AS (
  SELECT coalesce(w.chunk_id, v.chunk_id) AS chunk_id, coalesce(bm25, 0) AS bm25, coalesce(vec, 0) AS vec,
    coalesce(wr, 0) + coalesce(vr, 0) AS rrf FROM w FULL JOIN v ON w.chunk_id = v.chunk_id
), scored AS (
  SELECT c.chunk_id, c.file_id, bm25, vec, rrf, round(rrf * 10 + least(2, bm25 * 0.12) + vec * 3.2
    + ({_HITS_SQL}) / {len(set(TERMS))} * 1.6 + CASE WHEN pinned THEN 0.15 ELSE 0 END + CASE WHEN starred THEN 0.08 ELSE 0 END, 4) AS score
  FROM fused JOIN chunks c USING (chunk_id) JOIN (SELECT id, pinned, starred FROM files WHERE NOT deleted) f ON f.id = c.file_id
), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_id) AS r FROM scored)
SELECT chunk_id, file_id, score, round(bm25, 4) AS bm25, round(vec, 4) AS vec, round(rrf, 6) AS rrf
FROM r WHERE r <= 4 ORDER BY r.score DESC, chunk_id LIMIT 20"""


def scoped_fallback(spark: SparkSession, d: str) -> DataFrame:
    return S.scoped_fallback(M.chunks(spark, d), [3, 5, 11], 8).select("chunk_id", "file_id", "idx")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    best = chunk_vector_scores(spark, d).where(F.col("score") >= 0.08).orderBy(F.desc("score"), "chunk_id").limit(60)
    return best.select("chunk_id", F.round("score", 6).alias("score"))


def centroid_related(spark: SparkSession, d: str) -> DataFrame:
    """Vectors nearest to the mean of label 0's first 24 vectors: the best of each other label."""
    vectors = M.table(spark, d, "embeddings")
    own = vectors.where(F.col("label") == 0).orderBy("vec_id").limit(24)
    center = V.centroid(own, "label", "embedding").select("centroid")
    scored = vectors.where(F.col("label") != 0).crossJoin(F.broadcast(center))
    dots = scored.select("label", V.dot(F.col("embedding"), F.col("centroid")).alias("s"))
    return dots.groupBy("label").agg(F.round(F.max("s"), 5).alias("score")).orderBy(F.desc("score"), "label").limit(6)


def graph_edges_top3(spark: SparkSession, d: str) -> DataFrame:
    """Between the labels' centroids (ten first vectors): the three best of each node, i < j."""
    w = Window.partitionBy("label").orderBy("vec_id")
    first = M.table(spark, d, "embeddings").withColumn("r", F.row_number().over(w)).where(F.col("r") <= 10)
    nodes = V.centroid(first, "label", "embedding")
    return S.graph_edges(nodes, "label", "centroid", min_score=-1.0)


def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    words = M.table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return words.select(
        "term", V.fnv1a(F.col("term")).alias("h1"), V.fnv1a(F.col("term"), V.SECOND_SEED).alias("h2")
    )


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hash_features(M.table(spark, d, "benchmark"), "item_id", "text")
    return rows.select("item_id", "idx", F.round("w", 6).alias("w"))


def _fnv_sql(x: str, seed: int) -> str:
    return (
        f"list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT))), "
        "lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    )


HASH_SQL = f"""WITH t AS (
  SELECT item_id, t, count(*) AS tf FROM (SELECT item_id, unnest({tokens_sql("text")}) AS t FROM benchmark) GROUP BY ALL
), w AS (SELECT item_id, t, (1 + ln(tf)) * CASE WHEN length(t) >= 2 THEN 1 ELSE 0.55 END AS w FROM t
), f AS (
  SELECT item_id, t AS f, w, TRUE AS twice FROM w
  UNION ALL SELECT item_id, '#' || substr(t, i, 3), 0.35 * w, FALSE
  FROM (SELECT item_id, t, w, unnest(range(1, length(t) - 1)) AS i FROM w WHERE length(t) >= 3)
), h AS (SELECT item_id, w, twice, {_fnv_sql("f", V.FNV_OFFSET)} AS h1, {_fnv_sql("f", V.SECOND_SEED)} AS h2 FROM f
), e AS (
  SELECT item_id, h1 % 512 AS idx, CASE WHEN (h2 >> 31) = 0 THEN w ELSE -w END AS w FROM h
  UNION ALL SELECT item_id, (h1 + h2) % 512, CASE WHEN (h2 >> 31) = 0 THEN w ELSE -w END * 0.5 FROM h WHERE twice
), s AS (SELECT item_id, CAST(idx AS INT) AS idx, sum(w) AS w FROM e GROUP BY ALL
), n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY item_id)
SELECT item_id, idx, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 6) AS w FROM s JOIN n USING (item_id)"""


def keyword_report(spark: SparkSession, d: str) -> DataFrame:
    """Per note: every term, its frequency and its share of the note's greatest frequency."""
    tf = I.postings(M.entities(spark, d).where(F.col("entity_type") == "note"))
    w = Window.partitionBy("entity_id")
    return tf.select("entity_id", "term", "tf", F.round(F.col("tf") / F.max("tf").over(w), 3).alias("ratio"))


def extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Ranked terms (weight, then first occurrence) with the greedy rule against containment."""
    notes = M.table(spark, d, "benchmark").select("item_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "t"))
    tf = notes.groupBy("item_id", "t").agg(F.count("*").alias("tf"), F.min("pos").alias("pos")).where(F.length("t") >= 2)
    ranked = tf.select("item_id", F.struct((-F.round(X.keyword_weight(F.col("t"), F.col("tf")), 9)).alias("w"), "pos", "t").alias("k"))
    lists = ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["t"]).alias("all"))
    return lists.select("item_id", F.array_join(X.keywords_of(F.col("all"), 12), ",").alias("keywords"))


def boosts(spark: SparkSession, d: str) -> DataFrame:
    terms = X.query_terms(Q)
    return M.files(spark, d).select(
        "id",
        F.round(S.title_boost(F.col("title"), terms), 4).alias("title_boost"),
        S.recency_boost(F.col("updated_at"), M.AS_OF).alias("recency_boost"),
        S.matched_tags(F.col("tags"), ["tag1", "topic"]).cast("long").alias("n_tags"),
    )


def anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    """Per language, lines that hold a query term literally."""
    hit = M.chunks(spark, d).where(S.contains_any(F.col("text"), X.query_terms(Q)))
    return hit.groupBy("workspace").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_id").alias("n_files"))


_DOT_XY = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

QUERIES = {
    "index_build": index_build,
    "bm25_files": bm25_files,
    "bm25_file_scores": _bm25("file"),
    "bm25_note_scores": _bm25("note"),
    "bm25_chunk_scores": _bm25("chunk"),
    "bm25_chunks_rollup": bm25_chunks_rollup,
    "term_df_top": term_df_top,
    "doc_stats": doc_stats,
    "corpus_stats": corpus_stats,
    "token_counts": token_counts,
    "index_upsert": index_upsert,
    "index_remove": index_remove,
    "hybrid_search": _hybrid(),
    "hybrid_search_filtered": _hybrid(workspaces=["en"], tags=["TOPIC1", "tag2"], starred_only=True),
    "hybrid_search_acl": _hybrid(acl=True),
    "hybrid_vector": _hybrid(vectors=True),
    "search_notes_only": _hybrid(types=("note",)),
    "search_exts": _hybrid(exts=["MD", "csv"]),
    "vector_only": _hybrid(vectors=True, mode="vector"),
    "search_page": search_page,
    "recent_files": recent_files,
    "suggest_tags": suggest_tags,
    "retrieve_allowed": retrieve_allowed,
    "retrieve_scoped": retrieve_scoped,
    "fuzzy_fallback": fuzzy_fallback,
    "suggest_union": suggest_union,
    "rrf_retrieve": rrf_retrieve,
    "scoped_fallback": scoped_fallback,
    "cosine_topk": cosine_topk,
    "centroid_related": centroid_related,
    "graph_edges_top3": graph_edges_top3,
    "fnv_hash": fnv_hash,
    "hash_embed": hash_embed,
    "keyword_report": keyword_report,
    "extract_keywords": extract_keywords,
    "search_boosts": boosts,
    "vector_anchor_filter": anchor_filter,
}

_SNIPPET_AT = "list_min(list_filter([" + ", ".join(
    f"[instr(lower(text), '{t.lower()}'), {i}, {len(t)}]" for i, t in enumerate(X.query_terms(Q))
) + "], lambda x: x[1] > 0))"

_MARKED_SQL = f"""replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(sn, '({"|".join(X.query_terms(Q))})', chr(1) || '\\1' || chr(2), 'gi'),
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(1), '<mark>'), chr(2), '</mark>')"""

ORACLE_SQL = {
    "index_build": f"WITH {INDEX_SQL} SELECT entity_type, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tokens FROM posted GROUP BY entity_type",
    "bm25_files": f"""WITH {INDEX_SQL}{bm25_sql("b", "file", TERMS)}, best AS (
  SELECT entity_id, round(score, 6) AS score FROM b ORDER BY round(b.score, 6) DESC, entity_id LIMIT 20
), s AS (SELECT entity_id, title, score, text, {_SNIPPET_AT} AS m FROM best JOIN files ON id = entity_id
), k AS (SELECT *, greatest(0, m[1] - 1 - 120) AS st, least(length(text), m[1] - 1 + m[3] + 120) AS en FROM s
), n AS (
  SELECT entity_id, title, score, CASE WHEN m IS NULL THEN substr(text, 1, 220) || CASE WHEN length(text) > 220 THEN '…' ELSE '' END
    ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, st + 1, en - st) || CASE WHEN en < length(text) THEN '…' ELSE '' END END AS sn FROM k
)
SELECT entity_id, title, score, {_MARKED_SQL} AS snippet FROM n""",
    "bm25_file_scores": _bm25_oracle("file"),
    "bm25_note_scores": _bm25_oracle("note"),
    "bm25_chunk_scores": _bm25_oracle("chunk"),
    "bm25_chunks_rollup": f"""WITH {INDEX_SQL}{bm25_sql("cb", "chunk", TERMS)}, r AS (
  SELECT file_id, chunk_id, score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_id) AS r
  FROM cb JOIN chunks ON chunk_id = entity_id)
SELECT file_id, round(sum(score) * 0.85, 6) AS chunk_score, min(chunk_id) FILTER (r = 1) AS best_chunk,
  array_to_string(list_sort(list(chunk_id) FILTER (r <= 3)), ',') AS top_chunks FROM r GROUP BY file_id""",
    "term_df_top": f"WITH {INDEX_SQL} SELECT term, df FROM dfs ORDER BY df DESC, term LIMIT 100",
    "doc_stats": f"WITH {INDEX_SQL} SELECT entity_type, entity_id, CAST(len AS BIGINT) AS len FROM stats",
    "corpus_stats": f"WITH {INDEX_SQL} SELECT entity_type, n, round(avgdl, 6) AS avgdl FROM totals",
    "token_counts": f"""SELECT doc_id, len({tokens_sql("text", False)}) AS n_all, len({tokens_sql("text")}) AS n_terms,
  len(list_distinct({tokens_sql("text")})) AS n_distinct FROM documents""",
    "index_upsert": f"""WITH {M.MODEL_SQL}, e AS (
  SELECT id, CASE WHEN id % 7 = 0 THEN text || ' ' || text ELSE title || chr(10) || title || chr(10) || text END AS text FROM notes)
SELECT 'note' AS entity_type, id AS entity_id, CAST(len({tokens_sql("text")}) AS BIGINT) AS len FROM e WHERE len({tokens_sql("text")}) > 0""",
    "index_remove": f"""WITH {INDEX_SQL} SELECT term, count(*) AS df FROM posted WHERE entity_type = 'note' AND entity_id % 3 <> 0 GROUP BY term""",
    "hybrid_search": _hybrid_oracle(),
    "hybrid_search_filtered": _hybrid_oracle(
        "AND workspace = 'en' AND starred AND len(list_filter(tags, lambda t: lower(t) IN ('topic1', 'tag2'))) > 0",
        "AND workspace = 'en' AND starred AND len(list_filter(tags, lambda t: lower(t) IN ('topic1', 'tag2'))) > 0",
    ),
    "hybrid_search_acl": _hybrid_oracle("AND NOT private", "AND id % 5 <> 0"),
    "hybrid_vector": _hybrid_oracle(vectors=True),
    "search_notes_only": _hybrid_oracle("AND FALSE"),
    "search_exts": _hybrid_oracle("AND ext IN ('md', 'csv')", "AND FALSE"),
    "vector_only": _hybrid_oracle(vectors=True, words=False),
    "search_page": f"""{_items_sql("AND ext IN ('md', 'txt')", "AND FALSE")}, pg AS (
  SELECT type, id, score, (SELECT count(*) FROM items WHERE score > 0) AS total FROM items WHERE score > 0
  ORDER BY round(items.score, 4) DESC, updated_at DESC, type, id LIMIT 10 OFFSET 10
), hb AS (
  SELECT id, list_sort(list_distinct(flatten(list(hits)))) AS hits FROM (
    SELECT entity_id AS id, hits FROM fb UNION ALL SELECT file_id, hits FROM cb JOIN chunks ON chunk_id = entity_id) GROUP BY id
), bc AS (
  SELECT file_id AS id, chunk_id AS best_chunk, text AS chunk_text FROM cb JOIN chunks ON chunk_id = entity_id
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_id) = 1
), t AS (
  SELECT pg.*, hits, best_chunk, coalesce(chunk_text, files.text) AS text FROM pg JOIN files USING (id) LEFT JOIN hb USING (id) LEFT JOIN bc USING (id)
), s2 AS (SELECT *, {_SNIPPET_AT} AS m FROM t
), k AS (SELECT *, greatest(0, m[1] - 1 - 120) AS st, least(length(text), m[1] - 1 + m[3] + 120) AS en FROM s2
), n AS (
  SELECT *, CASE WHEN m IS NULL THEN substr(text, 1, 220) || CASE WHEN length(text) > 220 THEN '…' ELSE '' END
    ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(text, st + 1, en - st) || CASE WHEN en < length(text) THEN '…' ELSE '' END END AS sn FROM k
)
SELECT type, id, round(score, 4) AS score, array_to_string(hits[1:12], ',') AS hits, best_chunk, total, {_MARKED_SQL} AS snippet FROM n""",
    "recent_files": f"WITH {M.MODEL_SQL} SELECT id, CAST(CAST(updated_at AS DATE) AS VARCHAR) AS day FROM files WHERE updated_at >= TIMESTAMP '{M.AS_OF}' - INTERVAL 7 DAY",
    "suggest_tags": f"""WITH {M.MODEL_SQL}, t AS (SELECT unnest(tags) AS tag FROM files UNION SELECT unnest(tags) FROM notes)
SELECT tag FROM t WHERE contains(lower(tag), 'ta') ORDER BY tag LIMIT 8""",
    "retrieve_allowed": RRF_SQL.replace("FROM files WHERE NOT deleted", "FROM files WHERE NOT deleted AND NOT private").replace(
        "FROM scored)", "FROM scored WHERE score >= 2)"
    ),
    "retrieve_scoped": f"""WITH {M.MODEL_SQL}, r AS (
  SELECT chunk_id, file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS r FROM chunks
  WHERE file_id IN (3, 5, 11, 29) AND file_id IN (SELECT id FROM files WHERE NOT deleted))
SELECT chunk_id, file_id, 0.0::DOUBLE AS score FROM r WHERE r <= 2 ORDER BY file_id, idx LIMIT 6""",
    "fuzzy_fallback": f"""WITH {M.MODEL_SQL}
SELECT * FROM (SELECT 'file' AS type, id, CASE WHEN contains(lower(title), 'hean ') THEN 1.6 ELSE 0.9 END AS score FROM files
  WHERE NOT deleted AND (contains(lower(title), 'hean ') OR contains(lower(text), 'hean ')) ORDER BY score DESC, id LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'note', id, CASE WHEN contains(lower(title), 'hean ') THEN 1.6 ELSE 0.9 END AS score FROM notes
  WHERE NOT deleted AND (contains(lower(title), 'hean ') OR contains(lower(text), 'hean ')) ORDER BY score DESC, id LIMIT 200)""",
    "suggest_union": f"""WITH {M.MODEL_SQL}, u AS (
  SELECT 'file' AS type, id, title, updated_at FROM files WHERE NOT deleted AND contains(lower(title), 'the')
  UNION ALL SELECT 'note', id, title, updated_at FROM notes WHERE NOT deleted AND contains(lower(title), 'the'))
SELECT type, id, title FROM u ORDER BY updated_at DESC, type, id LIMIT 8""",
    "rrf_retrieve": RRF_SQL,
    "scoped_fallback": f"""WITH {M.MODEL_SQL}, r AS (
  SELECT chunk_id, file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS r FROM chunks WHERE file_id IN (3, 5, 11))
SELECT chunk_id, file_id, idx FROM r WHERE r <= 3 ORDER BY file_id, idx LIMIT 8""",
    "cosine_topk": f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id * 10000000 AS chunk_id, {_DOT_XY.format(a="embedding", b="qv")} AS score FROM embeddings, q)
SELECT chunk_id, round(score, 6) AS score FROM s WHERE score >= 0.08 ORDER BY s.score DESC, chunk_id LIMIT 60""",
    "centroid_related": f"""WITH own AS (SELECT embedding AS e FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 24),
p AS (SELECT i, avg(CAST(e[i] AS DOUBLE)) AS x FROM own, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
c AS (SELECT list(x ORDER BY i) AS c FROM p)
SELECT label, round(max({_DOT_XY.format(a="embedding", b="c")}), 5) AS score FROM embeddings, c WHERE label <> 0
GROUP BY label ORDER BY score DESC, label LIMIT 6""",
    "graph_edges_top3": f"""WITH f AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM f, (SELECT unnest(range(1, 65)) AS i) WHERE r <= 10 GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label),
s AS (SELECT a.label AS i, b.label AS j, {_DOT_XY.format(a="a.c", b="b.c")} AS s FROM c a JOIN c b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS r FROM s WHERE s > -1)
SELECT i, j, round(s, 3) AS weight FROM r WHERE r <= 3 AND i < j""",
    "fnv_hash": f"""WITH t AS (SELECT DISTINCT unnest({tokens_sql("text")}) AS term FROM benchmark)
SELECT term, {_fnv_sql("term", V.FNV_OFFSET)} AS h1, {_fnv_sql("term", V.SECOND_SEED)} AS h2 FROM t""",
    "hash_embed": HASH_SQL,
    "keyword_report": f"""WITH {INDEX_SQL} SELECT entity_id, term, tf, round(tf / max(tf) OVER (PARTITION BY entity_id), 3) AS ratio
FROM posted WHERE entity_type = 'note'""",
    "extract_keywords": f"""WITH RECURSIVE t AS (
  SELECT item_id, ts[pos] AS t, pos FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT item_id, {tokens_sql("text")} AS ts FROM benchmark))
), k AS (
  SELECT item_id, t, min(pos) AS pos, count(*) AS tf FROM t WHERE length(t) >= 2 GROUP BY ALL
), a AS (
  SELECT item_id, list(t ORDER BY round(tf * CASE WHEN length(t) >= 3 THEN 1.6 ELSE 1.2 END * ln(2 + length(t)), 9) DESC, pos, t) AS ts FROM k GROUP BY item_id
), g AS (
  SELECT item_id, ts, 1 AS i, CAST([] AS VARCHAR[]) AS chosen FROM a
  UNION ALL
  SELECT item_id, ts, i + 1, CASE WHEN len(chosen) >= 12 OR len(list_filter(chosen, lambda c: contains(c, ts[i]) OR contains(ts[i], c))) > 0
    THEN chosen ELSE list_append(chosen, ts[i]) END FROM g WHERE i <= len(ts)
)
SELECT item_id, array_to_string(chosen, ',') AS keywords FROM g WHERE i = len(ts) + 1""",
    "search_boosts": f"""WITH {M.MODEL_SQL} SELECT id, round({_title_boost_sql("title")}, 4) AS title_boost, CAST({_RECENCY_SQL} AS DOUBLE) AS recency_boost,
  len(list_filter(tags, lambda t: contains(lower(t), 'tag1') OR contains(lower(t), 'topic'))) AS n_tags FROM files""",
    "vector_anchor_filter": f"""WITH {M.MODEL_SQL} SELECT workspace, count(*) AS n_chunks, count(DISTINCT file_id) AS n_files FROM chunks
WHERE {" OR ".join(f"contains(lower(text), '{t.lower()}')" for t in X.query_terms(Q))} GROUP BY workspace""",
}

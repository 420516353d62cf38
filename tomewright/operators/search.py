"""Ranked search: hybrid scoring with boosts, filters and access, fallback, suggestions, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.text import highlight, py_tokens, query_terms, snippet
from tomewright.functions.vector import dot
from tomewright.operators.index import bm25, bm25_of

CHUNK_SHARE, TAG_BOOST, PINNED, STARRED, NOTE_TITLE = 0.85, 0.9, 0.5, 0.3, 1.15
RRF, RECALL = 60, 200
#: Chunks that vectors add to a search, their least score, and matched terms shown.
VECTOR_TOP, VECTOR_MIN, MATCHED_TERMS = 80, 0.08, 12
RECENCY = ((1, 0.35), (7, 0.22), (30, 0.12), (180, 0.04))


def title_boost(title: Column, terms: list[str]) -> Column:
    """2.2 for every term that the title starts with, 1.1 for one inside it, 6 at most."""
    low = F.lower(F.coalesce(title, F.lit("")))
    total = F.lit(0.0)
    for t in terms:
        at = F.instr(low, t.lower())
        total = total + F.when(at == 1, 2.2).when(at > 1, 1.1).otherwise(0.0)
    return F.least(F.lit(6.0), total)


def recency_boost(ts: Column, as_of: str) -> Column:
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / 86_400e6
    out = F.lit(0.0)
    for limit, boost in reversed(RECENCY):
        out = F.when(days <= limit, boost).otherwise(out)
    return F.when(ts.isNull(), 0.0).otherwise(out)


def matched_tags(tags: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    return F.size(
        F.filter(tags, lambda x: _any([F.contains(F.lower(x), F.lit(t.lower())) for t in terms], hit))
    )


def _any(conditions: list[Column], start: Column) -> Column:
    for c in conditions:
        start = start | c
    return start


def chunk_rollup(chunk_scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_score, best_chunk, top_chunks): a file's chunks' scores summed, times 0.85."""
    scored = chunk_scores.join(chunks.select("chunk_id", "file_id"), chunk_scores["entity_id"] == F.col("chunk_id"))
    ranked = scored.withColumn(
        "r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "chunk_id"))
    )
    return ranked.groupBy("file_id").agg(
        (F.sum("score") * CHUNK_SHARE).alias("chunk_score"),
        F.min(F.when(F.col("r") == 1, F.col("chunk_id"))).alias("best_chunk"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("chunk_id")))).alias("top_chunks"),
    )


def search_all(
    posted: DataFrame,
    files: DataFrame,
    notes: DataFrame,
    chunks: DataFrame,
    q: str,
    as_of: str,
    workspaces: list[str] | None = None,
    tags: list[str] | None = None,
    folder: str | None = None,
    starred_only: bool = False,
    allowed_files: DataFrame | None = None,
    vector_scores: DataFrame | None = None,
    totals: DataFrame | None = None,
    types: tuple[str, ...] = ("file", "note"),
    exts: list[str] | None = None,
    mode: str = "hybrid",
    allowed_notes: DataFrame | None = None,
) -> DataFrame:
    """(type, id, title, score, hits, best_chunk): files by own and chunk BM25 plus boosts, notes by BM25 plus boosts.

    ``vector_scores`` (chunk_id, score) are the query's nearest chunks: in ``hybrid`` and
    ``vector`` mode the ``VECTOR_TOP`` best of at least ``VECTOR_MIN`` add 4.2 times a file's
    best; ``vector`` mode takes no keywords, ``keyword`` mode no vectors. ``allowed_files``
    and ``allowed_notes`` (id) restrict what a user may see. A filter by ``exts`` leaves no
    notes. Ordered by score, newest first, type, id; :func:`page` cuts pages.
    """
    terms, toks = query_terms(q), py_tokens(q) if mode != "vector" else []
    found = [_filtered(files, workspaces, tags, folder, starred_only), _filtered(notes, workspaces, tags, folder, starred_only)]
    if exts:
        found[0] = found[0].where(F.lower("ext").isin([e.lower() for e in exts]))
    for i, allowed in enumerate((allowed_files, allowed_notes)):
        if allowed is not None:
            found[i] = found[i].join(allowed.select("id"), "id", "left_semi")
    file_of = chunks.select(F.col("chunk_id").alias("entity_id"), F.col("file_id").alias("id"))
    shape = "type", "id", "own", "chunk", "vector", "hits", "best"
    none = F.lit(None)
    whole = bm25_of(posted, toks, [t for t in ("file", "note") if t in types], totals).select(
        F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), F.col("score").alias("own"),
        F.lit(0.0).alias("chunk"), F.lit(0.0).alias("vector"), "hits", none.cast("struct<s:double,k:bigint>").alias("best"),
    )
    parts = [whole]
    if "file" in types:
        of_chunks = bm25_of(posted, toks, ["chunk"], totals).join(file_of, "entity_id")
        best = F.struct(F.col("score").alias("s"), (-F.col("entity_id")).alias("k"))
        parts.append(of_chunks.select(F.lit("file").alias("type"), "id", F.lit(0.0).alias("own"), F.col("score").alias("chunk"), F.lit(0.0).alias("vector"), "hits", best.alias("best")))
        if vector_scores is not None and mode != "keyword":
            near = vector_scores.where(F.col("score") >= VECTOR_MIN).orderBy(F.desc("score"), "chunk_id").limit(VECTOR_TOP)
            near = near.select(F.col("chunk_id").alias("entity_id"), (F.col("score") * 4.2).alias("score")).join(file_of, "entity_id")
            empty = F.array().cast("array<string>").alias("hits")
            parts.append(near.select(F.lit("file").alias("type"), "id", F.lit(0.0).alias("own"), F.lit(0.0).alias("chunk"), F.col("score").alias("vector"), empty, best.alias("best")))
    every = parts[0].select(*shape)
    for p in parts[1:]:
        every = every.unionByName(p.select(*shape))
    scores = every.groupBy("type", "id").agg(
        (F.sum("own") + F.sum("chunk") * CHUNK_SHARE + F.max("vector")).alias("base"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        (-F.max("best")["k"]).alias("best_chunk"),
    )
    boost = (
        matched_tags(F.col("tags"), terms) * TAG_BOOST
        + F.when(F.col("pinned"), PINNED).otherwise(0.0)
        + F.when(F.col("starred"), STARRED).otherwise(0.0)
        + recency_boost(F.col("updated_at"), as_of)
    )

    def items(df: DataFrame, kind: str, title_weight: float) -> DataFrame:
        score = F.col("base") + title_boost(F.col("title"), terms) * title_weight + boost
        of = scores.where(F.col("type") == kind).drop("type")
        return df.join(of, "id").select(
            F.lit(kind).alias("type"), "id", "title", "updated_at", score.alias("score"),
            F.slice("hits", 1, MATCHED_TERMS).alias("hits"), "best_chunk",
        )

    out = items(found[0], "file", 1.0) if "file" in types else None
    if "note" in types and not exts:
        of_notes = items(found[1], "note", NOTE_TITLE)
        out = of_notes if out is None else out.unionByName(of_notes)
    if out is None:
        out = items(found[0].where(F.lit(False)), "file", 1.0)
    return (
        out.where(F.col("score") > 0)
        .orderBy(F.desc(F.round("score", 4)), F.desc("updated_at"), "type", "id")
        .select("type", "id", "title", F.round("score", 4).alias("score"), "hits", "best_chunk", "updated_at")
    )


def page(ranked: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """One page of a ranked result with the total of all pages."""
    total = F.broadcast(ranked.agg(F.count("*").alias("total")))  # one row
    return ranked.offset(offset).limit(limit).crossJoin(total)


def with_snippets(found: DataFrame, files: DataFrame, notes: DataFrame, chunks: DataFrame, q: str) -> DataFrame:
    """``found`` (a page: few rows) with ``snippet``, highlighted: of the best chunk, else of the item's text."""
    terms = query_terms(q)
    texts = files.select(F.lit("file").alias("type"), "id", "text").unionByName(
        notes.select(F.lit("note").alias("type"), "id", "text")
    )
    best = chunks.select(F.col("chunk_id").alias("best_chunk"), F.col("text").alias("chunk_text"))
    few = F.broadcast(found)  # a page
    own = texts.join(few.select("type", "id"), ["type", "id"])
    cut = best.join(few.select("best_chunk").where(F.col("best_chunk").isNotNull()).distinct(), "best_chunk")
    joined = found.join(own, ["type", "id"], "left").join(cut, "best_chunk", "left")
    shown = highlight(snippet(F.coalesce("chunk_text", "text"), terms, 120, 220), terms)
    return joined.select(*found.columns, shown.alias("snippet"))


def recent(df: DataFrame, days: int, as_of: str, ts: str = "updated_at") -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def _filtered(df: DataFrame, workspaces, tags, folder, starred_only) -> DataFrame:
    out = df.where(~F.col("deleted"))
    if workspaces:
        out = out.where(F.col("workspace").isin(workspaces))
    if tags:
        wanted = [t.lower() for t in tags]
        out = out.where(F.exists("tags", lambda t: F.lower(t).isin(wanted)))
    if folder not in (None, "all"):
        out = out.where(F.col("folder") == folder)
    return out.where(F.col("starred")) if starred_only else out


def fallback(files: DataFrame, notes: DataFrame, q: str, limit: int = 200) -> DataFrame:
    """Substring matches: 1.6 if the title contains the query, 0.9 if only the text does."""
    low = q.lower()

    def of(df: DataFrame, kind: str) -> DataFrame:
        in_title = F.contains(F.lower("title"), F.lit(low))
        return (
            df.where(~F.col("deleted") & (in_title | F.contains(F.lower("text"), F.lit(low))))
            .select(F.lit(kind).alias("type"), "id", F.when(in_title, 1.6).otherwise(0.9).alias("score"))
            .orderBy(F.desc("score"), "id")
            .limit(limit)
        )

    return of(files, "file").unionByName(of(notes, "note"))


def search_or_fallback(ranked: DataFrame, files: DataFrame, notes: DataFrame, q: str) -> DataFrame:
    """``ranked``, or the substring matches if it is empty and the query has two characters."""
    plain = ranked.select("type", "id", "score")
    if len(q) < 2 or not ranked.isEmpty():
        return plain
    return fallback(files, notes, q)


def suggest_tags(files: DataFrame, notes: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Tags that contain the prefix, by name."""
    used = files.select(F.explode("tags").alias("tag")).union(notes.select(F.explode("tags").alias("tag")))
    return used.where(F.contains(F.lower("tag"), F.lit(prefix.lower()))).distinct().orderBy("tag").limit(limit)


def suggest(files: DataFrame, notes: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Newest live titles that contain the prefix, files and notes together."""

    def of(df: DataFrame, kind: str) -> DataFrame:
        hit = ~F.col("deleted") & F.contains(F.lower("title"), F.lit(prefix.lower()))
        return df.where(hit).select(F.lit(kind).alias("type"), "id", "title", "updated_at")

    both = of(files, "file").unionByName(of(notes, "note"))
    return both.orderBy(F.desc("updated_at"), "type", "id").limit(limit)


def vector_topk(vectors: DataFrame, query: list[float], k: int, min_score: float, vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of the largest dot product with a literal vector, at least ``min_score``."""
    score = dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return (
        vectors.withColumn("score", score)
        .where(F.col("score") >= min_score)
        .orderBy(F.desc("score"), vectors.columns[0])
        .limit(k)
    )


def contains_any(text: Column, terms: list[str]) -> Column:
    """A term of two characters or more occurs literally (true if there is none)."""
    anchors = [t.lower() for t in terms if len(t) >= 2]
    return _any([F.contains(F.lower(text), F.lit(t)) for t in anchors], F.lit(False)) if anchors else F.lit(True)


def retrieve(
    posted: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    q: str,
    vector_scores: DataFrame | None = None,
    top_k: int = 8,
    per_file: int = 4,
    workspaces: list[str] | None = None,
    file_ids: list[int] | None = None,
    totals: DataFrame | None = None,
    allowed_files: DataFrame | None = None,
    min_score: float = 0.0,
) -> DataFrame:
    """(chunk_id, file_id, score, bm25, vec, rrf): reciprocal ranks fused, reranked, diverse.

    Ranks come before the workspace, file and access filters (``allowed_files``: id). Each
    recall list is its 200 best (a bounded top-k), so what follows works on 400 chunks at
    most. With ``file_ids`` the files that no chunk was found of get their first chunks: one
    each, or a share of ``top_k`` if nothing was found at all.
    """
    toks = sorted(set(py_tokens(q)))

    def ranked(df: DataFrame, name: str) -> DataFrame:
        best = df.orderBy(F.desc("score"), "chunk_id").limit(RECALL)
        return best.select(
            "chunk_id",
            F.col("score").alias(name),
            (1.0 / (RRF + F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))).alias(f"{name}_rrf"),
        )

    words = bm25(posted, toks, "chunk", totals).select(F.col("entity_id").alias("chunk_id"), "score")
    fused = ranked(words, "bm25")
    if vector_scores is not None:
        near = vector_scores.where(F.col("score") > 0.05).select("chunk_id", "score")
        fused = fused.join(ranked(near, "vec"), "chunk_id", "full_outer")
    else:
        fused = fused.withColumn("vec", F.lit(0.0)).withColumn("vec_rrf", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fused = fused.select("chunk_id", zero("bm25").alias("bm25"), zero("vec").alias("vec"), (zero("bm25_rrf") + zero("vec_rrf")).alias("rrf"))
    live = files.where(~F.col("deleted"))
    if workspaces:
        live = live.where(F.col("workspace").isin(workspaces))
    if file_ids:
        live = live.where(F.col("id").isin(file_ids))
    if allowed_files is not None:
        live = live.join(allowed_files.select("id"), "id", "left_semi")
    found = fused.join(chunks.select("chunk_id", "file_id", "text"), "chunk_id").join(
        live.select(F.col("id").alias("file_id"), "pinned", "starred"), "file_id"
    )
    hits = F.lit(0)
    for t in toks:
        hits = hits + F.contains(F.lower("text"), F.lit(t)).cast("int")
    score = (
        F.col("rrf") * 10
        + F.least(F.lit(2.0), F.col("bm25") * 0.12)
        + F.col("vec") * 3.2
        + hits / max(1, len(toks)) * 1.6
        + F.when(F.col("pinned"), 0.15).otherwise(0.0)
        + F.when(F.col("starred"), 0.08).otherwise(0.0)
    )
    scored = found.withColumn("raw", score).where(F.col("raw") >= min_score).withColumn("score", F.round("raw", 4))
    order = [F.desc("score"), F.col("chunk_id")]
    diverse = scored.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)))
    picked = (
        diverse.where(F.col("r") <= per_file)
        .orderBy(*order)
        .limit(top_k)
        .select(
            "chunk_id",
            "file_id",
            "score",
            F.round("bm25", 4).alias("bm25"),
            F.round("vec", 4).alias("vec"),
            F.round("rrf", 6).alias("rrf"),
        )
    )
    if not file_ids:
        return picked
    covered = {r["file_id"] for r in picked.select("file_id").distinct().collect()}  # top_k at most
    missing = [i for i in file_ids if i not in covered]
    if not missing:
        return picked
    more = scoped_fallback(chunks, missing, len(missing) if covered else top_k, live.select("id"))
    zero = [F.lit(0.0).alias(c) for c in ("score", "bm25", "vec", "rrf")]
    return picked.unionByName(more.select("chunk_id", "file_id", *zero))


def scoped_fallback(chunks: DataFrame, file_ids: list[int], top_k: int = 8, live: DataFrame | None = None) -> DataFrame:
    """The first chunks of each of some files, as many a file as share ``top_k``; ``live`` (id) are those that may show."""
    cap = top_k if len(file_ids) <= 1 else -(-top_k // len(file_ids))
    chosen = chunks.where(F.col("file_id").isin(file_ids))
    if live is not None:
        chosen = chosen.join(live.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    w = Window.partitionBy("file_id").orderBy("idx")
    first = chosen.withColumn("r", F.row_number().over(w))
    return first.where(F.col("r") <= cap).orderBy("file_id", "idx").limit(top_k).drop("r")


def graph_edges(nodes: DataFrame, key: str, vector: str, min_score: float = 0.18, top: int = 3, most: int = 80) -> DataFrame:
    """(i, j, weight): of the first ``most`` nodes by key, each one's ``top`` neighbours of at least ``min_score``, i < j."""
    few = nodes.orderBy(key).limit(most).select(key, vector)  # a drawn graph is bounded
    a, b = few.toDF("i", "x"), F.broadcast(few.toDF("j", "y"))
    pairs = a.crossJoin(b).where(F.col("i") != F.col("j")).select("i", "j", dot(F.col("x"), F.col("y")).alias("s"))
    order = Window.partitionBy("i").orderBy(F.desc(F.round("s", 9)), "j")
    best = pairs.where(F.col("s") >= min_score).withColumn("r", F.row_number().over(order))
    return best.where((F.col("r") <= top) & (F.col("i") < F.col("j"))).select("i", "j", F.round("s", 3).alias("weight"))

import datetime
import math

from pyspark.sql import functions as F

from tomewright.operators import catalog as C
from tomewright.operators import index as I
from tomewright.operators import nlp
from tomewright.operators import search as S


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_type string, entity_id long, text string")


def test_bm25_with_negative_idf(spark):
    rows = [("file", 1, "alpha beta"), ("file", 2, "alpha"), ("note", 3, "alpha"), ("chunk", 4, "alpha"), ("file", 5, None)]
    posted = I.postings(entities(spark, rows))
    got = {r["entity_id"]: r for r in I.bm25(posted, ["alpha", "beta", "alpha"], "file").collect()}
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    gain = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.5))
    assert idf(4) < 0
    assert math.isclose(got[1]["score"], idf(4) * gain(1, 2) + idf(1) * gain(1, 2))
    assert got[1]["hits"] == ["beta"] and got[2]["hits"] == []
    assert I.bm25(posted, [], "file").count() == 0


def test_index_maintenance(spark):
    base = I.postings(entities(spark, [("note", 1, "alpha beta"), ("note", 2, "beta")]))
    new = I.upsert(base, entities(spark, [("note", 1, "gamma gamma")]))
    assert {(r["term"], r["df"]) for r in I.term_df(new).collect()} == {("gamma", 1), ("beta", 1)}
    assert I.remove(new, spark.createDataFrame([("note", 2)], "entity_type string, entity_id long")).count() == 1
    assert I.doc_stats(new).where("entity_id = 1").first()["len"] == 2


def test_boosts(spark):
    df = spark.createDataFrame([("Go fast", datetime.datetime(2024, 6, 29, 12))], "title string, ts timestamp")
    r = df.select(
        S.title_boost(F.col("title"), ["go", "fast", "no"]).alias("b"), S.recency_boost(F.col("ts"), "2024-06-30").alias("r")
    ).first()
    assert math.isclose(r["b"], 3.3) and r["r"] == 0.35


def test_permissions(spark):
    items = spark.createDataFrame(
        [(1, False, 9), (2, True, 9), (3, True, 5), (4, True, 9), (5, True, 9)], "id long, private boolean, owner long"
    )
    past, future = datetime.datetime(2020, 1, 1), datetime.datetime(2030, 1, 1)
    shares = spark.createDataFrame(
        [(2, "user", 5, "edit", future), (4, "user", 5, "view", past), (5, "team", 7, "view", None)],
        "id long, grantee_type string, grantee_id long, permission string, expires_at timestamp",
    )
    teams = spark.createDataFrame([(7, 5)], "team_id long, user_id long")
    ids = {r["id"] for r in C.allowed_ids(items, shares, 5, teams, "2024-01-01").collect()}
    assert ids == {1, 2, 3, 5}
    got = dict(C.effective_permission(items, shares, 5, F.lit(1), "2024-01-01", teams).collect())
    assert got == {1: "view", 2: "edit", 3: "manage", 4: "none", 5: "view"}


def test_tree_guards_against_cycles(spark):
    edges = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("o", "missing")]
    closed = C.closure(spark.createDataFrame(edges, "id string, parent string"), "id", "parent", 10)
    got = {(r["ancestor"], r["node"]): r["depth"] for r in closed.collect()}
    assert got[("a", "c")] == 2 and got[("x", "x")] == 0 and got[("x", "y")] == 1 and ("missing", "o") in got


def test_quota_skips_and_goes_on(spark):
    files = spark.createDataFrame([("u", 1, 5), ("u", 2, 4), ("u", 3, 3), ("u", 4, 2)], "u string, id long, n long")
    assert sorted(r["id"] for r in C.quota_greedy(files, "u", "id", "n", 8).collect()) == [1, 3]


def test_trend_fills_days(spark):
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 3, 5),)], "ts timestamp")
    assert [r["n"] for r in C.daily_trend(events, "ts", "2024-01-03", 3).orderBy("day").collect()] == [0, 0, 1]


def test_listing_pages_carry_the_total(spark):
    rows = [(i, f"t{i}", "x", i % 2 == 0, False, 10 - i) for i in range(10)]
    files = spark.createDataFrame(rows, "id long, title string, text string, pinned boolean, deleted boolean, size long")
    page = C.list_files(files, sort="size", limit=3, offset=1).collect()
    assert [r["id"] for r in page] == [2, 4, 6] and page[0]["total"] == 10


def test_chunks():
    assert nlp.chunk_text("") == [] and nlp.chunk_text(None) == []
    assert nlp.chunk_text("# H\nbody")[0] == {"idx": 0, "heading": "H", "page": 0, "text": "body"}
    text = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(12))
    got = nlp.chunk_text(text)
    assert len(got) > 2 and [c["idx"] for c in got] == list(range(len(got)))
    assert all(len(c["text"]) <= 900 + 180 + 210 for c in got)
    assert got[1]["text"].split()[0] in got[0]["text"]  # the overlap
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    assert len(nlp.chunk_text(long)) > 4
    assert [c["page"] for c in nlp.chunk_text("x", pages=[(0, "a"), (1, "b")])] == [0, 1]


def test_sentence_ranking_and_selection():
    s = ["Alpha beta gamma delta.", "Alpha beta gamma delta again.", "Unrelated words entirely here.", "Short."]
    ranks = nlp.rank_sentences(s)
    assert len(ranks) == 4 and ranks[0] > ranks[2] and nlp.rank_sentences(["x"]) == [1.0] and nlp.rank_sentences([]) == []
    picked = nlp.select_sentences(s, ranks, 3)
    assert [i for i, _ in picked] == [0, 2]  # the second repeats the first, the last is too short


def test_answers():
    ctx = [{"id": 1, "text": "The engine ranks documents. It likes tea.", "score": 1.0}, {"id": 2, "text": "", "score": 0.1}]
    out = nlp.answer("engine ranks what", ctx)
    assert out["sentences"][0] == "The engine ranks documents." and out["citations"][0] == 1 and 0.15 <= out["confidence"] <= 0.92
    assert nlp.answer("x", [])["confidence"] == 0.0
    assert nlp.summarize(None)["kind"] == "empty" and nlp.outline("") == []
    assert nlp.compare(["apple pear", "apple plum"]) == {"common": ["apple"], "unique": [["pear"], ["plum"]]}


def test_kmeans():
    import numpy as np

    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    labels = nlp.kmeans(v, 2)
    assert labels[0] == labels[1] != labels[2] == labels[3] and nlp.kmeans(v[:0], 3) == []


def test_embedding_and_its_fallback(spark):
    from tomewright.functions import vector as V

    df = spark.createDataFrame([(1, "alpha beta alpha 知识库"), (2, ""), (3, None)], "id long, text string")
    dense = {r["id"]: r for r in V.embed(df, "id", "text").collect()}
    sparse = {}
    for r in V.hash_features(df, "id", "text").collect():
        sparse.setdefault(r["id"], {})[r["idx"]] = r["w"]
    for i in (1, 2, 3):
        assert dense[i]["model"] == V.LOCAL_MODEL and dense[i]["dim"] == 512
        assert all(abs(x - sparse.get(i, {}).get(k, 0.0)) < 1e-6 for k, x in enumerate(dense[i]["vector"]))

    def remote(texts):
        return [[float(len(t)), 1.0] for t in texts]

    def broken(texts):
        raise OSError

    assert {r["model"] for r in V.embed(df, "id", "text", remote, "far").collect()} == {"far"}
    assert {r["model"] for r in V.embed(df, "id", "text", broken, "far").collect()} == {V.LOCAL_MODEL}


def test_ask(spark):
    from tomewright.operators.ask import ask

    ctx = spark.createDataFrame(
        [(1, "A", "The engine ranks documents well.", 2.0), (2, "B", "Tea is nice to drink.", 1.0)], "id long, title string, text string, score double"
    )
    out = ask("engine ranks", ctx)
    assert out["source"] == "extracted" and out["answer"].startswith("The engine") and out["citations"][0]["index"] == 1
    seen = []
    assert ask("q", ctx, [{"role": "user", "text": "old"}], lambda m: seen.append(m) or "made")["source"] == "generated"
    assert seen[0][0]["content"].startswith("[1] A\n") and [m["role"] for m in seen[0]] == ["system", "user", "user"]

    def fails(_):
        raise OSError

    assert ask("engine", ctx, generate=fails)["source"] == "extracted"
    assert ask("x", ctx.limit(0))["source"] == "none"


def test_closure_of_many_nodes(spark):
    """A tree of 10^6 nodes, ten children each: more rows than a recursive query may have."""
    edges = spark.range(1, 1_000_000).selectExpr("id", "(id - 1) div 10 parent").union(spark.range(1).selectExpr("id", "cast(null as long)"))
    closed = C.closure(edges, "id", "parent")
    assert closed.groupBy("node").count().agg(F.max("count"), F.count("*")).first() == (7, 1_000_000)
    assert closed.where("ancestor = 0").count() == 1_000_000
    few = C.closure(edges, "id", "parent", start=spark.createDataFrame([(999_999,), (3,)], "node long"))
    assert sorted(map(tuple, few.collect())) == sorted([(999999, 999999, 0), (99999, 999999, 1), (9999, 999999, 2), (999, 999999, 3), (99, 999999, 4), (9, 999999, 5), (0, 999999, 6), (3, 3, 0), (0, 3, 1)])


def test_quota_equals_brute_force(spark):
    import random

    random.seed(4)
    rows = [(random.choice([None, 1, 2, 3]), i, random.randint(0, 40)) for i in range(400)]
    used, want = {}, set()
    for u, i, n in rows:
        if used.get(u, 0) + n <= 300:
            used[u] = used.get(u, 0) + n
            want.add((u, i))
    df = spark.createDataFrame(rows, "u long, id long, n long").repartition(5)
    assert set(map(tuple, C.quota_greedy(df, "u", "id", "n", 300).collect())) == want
    assert C.quota_greedy(df.where("false"), "u", "id", "n", 300).count() == 0


def test_indexed_files(spark):
    from tomewright.functions import text as X
    from tomewright.operators import nlp

    long = "## One\n\n" + "alpha beta gamma words here.\n\n" * 120 + "\n\n## Two\n\n" + "delta epsilon zeta.\n\n" * 500
    rows = [(1, "Alpha title", long, ["tagone", "tagtwo"]), (2, None, None, None), (3, "x", "", [])]
    df = spark.createDataFrame(rows, "id long, title string, text string, tags array<string>")
    entities, chunks = nlp.indexed(df)
    bags = {r["entity_id"]: r["text"] for r in entities.where("entity_type = 'file'").collect()}
    clean = X.py_normalize_whitespace(long)
    assert bags[1] == "\n".join(["Alpha title"] * 3 + ["tagone tagtwo", " ".join(X.py_keywords(clean, 24)), clean[:6000]])
    assert set(bags) == {1, 2, 3}
    want = nlp.chunk_text(clean)
    got = chunks.where("file_id = 1").orderBy("idx").collect()
    assert [(r["idx"], r["heading"], r["text"]) for r in got] == [(c["idx"], c["heading"], c["text"]) for c in want] and len(want) > 3
    assert entities.where("entity_type = 'chunk'").count() == chunks.count() == chunks.select("chunk_id").distinct().count()
    assert set(nlp.analyze([long])) == {"summary", "outline", "keywords"} and set(nlp.analyze(["a b", "c d"])) == {"compare"}

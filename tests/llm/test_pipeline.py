import corpus_pipeline
import duckdb

from tomewright.llm import common, near, quality, queries, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept, after = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before, after = after, common.written(stage(spark, after, sf), f"test-{name}")
        kept[name] = after.count()
        if name == "toxicity":
            gone = before.join(after, "doc_id", "left_anti").count()
            assert gone < 0.3 * before.count() and after.columns == columns
        if name == "quality_rules":
            assert after.count() == quality.score(before).where("quality.kept").count() and after.columns == columns
        if name == "simhash_dedup":
            whole = near.components(before.select("doc_id", "text")).collect()
            ids = sorted(r["doc_id"] for r in after.select("doc_id").collect())
            assert ids == sorted({r["component_id"] for r in whole}) and after.columns == columns
            exact = simhash.components(after.select("doc_id", "text"))
            assert exact.groupBy("fingerprint").count().where("count > 1").count() == 0
        if name == "source_mix":
            assert 0.7 * before.count() < after.count() < 1.3 * before.count() and after.columns == columns
    tokens = after.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 4096 for r in tokens)
    assert kept["packing"] >= kept["source_mix"]


def test_sql_queries(spark, sf):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        mine = queries.QUERIES[name](spark, sf).toPandas()
        theirs = con.execute(sql).df()
        names = sorted(mine.columns)
        assert names == sorted(theirs.columns)
        show = lambda f: sorted(map(str, f[names].itertuples(index=False, name=None)))
        assert show(mine.astype(str)) == show(theirs.astype(str)), name


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))


def test_stages_on_odd_tables(spark, sf):
    """Nulls in every column, repeated rows, a very long text, ties, clashing names; and no rows at all."""
    plain = "the house and the garden are open to everyone who wants to read a book or walk in the sun today"
    rows = [(i, f"{plain} number {i} of the list", "en", "a", 9) for i in range(30)]
    rows += [(3, rows[3][1], "en", "a", 9)] * 3 + [(None, None, None, None, None)] * 3 + [(None, plain + " again", None, None, 1)]
    rows += [(3, "another text with the same id, " + plain, "en", "b", 9), (50, "", "en", "a", 0), (51, (plain + " ") * 3000, "en", "a", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "1 score", "'x' quality", "2 copy", "3 shuffle_key", "4 node", "5 h", "6 id", "7 start")
    for docs in (odd, odd.where("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES:
            after = common.written(stage(spark, docs, sf), f"odd-{name}")
            assert name == "packing" or after.columns == docs.columns, name
            if name == "toxicity":
                assert after.count() == docs.count()  # nothing toxic here, nulls stay
            if name == "simhash_dedup":
                kept = after.select("doc_id", "text").collect()
                assert len(kept) == len(set(kept))
                assert len(kept) <= docs.select("text").distinct().count() and bool(kept) == (docs.count() > 0)
            if name == "packing":
                assert after.agg({"length": "sum"}).first()[0] is None or after.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
            docs = after

import datetime

from tomewright.operators import index
from tomewright.streaming import events as E

T0 = datetime.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, name, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_versions_policy(spark, tmp_path):
    schema = "note long, ts timestamp, size double, forced boolean"
    rows = [(1, at(0), 100.0, False), (1, at(10), 499.0, False), (1, at(20), 501.0, False), (1, at(62), 502.0, False), (1, at(63), 502.0, True), (1, at(64), 503.0, True)]
    got = E.run_to_end(E.versions(stream_of(spark, tmp_path, "v", [rows], schema)), "append", "v").orderBy("ts").collect()
    assert [r["size"] for r in got] == [100.0, 501.0, 502.0, 503.0]


def test_leases(spark, tmp_path):
    schema = "resource string, ts timestamp, holder long"
    rows = [("d", at(0), 1), ("d", at(10), 2), ("d", at(200), 1), ("d", at(450), 2), ("d", at(501), 2)]
    got = E.run_to_end(E.leases(stream_of(spark, tmp_path, "l", [rows], schema)), "append", "l").orderBy("ts").collect()
    assert [r["granted"] for r in got] == [True, False, True, False, True]


def test_topics_and_live_index(spark, tmp_path):
    schema = "entity_type string, entity_id long, text string, ts timestamp"
    stream = stream_of(spark, tmp_path, "i", [[("note", 1, "alpha", at(0))], [("note", 1, "beta gamma", at(1)), ("note", 2, "beta", at(1))]], schema)
    path = str(tmp_path / "index")
    E.live_index(stream, path).awaitTermination()
    last = E.current_index(spark, path)
    assert {(r["entity_id"], r["term"]) for r in last.collect()} in (
        {(1, "beta"), (1, "gamma"), (2, "beta")},
        {(1, "alpha"), (2, "beta")},  # files may arrive in either order
    )
    assert index.term_df(last).count() >= 2
    E.compact(spark, path, path + "-whole")
    assert sorted(E.current_index(spark, path + "-whole").collect()) == sorted(last.collect())
    seen = []
    topics = stream_of(spark, tmp_path, "t", [[("a", 1), ("b", 2)]], "topic string, x long")

    def broken(_):
        raise RuntimeError

    E.publish(topics, {"a": lambda df: seen.append(df.count()), "b": broken}).awaitTermination()
    assert seen == [1]


def test_counters_floor_after_every_change_and_go_on(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, value double"
    path, rows = str(tmp_path / "c"), [(1, at(0), 0, -5.0), (1, at(1), 1, 10.0), (2, at(0), 2, 4.0), (2, at(1), 3, -9.0), (2, at(2), 4, 1.0)]
    run = lambda: E.run_to_end(E.running_counters(stream_of(spark, tmp_path, "e", [], schema)), "update", "c", path, "user_id")
    stream_of(spark, tmp_path, "e", [rows], schema)
    assert sorted(map(tuple, run().collect())) == [(1, 10.0, 2), (2, 1.0, 3)]
    stream_of(spark, tmp_path, "e", [[(1, at(5), 9, -4.0)]], schema)
    assert sorted(map(tuple, run().collect())) == [(1, 6.0, 3), (2, 1.0, 3)]


def test_a_batch_that_runs_again_is_not_written_twice(spark, tmp_path):
    schema, path = "id long, x double", str(tmp_path / "r")
    stream = stream_of(spark, tmp_path, "a", [[(1, 1.0), (2, 2.0)]], schema)
    assert E.run_to_end(stream, "append", "a", path).count() == 2
    for log in (tmp_path / "r" / "checkpoint" / "commits").iterdir():
        log.unlink()  # as if the driver had died after the write, before the commit
    assert E.run_to_end(stream, "append", "a", path).count() == 2


def test_jobs(spark):
    asked = spark.createDataFrame([(1, False), (1, True), (2, False), (3, False), (4, False), (5, False)], "id long, force boolean")
    texts = spark.createDataFrame([(1, "new", None), (2, "  ", None), (3, None, "broken"), (5, "again", None)], "id long, text string, error string")
    old = spark.createDataFrame([(1, "ok", 9), (5, "ok", 7)], "id long, state string, chars long")
    got = sorted(map(tuple, E.jobs(asked, texts, old).collect()))
    assert got == [(1, "ok", 3), (2, "empty", 0), (3, "failed", 0), (4, "pending", 0), (5, "ok", 7)]

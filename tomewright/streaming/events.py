"""Structured Streaming: event windows, queues, live index, versions, leases, topics, think filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.operators import index
from tomewright.sources.storage import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of Parquet files as a stream, with UTC event times (watermarks need them)."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, name: str, path: str | None = None, key: str | None = None) -> DataFrame:
    """Run a streaming query over what its source has now; the result so far as a table.

    A batch overwrites a folder of its number, so one that runs again after a failure is
    not written twice. ``complete`` reads the last batch, ``append`` all of them, ``update``
    the last row of each ``key``. With a ``path`` of the caller's, state, offsets and results
    stay there and the next call goes on where this one ended.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, name)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(f"{path}/data")
    if mode == "complete":
        found = found.where(F.col("batch") == (found.agg(F.max("batch")).first()[0] or 0))
    elif mode == "update":
        columns = [c for c in stream.columns if c != key]
        last = found.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        return last.select(key, "r.*").select(*stream.columns)
    return found.select(*stream.columns)


def daily_windows(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events and their value by day and type, with a watermark for late data."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
        .select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", "value")
    )


def running_counters(stream: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, used, n): totals by key, floored at 0 after every change, for update mode.

    Changes of a batch apply in order of (ts, event_id). From a total u, changes with prefix
    sums S_1 .. S_n end at S_n + max(u, -min S_k), so a batch of a key is one vector.
    """
    schema = T.StructType([stream.schema[key], *T.StructType.fromDDL("used double, n long").fields])

    def step(keys, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        sums = rows[value].fillna(0.0).cumsum().to_numpy()
        if len(sums):
            used, n = float(sums[-1] + max(used, -sums.min())), n + len(sums)
        state.update((used, n))
        yield pd.DataFrame([(keys[0], used, n)], columns=[key, "used", "n"])

    changes = stream.select(key, "ts", "event_id", value)
    return changes.groupBy(key).applyInPandasWithState(step, schema, "used double, n long", "update", "NoTimeout")


def jobs(requests: DataFrame, texts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, state, chars): what processing the requested files gives: ok, empty or failed.

    ``texts`` (id, text, error) is what extraction gave; a file without a row is still
    pending. ``stored`` (id, state, chars) are earlier results: a file that is ok there is
    not processed again unless the request is ``force``.
    """
    last = requests.groupBy("id").agg(F.max("force").alias("force"))
    found = last.join(texts, "id", "left")
    chars = F.length(F.trim(F.coalesce("text", F.lit("")))).cast("long")
    state = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("text").isNull(), "pending")
        .when(chars == 0, "empty")
        .otherwise("ok")
    )
    now = found.select("id", "force", state.alias("state"), chars.alias("chars"))
    if stored is None:
        return now.drop("force")
    old = stored.select("id", F.col("state").alias("old"), F.col("chars").alias("old_chars"))
    cached = (F.col("old") == "ok") & ~F.col("force")
    return now.join(old, "id", "left").select(
        "id",
        F.when(cached, F.col("old")).otherwise(F.col("state")).alias("state"),
        F.when(cached, F.col("old_chars")).otherwise(F.col("chars")).alias("chars"),
    )


def queue(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """A job queue: one job a key, a later request in place of an earlier one, urgent ones marked."""
    return stream.groupBy(key).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max(F.col("event_type") == "error").alias("urgent")
    )


def versions(stream: DataFrame, gap_seconds: float = 40, delta: float = 400) -> DataFrame:
    """(note, ts, size): versions that are stored, per note in order of time.

    A change is stored if it is forced, if more than ``gap_seconds`` went by since the
    last stored one, or if the size moved by more than ``delta``. Input (note, ts, size,
    forced); state is one row a note. A task holds one note's changes of one batch, which the
source's files a trigger bound. The newest ``catalog.newest(..., 30)`` are kept.
    """
    schema = "note long, ts timestamp, size double"

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "size_"])
        kept = []
        for r in rows.itertuples():
            at = r.ts.timestamp()
            if last is None or (r.size_ != last[1] and (r.forced or at - last[0] > gap_seconds or abs(r.size_ - last[1]) > delta)):
                kept.append((key[0], r.ts, r.size_))
                last = (at, float(r.size_))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=["note", "ts", "size"])

    return (
        stream.select("note", "ts", F.col("size").alias("size_"), "forced")
        .groupBy("note")
        .applyInPandasWithState(step, schema, "at double, size double", "append", "NoTimeout")
    )


def leases(stream: DataFrame, ttl_seconds: float = 300) -> DataFrame:
    """(resource, ts, holder, granted): a lease goes to its holder or, when it has run out, to anyone.

    Input (resource, ts, holder); a grant renews the lease.
    """
    schema = "resource string, ts timestamp, holder long, granted boolean"

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        holder, until = state.get if state.exists else (None, 0.0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "holder"]).itertuples():
            at = r.ts.timestamp()
            granted = holder is None or holder == r.holder or at >= until
            if granted:
                holder, until = int(r.holder), at + ttl_seconds
            out.append((key[0], r.ts, r.holder, granted))
        if holder is not None:
            state.update((holder, until))
        yield pd.DataFrame(out, columns=["resource", "ts", "holder", "granted"])

    return (
        stream.select("resource", "ts", "holder")
        .groupBy("resource")
        .applyInPandasWithState(step, schema, "holder long, until double", "append", "NoTimeout")
    )


def publish(stream: DataFrame, topics: dict[str, Callable[[DataFrame], None]], topic: str = "topic"):
    """A streaming query that hands each topic's rows of a batch to its subscriber.

    A subscriber that fails is dropped, the others go on.
    """
    live = dict(topics)

    def fan_out(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            for name in list(live):
                try:
                    live[name](held.where(F.col(topic) == name))
                except Exception:
                    live.pop(name)
        finally:
            held.unpersist()

    path = scratch(stream.sparkSession, "topics")
    return (
        stream.writeStream.option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(fan_out).start()
    )


def live_index(changes: DataFrame, path: str):
    """A streaming query that keeps an index at ``path`` up to date with changed entities.

    A batch writes the postings of its entities and their keys, each in a folder of its
    number by overwrite, so it can run again and costs what changed, not what is indexed.
    :func:`current_index` reads the last state of every entity; :func:`compact` merges.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*index.KEY).agg(F.max_by("text", "ts").alias("text"))
        index.postings(last).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        last.select(*index.KEY).write.mode("overwrite").parquet(f"{path}/keys/batch={number}")

    return (
        changes.writeStream.option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )


LIVE = "entity_type string, entity_id long, term string, tf long, len long, batch long"


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings of every entity as of the last batch that had it."""
    keys = spark.read.schema("entity_type string, entity_id long, batch long").parquet(f"{path}/keys")
    last = keys.groupBy(*index.KEY).agg(F.max("batch").alias("batch"))
    return spark.read.schema(LIVE).parquet(f"{path}/postings").join(last, [*index.KEY, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the current index as one batch (number 0) of a new folder, between two runs of the stream."""
    current = current_index(spark, path)
    current.repartitionByRange("term", F.xxhash64(*index.KEY)).sortWithinPartitions("term").write.parquet(f"{to}/postings/batch=0")
    spark.read.schema(LIVE).parquet(f"{to}/postings").select(*index.KEY).distinct().write.parquet(f"{to}/keys/batch=0")


class ThinkFilter:
    """Removes think spans from a stream of pieces, tags split over pieces included."""

    OPEN, CLOSE = ("<think>", "<thinking>"), ("</think>", "</thinking>")

    def __init__(self):
        self.held, self.inside = "", False

    def feed(self, piece: str) -> str:
        """What can be shown after this piece; a possible start of a tag is held back."""
        text, out = self.held + piece, []
        self.held = ""
        while text:
            low = text.lower()
            found = [(low.find(t), t) for t in (*self.OPEN, *self.CLOSE) if t in low]
            if found:
                at, tag = min(found)
                if not self.inside:
                    out.append(text[:at])
                self.inside = tag in self.OPEN
                text = text[at + len(tag) :]
                continue
            tags = (*self.OPEN, *self.CLOSE)
            keep = next((k for k in range(min(len(text), 11), 0, -1) if any(t.startswith(low[-k:]) for t in tags)), 0)
            self.held = text[len(text) - keep :]
            if not self.inside:
                out.append(text[: len(text) - keep])
            break
        return "".join(out)

    def end(self) -> str:
        held, self.held = self.held, ""
        return "" if self.inside else held


def think_filtered(df: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """(key, text): each stream's pieces in order, filtered and joined."""

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column(order).to_pylist(), table.column(piece).to_pylist()), key=lambda r: r[0])
        f = ThinkFilter()
        text = "".join(f.feed(p or "") for _, p in rows) + f.end()
        return pa.table({key: table.column(key).slice(0, 1), "text": pa.array([text], pa.string())})

    return df.select(key, order, piece).groupBy(key).applyInArrow(run, T.StructType([df.schema[key], T.StructField("text", T.StringType())]))

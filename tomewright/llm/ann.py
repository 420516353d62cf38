"""Approximate nearest neighbours by query-directed multiprobe hashing.

Every vector gets a bucket in each of ``TABLES`` tables: floor((a.v + b) / w) for K
normal projections a. A query visits, in each table, its own bucket and then perturbed
ones in the order of estimated success: perturbations add or take up to ``STEPS`` at some projections,
score the sum of squared distances from the query to the bucket borders crossed, and come
off a heap that shifts and expands them. The candidates of all tables are merged and
ranked by exact distance.

K follows from the number of vectors (about ``BUCKET_ROWS`` a bucket); w and the number of
probes are fitted on a bounded sample (``SAMPLE`` vectors, by hash of the id), where
recall against brute force must reach ``TARGET_RECALL``. A sample is sparser than the
table, so its neighbours are further away and the fit errs to more probes. Where
``MAX_PROBES`` do not reach it, K is lowered until they do; at K = 0 all vectors are one
bucket, and the search is exact.

Equal vectors are one entry that carries its ``k`` + 1 smallest ids, which is all that a
result can use, so copies do not crowd a bucket. Buckets are dealt to groups of about
``BLOCK_ROWS`` entries by their key; a group that got more is split into blocks, of its
entries and of its queries, and a task meets one block of either. No task holds a hot
bucket, no pair of vectors is ever a row, and a block gives at most the ``k`` nearest of
every query in it, among the buckets that the query visits.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, as candidates or queries; so do rows with a null
id. A query's own id is no candidate; repeated (id, vector) rows count once. Ties go to
the smaller id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, written

K_NEAREST = 10
TABLES = 6
WIDTH = 1.0  # in root mean square distances from the mean
BUCKET_ROWS = 64
BLOCK_ROWS = 4096
SAMPLE = 4096
SAMPLE_QUERIES = 64
TARGET_RECALL = 0.96
MAX_PROBES = 1024
STEPS = 2
SEED = 20


@dataclass
class Hashing:
    planes: np.ndarray  # [table, dimension, K]
    shifts: np.ndarray  # [table, K]
    probes: int = 1

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """[vector, K]: the position along each projection, in widths."""
        return vectors @ self.planes[table] + self.shifts[table]

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit key of each row of cells (two cells may share a key: more candidates)."""
        out = np.full(len(cells), 0xCBF29CE484222325, dtype=np.uint64)
        for j in range(cells.shape[1]):
            out = (out ^ cells[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def visits(self, place: np.ndarray, limit: int) -> np.ndarray:
        """[visit, K]: the cells to visit, the likeliest first."""
        k = len(place)
        own = np.floor(place).astype(np.int64)
        inside = place - own
        steps = sorted(
            x
            for j in range(k)
            for s in range(1, STEPS + 1)
            for x in (((s - 1 + inside[j]) ** 2, j, -s), ((s - inside[j]) ** 2, j, s))
        )
        cells = [own]
        heap = [(steps[0][0], (0,))] if steps else []
        while heap and len(cells) < limit:
            cost, chosen = heapq.heappop(heap)
            used = {steps[c][1] for c in chosen}
            sound = len(used) == len(chosen)
            if sound:
                cell = own.copy()
                for c in chosen:
                    cell[steps[c][1]] += steps[c][2]
                cells.append(cell)
            last = chosen[-1]
            if last + 1 < len(steps):
                more = steps[last + 1][0]
                heapq.heappush(heap, (cost - steps[last][0] + more, (*chosen[:-1], last + 1)))
                if sound:  # what begins with two steps on one projection stays invalid
                    heapq.heappush(heap, (cost + more, (*chosen, last + 1)))
        return np.array(cells)


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision; the same two vectors always give the same value."""
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def fit(sample: np.ndarray, total: int, k: int = K_NEAREST, tables: int = TABLES) -> Hashing:
    """Projections, width and number of probes that reach the target on a sample of the vectors."""
    spread = np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean()) or 1.0
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    near = []
    for q in queries:
        apart = distances(q, sample)
        near.append([i for i in np.argsort(apart, kind="stable")[: k + 1] if apart[i] > 0][:k])
    folds = int(np.clip(round(np.log(max(1.0, total / BUCKET_ROWS)) / np.log(5)), 1, 24))
    for fewer in range(folds, 0, -1):
        rng = np.random.default_rng(SEED)
        hashing = Hashing(
            rng.normal(size=(tables, sample.shape[1], fewer)) / (WIDTH * spread), rng.random((tables, fewer))
        )
        probes = probes_needed(hashing, sample, queries, near)
        if probes is not None:
            hashing.probes = probes
            return hashing
    return Hashing(np.zeros((1, sample.shape[1], 0)), np.zeros((1, 0)))


def probes_needed(hashing: Hashing, sample: np.ndarray, queries: np.ndarray, near: list[list[int]]) -> int | None:
    """The probes that find ``TARGET_RECALL`` of the queries' ``near``; None if ``MAX_PROBES`` do not."""
    tables = range(len(hashing.planes))
    cells = [np.floor(hashing.places(sample, t)).astype(np.int64) for t in tables]
    ranks = []
    for q, those in zip(queries, near):
        first = np.full(len(those), MAX_PROBES)
        for t in tables:
            order = hashing.visits(hashing.places(q[None], t)[0], MAX_PROBES)
            at = {c.tobytes(): r for r, c in reversed(list(enumerate(order)))}
            first = np.minimum(first, [at.get(cells[t][i].tobytes(), MAX_PROBES) for i in those])
        ranks.append(first)
    ranks = np.sort(np.concatenate(ranks))
    if not len(ranks):
        return 1
    need = int(ranks[int(np.ceil(TARGET_RECALL * len(ranks))) - 1])
    return need + 1 if need < MAX_PROBES else None


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the distinct rows that take part, vectors as arrays of doubles."""
    vec = col(vector_col).cast("array<double>")
    rows = df.select(col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows
    return rows.where(F.size("vec") == sizes["n"]).distinct()


def _binary(vec) -> bytes:
    return np.asarray(vec, dtype="<f8").tobytes()


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(groups)).astype(np.int32)


def _entries(rows: DataFrame, hashing: Hashing, k: int, groups: int) -> DataFrame:
    """(t, g, key, ids, vec): every class of equal vectors in its bucket of every table."""
    from pyspark.sql import Window

    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(
        F.col("r") <= k + 1
    )
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            raw = pa.array([_binary(v) for v in vectors], pa.binary())
            for t in range(len(hashing.planes)):
                keys = hashing.keys(np.floor(hashing.places(vectors, t)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), t, dtype=np.int32)),
                        pa.array(_group_of(keys, groups)),
                        pa.array(keys),
                        batch.column(1),
                        raw,
                    ],
                    names=["t", "g", "key", "ids", "vec"],
                )

    return classes.select("vec", "ids").mapInArrow(run, "t int, g int, key long, ids array<long>, vec binary")


def _visits(queries: DataFrame, hashing: Hashing, groups: int) -> DataFrame:
    """(t, g, q, qvec, keys): the buckets that every query visits, by table and group."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                vector = np.array(batch.column(1)[i].as_py(), dtype=np.float64)
                q, raw, out = batch.column(0)[i].as_py(), _binary(vector), []
                for t in range(len(hashing.planes)):
                    cells = hashing.visits(hashing.places(vector[None], t)[0], hashing.probes)
                    keys = np.unique(hashing.keys(cells))
                    at = _group_of(keys, groups)
                    out += [(t, int(g), keys[at == g].tolist()) for g in np.unique(at)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t for t, _, _ in out], pa.int32()),
                        pa.array([g for _, g, _ in out], pa.int32()),
                        pa.array([q] * len(out), pa.int64()),
                        pa.array([raw] * len(out), pa.binary()),
                        pa.array([k for _, _, k in out], pa.list_(pa.int64())),
                    ],
                    names=["t", "g", "q", "qvec", "keys"],
                )

    return queries.select("id", "vec").mapInArrow(run, "t int, g int, q long, qvec binary, keys array<long>")


def nearest_in_block(k: int):
    """The function that ranks one block of entries for one block of queries."""

    def run(entries, visits):
        import pyarrow as pa

        out_q, out_id, out_d = [], [], []
        if entries.num_rows and visits.num_rows:
            keys = entries.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            vectors = np.frombuffer(b"".join(entries.column("vec").to_pylist()), "<f8")
            vectors = vectors.reshape(entries.num_rows, -1)[order]
            ids = entries.column("ids").to_pylist()
            norms = (vectors**2).sum(axis=1)
            found, first = np.unique(keys[order], return_index=True)
            ends = np.append(first[1:], len(keys))
            spans = {key: (a, b) for key, a, b in zip(found.tolist(), first.tolist(), ends.tolist())}
            for q, raw, wanted in zip(*(visits.column(c).to_pylist() for c in ("q", "qvec", "keys"))):
                parts = [np.arange(*spans[key]) for key in wanted if key in spans]
                if not parts:
                    continue
                near = np.concatenate(parts)
                query = np.frombuffer(raw, "<f8")
                if len(near) > k + 1:  # the query's own entry may be among them
                    rough = norms[near] - 2 * vectors[near] @ query  # squared distance less the query's norm
                    edge = np.partition(rough, k)[k]
                    near = near[rough <= edge + 1e-9 * (1 + abs(edge))]
                exact = distances(query, vectors[near])
                ranked = sorted((d, i) for d, e in zip(exact.tolist(), near) for i in ids[order[e]] if i != q)
                for d, i in ranked[:k]:
                    out_q.append(q)
                    out_id.append(i)
                    out_d.append(d)
        return pa.table(
            {
                "q": pa.array(out_q, pa.int64()),
                "id": pa.array(out_id, pa.int64()),
                "distance": pa.array(out_d, pa.float64()),
            }
        )

    return run


def search(
    df: DataFrame,
    queries,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K_NEAREST,
    tables: int = TABLES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``queries``
    (a condition on the id column, called ``id``) selects."""
    spark = df.sparkSession
    rows = written(valid(df, id_col, vector_col), "ann-rows")
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    total = rows.count()
    groups = max(1, total // BLOCK_ROWS)
    hashing = fit(np.array([r[0] for r in sample], dtype=np.float64), total, k, tables)
    entries = written(_entries(rows, hashing, k, groups), "ann-index")
    visits = written(_visits(rows.where(queries), hashing, groups), "ann-visits")
    group = ["t", "g"]
    blocks = written(
        entries.groupBy(group)
        .agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).cast("int").alias("eb"))
        .join(
            visits.groupBy(group).agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).cast("int").alias("qb")), group
        ),
        "ann-blocks",
    )
    here = (
        entries.join(blocks, group)
        .withColumn("e", F.pmod(F.xxhash64("vec"), F.col("eb")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        .select("t", "g", "e", "b", "key", "ids", "vec")
    )
    asked = (
        visits.join(blocks, group)
        .withColumn("b", F.pmod(F.xxhash64("q", "qvec"), F.col("qb")).cast("int"))
        .withColumn("e", F.explode(F.sequence(F.lit(0), F.col("eb") - 1)))
        .select("t", "g", "e", "b", "q", "qvec", "keys")
    )
    from pyspark.sql import Window

    block = ["t", "g", "e", "b"]
    met = (
        here.groupBy(*block)
        .cogroup(asked.groupBy(*block))
        .applyInArrow(nearest_in_block(k), "q long, id long, distance double")
        .distinct()  # found in several tables
    )
    ranked = met.withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")).cast("int")
    )
    return ranked.where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score")
    )

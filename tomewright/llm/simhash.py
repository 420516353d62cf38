"""SimHash near-duplicates by the generalised pigeonhole principle.

:func:`components` links fingerprints of 3-word shingles at two bits. :mod:`.near` searches
fingerprints of five-word shingles in the same way, among others.

Fingerprints: 64 bits of 3-word shingles, a bit being set if it is set in over half the
shingles' XXH64 values. Two fingerprints link at ``radius`` differing bits or fewer.

Search: the 64 bits are cut into partitions, bits that correlate in a bounded sample
going together, so that the partitions are as independent of one another as they can be.
If two fingerprints are within ``radius``, then for every choice of thresholds t_i >= -1
with sum(t_i + 1) = radius + 1 some partition i differs in t_i bits or fewer. Each
fingerprint gets its own thresholds: a dynamic programme over the partitions minimises
its probes and estimated candidates, from the bit frequencies of the sample. It probes
the values within t_i of its own in partition i, and a probe meets the fingerprints with
that value in an equi-join that verifies the distance.

A partition value that more than ``bucket_cap`` fingerprints share is not joined; the
fingerprints in it or probing it go another exact way, whose size is linear: each is
written under itself and its 64 one-bit neighbours, and those under one key (65 at most)
are within two bits of one another. That way is for a radius of two.

Only distinct fingerprints are searched, so copies cost nothing, and components come
from alternating large-star and small-star rounds over the links, each round a table in
the shared folder.

Defined results: null and empty texts have fingerprint 0 and link like any other;
repeated rows are members of one component; a component's id is its smallest non-null
document id; an empty table gives an empty result; columns of the input named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, without, written

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: The largest threshold of one partition (its probes grow with the power of it).
MAX_THRESHOLD = 2
#: Distinct fingerprints from which bit frequencies and correlations are estimated.
SAMPLE = 20_000
#: Fingerprints of one partition value that a join may meet.
BUCKET_CAP = 256


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned 64-bit integer."""
    import xxhash

    # bytes.lower() and bytes.split() know exactly A-Z and the six ASCII separators
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles = [b" ".join(words)]
    elif words_in_shingle == 3:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_in_shingle))))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df``'s columns but the text, and the fingerprint as a signed 64-bit long."""
    keep = without(df, text_col, out_col)
    rest = df.select(*keep)
    schema = T.StructType([*rest.schema.fields, T.StructField(out_col, T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            prints = pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names=schema.names)

    text = col(text_col).cast("string").cast("binary").alias(fresh(rest, "_s_text"))
    return df.select(*keep, text).mapInArrow(run, schema)


def correlated_groups(sample: np.ndarray, groups: int) -> list[list[int]]:
    """The bit positions in ``groups`` partitions, correlated bits together."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tie = np.abs(centred.T @ centred) / max(1, len(bits))
    np.fill_diagonal(tie, 0)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        order = sorted(free)
        seed = order[int(np.argmax(tie[np.ix_(order, order)].sum(axis=1)))]
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            order = sorted(free)
            best = order[int(np.argmax(tie[np.ix_(order, group)].sum(axis=1)))]
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def flips(group: list[int], distance: int) -> list[int]:
    """The masks of exactly ``distance`` bits of ``group``."""
    return [sum(1 << b for b in c) for c in combinations(group, distance)]


class Allocation:
    """Thresholds for each fingerprint that minimise probes and estimated candidates."""

    def __init__(self, groups: list[list[int]], ones: np.ndarray, total: int, radius: int):
        self.groups, self.ones, self.total, self.radius = groups, ones, total, radius
        self.top = min(radius, MAX_THRESHOLD)

    def costs(self, prints: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, t + 1]: probes plus expected candidates at threshold t."""
        bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out = np.zeros((len(prints), len(self.groups), self.top + 2))
        for i, group in enumerate(self.groups):
            # differing bits of a random fingerprint: a sum of independent trials
            at = np.zeros((len(prints), self.top + 1))
            at[:, 0] = 1
            for b in group:
                differ = np.where(bits[:, b], 1 - self.ones[b], self.ones[b])[:, None]
                moved = np.zeros_like(at)
                moved[:, 1:] = at[:, :-1] * differ
                at = at * (1 - differ) + moved
            probes = np.cumsum([comb(len(group), d) for d in range(self.top + 1)])
            out[:, i, 1:] = probes + self.total * np.cumsum(at, axis=1)
        return out

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([fingerprint, partition] thresholds, least cost of each fingerprint)."""
        costs, budget = self.costs(prints), self.radius + 1
        n, m = costs.shape[:2]
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        took = np.zeros((n, m, budget + 1), dtype=np.int8)
        for i in range(m):
            new = np.full_like(best, np.inf)
            for spent in range(budget + 1):
                for use in range(min(spent, self.top + 1) + 1):
                    cost = best[:, spent - use] + costs[:, i, use]
                    better = cost < new[:, spent]
                    new[better, spent] = cost[better]
                    took[better, i, spent] = use
            best = new
        out = np.zeros((n, m), dtype=np.int8)
        left = np.full(n, budget)
        for i in range(m - 1, -1, -1):
            out[:, i] = took[np.arange(n), i, left]
            left = left - out[:, i]
        return out - 1, best[:, budget]


def plan(sample: np.ndarray, total: int, radius: int = RADIUS) -> Allocation:
    """The number of partitions whose thresholds cost least on the sample, and its bits."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = (bits.sum(axis=0) + 1) / (len(bits) + 2)
    tried = []
    for m in range(max(1, -(-(radius + 1) // (MAX_THRESHOLD + 1))), radius + 3):
        allocation = Allocation(correlated_groups(sample, m), ones, total, radius)
        tried.append((float(allocation.thresholds(sample[:1000])[1].mean()), m, allocation))
    return min(tried, key=lambda x: x[:2])[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _probes(prints: DataFrame, allocation: Allocation) -> DataFrame:
    """(part, value, a, fa): every probe of every ``node`` with its fingerprint ``fp``."""
    groups = allocation.groups
    masks = [sum(1 << b for b in g) for g in groups]
    ways = [[np.array(flips(g, d), dtype=np.uint64) for d in range(allocation.top + 1)] for g in groups]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            nodes = batch.column(0).to_numpy()
            every = batch.column(1).to_numpy().view(np.uint64)
            for start in range(0, len(every), 4096):
                prints_here = every[start : start + 4096]
                nodes_here = nodes[start : start + 4096]
                limits, _ = allocation.thresholds(prints_here)
                for i, mask in enumerate(masks):
                    for d, flipped in enumerate(ways[i]):
                        probing = limits[:, i] >= d
                        who = prints_here[probing]
                        if not len(who):
                            continue
                        values = ((who & np.uint64(mask))[:, None] ^ flipped[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(values), i, dtype=np.int32)),
                                pa.array(values.view(np.int64)),
                                pa.array(np.repeat(nodes_here[probing], len(flipped))),
                                pa.array(np.repeat(who, len(flipped)).view(np.int64)),
                            ],
                            names=["part", "value", "a", "fa"],
                        )

    return prints.select("node", "fp").mapInArrow(run, "part int, value long, a long, fa long")


def _search(prints: DataFrame, radius: int, bucket_cap: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(probes, index, heavy): heavy are the values (part, value) over the cap; None without pairs."""
    sample = np.array(
        [
            r[0]
            for r in prints.select("fp").orderBy(F.xxhash64("fp", "node"), "node").limit(SAMPLE).collect()
        ],
        dtype=np.int64,
    ).view(np.uint64)
    if len(sample) < 2:
        return None
    allocation = plan(sample, prints.count(), radius)
    masks = [_signed(sum(1 << b for b in g)) for g in allocation.groups]
    values = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
        for i, m in enumerate(masks)
    ]
    index = prints.select(
        F.explode(F.array(*values)).alias("k"), F.col("node").alias("b"), F.col("fp").alias("fb")
    ).select("k.part", "k.value", "b", "fb")
    heavy = written(
        index.groupBy("part", "value").count().where(F.col("count") > bucket_cap).select("part", "value"),
        "simhash-heavy",
    )
    return _probes(prints, allocation), index, heavy


KEY = ["part", "value"]


def _met(probes: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """(a, b): probes that meet an entry at ``radius`` bits or fewer, a < b."""
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    return probes.join(index, KEY).where(close & (F.col("a") < F.col("b"))).select("a", "b")


def links(prints: DataFrame, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b): pairs of distinct fingerprints whose transitive closure is that of all links.

    ``prints`` has one row a distinct fingerprint, column ``fp``, and is read repeatedly.
    Outside values that more than ``bucket_cap`` fingerprints share, every link is a row.
    """
    if radius != 2:
        raise ValueError("values over the cap have this exact way for a radius of 2")
    prints = prints.select(F.col("fp").alias("node"), "fp")
    found = _search(prints, radius, bucket_cap)
    if found is None:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    probes, index, heavy = found
    if heavy.isEmpty():
        return _met(probes, index, radius)
    probes = written(probes, "simhash-probes")
    light = _met(probes.join(heavy, KEY, "left_anti"), index.join(heavy, KEY, "left_anti"), radius)
    crowd = (
        probes.join(heavy, KEY, "left_semi")
        .select(F.col("a").alias("fp"))
        .union(index.join(heavy, KEY, "left_semi").select(F.col("b").alias("fp")))
        .distinct()
    )
    near = [0] + [_signed(1 << b) for b in range(BITS)]
    star = (
        crowd.select("fp", F.explode(F.lit(near)).alias("m"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("k"))
        .agg(F.collect_set("fp").alias("all"))  # 65 at most
        .where(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .where(F.col("a") < F.col("b"))
    )
    return light.union(star.select("a", "b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating star rounds: the number of rounds grows with the logarithm of the
    component sizes. A node's smallest neighbour is a partial aggregate written apart,
    so the join that hands it out can be broadcast if small and split if skewed.
    """
    now = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "stars",
    )
    state = None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (got[0], got[1]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = (got[0], got[1])
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large"
        )
        large = written(
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct(),
            "stars",
        )
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        now = written(
            large.join(least, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "stars",
        )


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): each node's smallest ``least`` over its component of ``edges``.

    ``nodes`` are (node, least, ...), read repeatedly.
    """
    return with_least(nodes, connected(edges))


def with_least(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, c): the smallest ``least`` of each label; nodes without a label keep their own."""
    members = written(labels, "simhash-members")
    least = written(
        members.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("c")),
        "simhash-least",
    )
    own = members.join(least, "label").select("node", "c")
    return written(
        nodes.select("node", "least").join(own, "node", "left").select("node", F.coalesce("c", "least").alias("c")),
        "simhash-components",
    )


def components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fingerprint_col: str = "fingerprint",
    component_col: str = "component_id",
    radius: int = RADIUS,
    bucket_cap: int = BUCKET_CAP,
) -> DataFrame:
    """``df``'s columns but the text, the fingerprint (signed long) and the component's id."""
    keep = without(df, fingerprint_col, component_col, text_col)
    fp = fresh(df, "fp")
    rows = written(with_fingerprints(df.select(*keep, col(text_col)), text_col, fp), "simhash-rows")
    prints = written(
        rows.groupBy(col(fp).alias("fp")).agg(F.min(col(id_col)).alias("least")).withColumn("node", F.col("fp")),
        "simhash-prints",
    )
    of_print = labelled(prints, links(prints, radius, bucket_cap))
    of_print = of_print.select(F.col("node").alias(fp), F.col("c").alias(component_col))
    return rows.join(of_print, fp).select(*keep, col(fp).alias(fingerprint_col), col(component_col))


def least_row(id_: Column, h: Column) -> Column:
    """What orders the rows of a component: by id (nulls last), then by a hash of the text."""
    return F.struct(id_.isNull().alias("unnamed"), id_.alias("id"), h.alias("h"))


def one_each(df: DataFrame, rows: DataFrame, of_node: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of ``df`` in each component by :func:`least_row`; columns unchanged.

    ``rows`` are (id, h, node), ``of_node`` (node, c) with the least row of the node's
    component. Decisions are about rows (id and text), so an id that comes with several
    texts is several documents. Rows that repeat the id and the text that stay become one.
    """
    stays = F.col("id").eqNullSafe(F.col("c.id")) & (F.col("h") == F.col("c.h"))
    found = written(rows.join(of_node, "node").select("id", "h", stays.alias("stays")), "simhash-decisions")
    names = [col(x) for x in df.columns]
    key_id, key_h = fresh(df, "_s_id"), fresh(df, "_s_h")
    h = F.xxhash64(col(text_col).cast("string").cast("binary"))
    same = col(id_col).eqNullSafe(col(key_id)) & (h == col(key_h))
    key = [F.col("id").alias(key_id), F.col("h").alias(key_h)]
    gone = written(found.where("not stays").select(*key).distinct(), "simhash-gone")
    kept = df.join(gone, same, "left_anti").select(*names)
    twice = found.where("stays").groupBy("id", "h").count().where("count > 1").select(*key)
    twice = written(twice, "simhash-repeated")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same, "left_semi").withColumn(key_h, h).dropDuplicates([id_col, key_h])
    return kept.join(twice, same, "left_anti").select(*names).union(once.select(*names))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of fingerprints: see :func:`one_each`."""
    text = col(text_col).cast("string").cast("binary")
    texts = df.select(col(id_col).alias("id"), F.xxhash64(text).alias("h"), col(text_col).alias("text"))
    rows = written(with_fingerprints(texts, "text", "node"), "simhash-rows")
    prints = rows.groupBy("node").agg(F.min(least_row(F.col("id"), F.col("h"))).alias("least"))
    prints = written(prints.withColumn("fp", F.col("node")), "simhash-prints")
    return one_each(df, rows, labelled(prints, links(prints)), id_col, text_col)

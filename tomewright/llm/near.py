"""Near copies: texts whose five-word shingles have a similarity of 0.8 or more.

Pairs of distinct texts become candidates in two ways. The SimHash search of
:mod:`.simhash` (generalised pigeonhole, two bits) runs over fingerprints of the five-word
shingles. A 64-bit fingerprint moves by ten bits at a similarity of 0.8, beyond any search
by bits, so texts meet also in ``BANDS`` bands, each of the least values of ``BAND_ROWS``
random orders of their shingles: two texts of similarity s share none with probability
(1 - s**BAND_ROWS)**BANDS, 6e-5 at 0.8, whatever the edits between them.

1. Every text of a band value is paired with the value's least text only (a star), so the
   pairs grow with the number of texts, not with the square of a group.
2. A pair is judged by the estimate from a sketch of ``SKETCH_BINS`` bins where that is
   further than ``MARGIN`` from the similarity asked for, and by the shingles of both
   texts otherwise. What passes is linked, and components are taken.
3. Band values whose texts are still in several components stay open. Their texts meet in
   memory, only those of different components are compared, and the undecided ones meet
   once more with their shingles. No pair is a row before it is a link.

So a link is lost only if two texts share no band. The texts of an open value are cut in
parts of ``BLOCK`` texts (``BLOCK_BYTES`` of shingles), and each two parts meet: work that
grows with the square of a value's texts is left only where many texts share a band and
yet are not alike.

Defined results: texts that differ only in the case of A-Z and in white space are equal;
null and empty texts are equal; texts of fewer than five words are alike if equal;
repeated rows are members of one group, rows that repeat an id with another text are
members of their texts' groups; a group's id is its smallest non-null id; an empty table
gives an empty result; columns of the input named like the outputs are replaced,
other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import col, fresh, without, written

SEED = 42
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
BAND_ROWS = 6
SKETCH_BINS = 256
#: An estimate this far from the similarity asked for decides (four standard errors at 0.8), ...
MARGIN = 0.1
#: ... if it is from this many filled bins or more: in fewer, one bin weighs too much.
LEAST_BINS = 64
#: Texts of an open band value, and bytes of shingles of undecided ones, that meet at once.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
KEY = ["part", "value"]
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), dtype=np.uint32)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH64 of every five-word shingle, or of all words if they are fewer."""
    import xxhash

    k = SHINGLE_WORDS
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], dtype=np.uint64)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """[BANDS] signed longs: each mixes the least values of BAND_ROWS random orders of the hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 1024):
        least = np.minimum(least, (short[None, at : at + 1024] * (_FACTORS[0] | np.uint32(1)) ^ _FACTORS[1]).min(axis=1))
    out = np.full(BANDS, 0xCBF29CE484222325, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def features(text: bytes | None) -> tuple[int, int, np.ndarray, bytes]:
    """(text class, fingerprint, bands, sketch) of a UTF-8 text.

    The class is the XXH64 of the lower-cased words; the sketch is a one-permutation hashing
    of the distinct shingles: the least hash of each of ``SKETCH_BINS`` bins, 16 bits of it;
    65535 for an empty bin.
    """
    import xxhash

    words = text.lower().split() if text else []
    whole = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    if not words:
        return whole, 0, band_values(np.array([whole], dtype=np.uint64)), b"\xff\xff" * SKETCH_BINS
    hashes = shingle_hashes(words)
    width = np.uint64(SKETCH_BINS.bit_length() - 1)
    ordered = np.sort((hashes << (np.uint64(64) - width)) | (hashes >> width))  # by bin, then by the rest
    bins = (ordered >> (np.uint64(64) - width)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    sketch = np.full(SKETCH_BINS, 0xFFFF, dtype="<u2")
    sketch[bins[first]] = (ordered[first] % np.uint64(0xFFFF)).astype(np.uint16)
    return whole, simhash.majority(hashes), band_values(hashes), sketch.tobytes()


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (arrays [..., SKETCH_BINS])."""
    both_empty = ((a == 0xFFFF) & (b == 0xFFFF)).sum(axis=-1)
    equal = ((a == b) & (a != 0xFFFF)).sum(axis=-1)
    filled = a.shape[-1] - both_empty
    return np.where(filled > 0, equal / np.maximum(1, filled), 1.0)


def bounds(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(surely that similar, possibly so) by the estimate from sketches."""
    estimate = sketch_similarity(a, b)
    enough = ((a != 0xFFFF) | (b != 0xFFFF)).sum(axis=-1) >= LEAST_BINS
    return enough & (estimate >= similarity + MARGIN), ~enough | (estimate >= similarity - MARGIN)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct numbers."""
    both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def _sketches(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<u2").reshape(-1, SKETCH_BINS)


def _root(parent: dict, x):
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def settle(
    labels: list, others: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]
) -> tuple[list[tuple], list[list[int]]]:
    """(links between labels, sets of positions left in doubt).

    ``others(x, ys)`` says which of the positions ``ys`` surely, and which possibly, link to
    ``x``. Only positions of different components are compared; a set in doubt is connected
    by possible links between components that remain apart.
    """
    parent, links, doubts = {}, [], []
    codes = np.unique(np.array(labels), return_inverse=True)[1]
    for x in range(len(labels) - 1):
        ys = np.nonzero(codes[x + 1 :] != codes[x])[0] + x + 1
        if not len(ys):
            continue
        sure, possible = others(x, ys)
        for y in ys[sure].tolist():
            if codes[y] != codes[x]:
                links.append((labels[x], labels[y]))
                codes[codes == codes[y]] = codes[x]
        if len(unsure := ys[possible & ~sure]):
            doubts.append((x, unsure))
    sets: dict = {}
    for x, ys in doubts:
        for y in ys[codes[ys] != codes[x]].tolist():
            for at in (x, y):
                sets.setdefault(("p", at), at)
                parent[_root(parent, ("c", int(codes[at])))] = _root(parent, ("p", x))
                parent[_root(parent, ("p", at))] = _root(parent, ("p", x))
    out: dict = {}
    for name, at in sets.items():
        out.setdefault(_root(parent, name), []).append(at)
    return links, [sorted(x) for x in out.values()]


def _spans(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal rows."""
    if not len(columns[0]):
        return []
    moved = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    edges = (np.nonzero(moved)[0] + 1).tolist()
    return list(zip([0, *edges], [*edges, len(columns[0])]))


def _dealt(members: DataFrame, totals: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``members`` with a task's group (g, i, j); ``totals`` are (keys, n), the size of each key.

    Keys of at most ``limit`` go to groups of about that size; a larger one is cut in parts,
    and each two of its parts meet in a group.
    """
    whole_size = totals.agg(F.sum("n")).first()[0] or 0
    groups = max(1, int(whole_size) // limit)
    single = F.col("parts") == 1
    return (
        members.join(totals.select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("parts")), keys)
        .withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where(single | (F.col("mine") != F.col("other")))
        .withColumn(
            "g", F.when(single, F.pmod(F.xxhash64(*keys), F.lit(groups))).otherwise(F.xxhash64(*keys))
        )
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("parts", "mine", "other")
    )


def _shingles(some: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles): the distinct hashes, ascending, of the shingles of the nodes ``some``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                every = [np.unique(shingle_hashes((t.as_py() or b"").lower().split())) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"])

    wanted = nodes.join(some, "node").select("node", F.col("least.id").alias("w_id"), F.col("least.h").alias("w_h"))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    shingled = found.select("node", "text").mapInArrow(run, "node long, shingles array<long>")
    return written(shingled.dropDuplicates(["node"]), "near-shingles")  # rows may repeat


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose texts are that similar."""

    def rate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                sure, possible = bounds(_sketches(batch.column(2)), _sketches(batch.column(3)), similarity)
                out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure)], names=["a", "b", "sure"])
                yield out.filter(pa.array(possible))

    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    rated = written(both.mapInArrow(rate, "a long, b long, sure boolean"), "near-rated")
    unsure = rated.where(~F.col("sure")).select("a", "b")
    some = unsure.select(F.col("a").alias("node")).union(unsure.select(F.col("b").alias("node"))).distinct()
    shingles = _shingles(some, nodes, texts)
    mine = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    other = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    met = unsure.join(mine, "a").join(other, "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    counted = met.select("a", "b", shared.alias("n"), (F.size("xa") + F.size("xb")).alias("all"))
    exact = counted.where(F.col("n") >= similarity * (F.col("all") - F.col("n")))
    return rated.where("sure").select("a", "b").union(exact.select("a", "b"))


def _pairs(nodes: DataFrame, bands: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b): the candidates that fingerprints and stars of bands give, a < b."""
    prints = written(
        nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "near-prints"
    )
    twins = nodes.join(prints.where("n > 1"), "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    close = simhash.links(prints.select("fp"))
    x = prints.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    y = prints.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    close = close.join(x, "a").join(y, "b").select("x", "y")
    star = bands.join(shared, KEY).select(F.col("first").alias("x"), F.col("node").alias("y"))
    return (
        twins.union(close)
        .union(star)
        .where("x != y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _open_links(
    bands: DataFrame, shared: DataFrame, of_node: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float
) -> DataFrame | None:
    """(a, b): links between labels whose texts share a band; None if there are none to check."""
    met = bands.join(shared.select(*KEY), KEY).join(of_node, "node")
    left = written(
        met.groupBy(*KEY)
        .agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo != hi")
        .select(*KEY, "n"),
        "near-open",
    )
    if left.isEmpty():
        return None
    members = bands.join(left.select(*KEY), KEY).join(of_node, "node").join(nodes.select("node", "sketch"), "node")

    def meet(rows):
        import pyarrow as pa

        rows = rows.sort_by([("part", "ascending"), ("value", "ascending"), ("node", "ascending")])
        part, value, node, label = (rows.column(c).to_numpy() for c in (*KEY, "node", "label"))
        sketches = _sketches(rows.column("sketch"))
        links, unsure = set(), set()
        for start, end in _spans(part, value):
            here = sketches[start:end]
            found, doubts = settle(
                label[start:end].tolist(), lambda x, ys: bounds(here[ys], here[x], similarity)
            )
            links.update(found)
            unsure.update(tuple(node[start + np.array(d)].tolist()) for d in doubts)
        return pa.table(
            {
                "a": pa.array([a for a, _ in links] + [None] * len(unsure), pa.int64()),
                "b": pa.array([b for _, b in links] + [None] * len(unsure), pa.int64()),
                "unsure": pa.array([None] * len(links) + [list(x) for x in unsure], pa.list_(pa.int64())),
            }
        )

    dealt = _dealt(members, left, KEY, BLOCK).select("g", "i", "j", *KEY, "node", "label", "sketch")
    found = written(
        dealt.groupBy("g", "i", "j").applyInArrow(meet, "a long, b long, unsure array<long>"), "near-met"
    )
    links = found.where("a is not null").select("a", "b")
    unsure = found.where("unsure is not null").select("unsure").distinct()
    sets = written(unsure.select(F.xxhash64("unsure").alias("s"), F.explode("unsure").alias("node")), "near-unsure")
    if sets.isEmpty():
        return links
    shingles = _shingles(sets.select("node").distinct(), nodes, texts)

    def verify(rows):
        import pyarrow as pa

        rows = rows.sort_by([("s", "ascending"), ("node", "ascending")])
        label, sketches = rows.column("label").to_numpy(), _sketches(rows.column("sketch"))
        every = rows.column("shingles").combine_chunks()
        values, ends = every.values.to_numpy().view(np.uint64), every.offsets.to_numpy()
        links = set()
        for start, end in _spans(rows.column("s").to_numpy()):

            def others(x, ys):
                sure, possible = bounds(sketches[start + ys], sketches[start + x], similarity)
                mine = values[ends[start + x] : ends[start + x + 1]]
                for i in np.nonzero(possible & ~sure)[0]:
                    at = start + ys[i]
                    sure[i] = similarity_of(mine, values[ends[at] : ends[at + 1]]) >= similarity
                return sure, sure

            links.update(settle(label[start:end].tolist(), others)[0])
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    rows = sets.join(of_node, "node").join(nodes.select("node", "sketch"), "node").join(shingles, "node")
    sizes = sets.join(shingles.select("node", F.size("shingles").alias("k")), "node")
    sizes = written(sizes.groupBy("s").agg(F.sum(8 * F.col("k") + 2 * SKETCH_BINS).alias("n")), "near-sizes")
    dealt = _dealt(rows, sizes, ["s"], BLOCK_BYTES).select("g", "i", "j", "s", "node", "label", "sketch", "shingles")
    return links.union(dealt.groupBy("g", "i", "j").applyInArrow(verify, "a long, b long"))


def grouped(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): the group of every node (node, least, fp, bands, sketch), read repeatedly.

    ``texts`` are (id, h, text): ``nodes.least`` names a row of each node.
    """
    bands = nodes.select("node", F.posexplode("bands").alias("part", "value"))
    shared = written(
        bands.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").drop("n"),
        "near-bands",
    )
    pairs = written(_pairs(nodes, bands, shared), "near-pairs")
    linked = simhash.connected(similar(pairs, nodes, texts, similarity))
    of_node = written(
        nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label")),
        "near-labels",
    )
    more = _open_links(bands, shared, of_node, nodes, texts, similarity)
    if more is None:
        return of_node
    top = simhash.connected(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    merged = of_node.join(written(top, "near-tops"), "label", "left")
    return written(merged.select("node", F.coalesce("top", "label").alias("label")), "near-groups")


def _hashed(df: DataFrame, id_col: str, text_col: str, keep: list[Column], names: dict[str, str]) -> DataFrame:
    """``keep``, and by ``names`` the id, a hash of the text, and the text in binary."""
    text = col(text_col).cast("string").cast("binary")
    found = {"id": col(id_col), "h": F.xxhash64(text), "text": text}
    return df.select(*keep, *[found[n].alias(name) for n, name in names.items()])


PLAIN = {n: n for n in ("id", "h", "text", "node", "fp", "bands", "sketch")}


def _rows(texts: DataFrame, names: dict[str, str]) -> DataFrame:
    """``texts`` with node, fp, bands and sketch (by ``names``) in place of the last column, the text."""
    rest = texts.select(*[col(c) for c in texts.columns[:-1]])
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType())
    added = [T.StructField(names[n], k) for n, k in zip(("node", "fp", "bands", "sketch"), kinds)]
    schema = T.StructType([*rest.schema.fields, *added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [features(t.as_py()) for t in part.column(part.num_columns - 1)]
                longs = [np.array([f[k] for f in found], dtype=np.uint64).view(np.int64) for k in (0, 1)]
                bands = pa.array([f[2] for f in found], pa.list_(pa.int64()))
                columns = [*map(pa.array, longs), bands, pa.array([f[3] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    return written(texts.mapInArrow(run, schema), "near-rows")


def _nodes(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    kept = [F.first(col(names[n])).alias(n) for n in ("fp", "bands", "sketch")]
    least = simhash.least_row(col(names["id"]), col(names["h"]))
    return written(rows.groupBy(col(names["node"]).alias("node")).agg(F.min(least).alias("least"), *kept), "near-nodes")


def components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    component_col: str = "component_id",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``df``'s columns but the text, and the id of the group of near copies."""
    names = {n: fresh(df, f"_n_{n}") for n in PLAIN}
    keep = without(df, component_col, text_col)
    picked = {n: names[n] for n in ("id", "h", "text")}
    rows = _rows(_hashed(df, id_col, text_col, keep, picked), names)
    nodes = _nodes(rows, names)
    texts = _hashed(df, id_col, text_col, [], {n: n for n in picked})
    of_node = simhash.with_least(nodes, grouped(nodes, texts, similarity))
    of_node = of_node.select(F.col("node").alias(names["node"]), F.col("c.id").alias(component_col))
    return rows.select(*keep, names["node"]).join(of_node, names["node"]).select(*keep, col(component_col))


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One document of each group of near copies: see :func:`.simhash.one_each`."""
    texts = _hashed(df, id_col, text_col, [], {n: n for n in ("id", "h", "text")})
    rows = _rows(texts, PLAIN)
    nodes = _nodes(rows, PLAIN)
    of_node = simhash.with_least(nodes, grouped(nodes, texts, similarity))
    return simhash.one_each(df, rows.select("id", "h", "node"), of_node, id_col, text_col)

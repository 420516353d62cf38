"""Token files of directly addressable codes.

An id is cut into chunks of bits, least significant first. Level j holds the j-th chunk
of every id that has one, and a bitmap that says which of them go on to level j + 1; a
rank directory counts the ones before every 512th bit. Token i is read by taking chunk i
of level 0 and, while its bit is set, moving to position rank(i) of the next level: no
block is decoded. The widths of the levels minimise a segment's size, by dynamic
programming over the bit lengths that occur in it.

A file set is a folder. ``codes/kind=code`` has a file a shard, written by Spark's
committer as raw bytes: for every segment (a run of whole documents) its code, then its
documents' ids and token counts (an Arrow stream) and the stream's length, then a separator
drawn for the file set. ``codes/kind=index`` has a JSON line a segment with its first token
and the byte at which its code starts; ``manifest`` a row a shard (shard, first_token, n_tokens, n_docs,
file names), ``about`` the separator and the type of the ids. So the set can live in any
store that Spark reaches, a lost executor costs its tasks only, a failed attempt leaves
nothing that readers see, and :class:`TokenFiles` reads a token by seeking to the few bytes
of its chunks, bits and ranks.

Rows are dealt by ranges of the id, so a hot source spreads like any other; each task
streams through its sorted range and holds one segment.

Defined results: null ids come first; documents with equal ids keep the order of their
texts' hashes; null texts are empty documents (the end id alone); an empty table gives
an empty file set; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh
from .tokens import encoder, vocabulary_path

END_ID = 1
#: Tokens after which a segment is closed (at the end of a document).
SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512
MAGIC = b"DAC1"


def level_widths(values: np.ndarray) -> list[int]:
    """Bits of each level that make the code of ``values`` smallest."""
    if not len(values):
        return [1]
    lengths = np.maximum(1, np.frexp(values.astype(np.float64))[1])
    top = int(lengths.max())
    beyond = [int((lengths > b).sum()) for b in range(top)] + [0]
    beyond[0] = len(values)
    bitmap = 1 + 32 / RANK_BITS
    best = [0.0] * (top + 1)  # best[b]: least bits for chunks from bit b on
    step = [0] * (top + 1)
    for b in range(top - 1, -1, -1):
        costs = [
            beyond[b] * (e - b + (bitmap if e < top else 0)) + best[e] for e in range(b + 1, top + 1)
        ]
        step[b] = b + 1 + int(np.argmin(costs))
        best[b] = min(costs)
    out, b = [], 0
    while b < top:
        out.append(step[b] - b)
        b = step[b]
    return out


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 16:
        return values.astype("<u2").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=values.dtype)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _unpack_bits(data: memoryview, n: int, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, np.uint8, n).astype(np.uint32)
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width)
    weights = np.uint32(1) << np.arange(width, dtype=np.uint32)
    return (bits.reshape(n, width).astype(np.uint32) * weights).sum(axis=1, dtype=np.uint32)


def encode(values: np.ndarray) -> bytes:
    """The code of an array of unsigned 32-bit integers."""
    rest = np.ascontiguousarray(values, dtype=np.uint32)
    widths = level_widths(rest)
    head, body, left = [MAGIC, struct.pack("<QB", len(rest), len(widths)), bytes(widths)], [], sum(widths)
    for width in widths:
        left -= width
        chunk = rest & np.uint32((1 << width) - 1)
        rest = rest >> np.uint32(width) if width < 32 else rest * 0
        more = rest > 0
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        parts = [_pack_bits(chunk, width)]
        if left:
            parts += [np.packbits(more, bitorder="little").tobytes(), rank.tobytes()]
        head.append(struct.pack("<Q", len(chunk)))
        body += parts
        rest = rest[more]
    return b"".join(head + body)


#: The bytes of a code that :class:`Reader` asks for first: no header is longer.
HEADER = 13 + 33 * 9


class Reader:
    """Random access to one code: ``reader[i]``, ``len(reader)`` and ``reader.all()``.

    The code is bytes, or a function that returns ``n`` bytes from a position on.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        if callable(data):
            self.fetch = data
        else:
            view = memoryview(data)
            self.fetch = lambda at, n: view[at : at + n]
        head = bytes(self.fetch(0, HEADER))
        if head[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.n, levels = struct.unpack_from("<QB", head, 4)
        sizes = struct.unpack_from(f"<{levels}Q", head, 13 + levels)
        at = 13 + levels + 8 * levels
        self.levels = []  # (width, values, position of chunks, of the bitmap, of the ranks)
        for j, (width, n) in enumerate(zip(head[13 : 13 + levels], sizes)):
            chunk, at = at, at + (n * width + 7) // 8
            bitmap = rank = None
            if j + 1 < levels:
                bitmap, at = at, at + (n + 7) // 8
                rank, at = at, at + 4 * (1 + (n + RANK_BITS - 1) // RANK_BITS)
            self.levels.append((width, n, chunk, bitmap, rank))
        self.size = at  # bytes of the code

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for width, _, chunk, bitmap, rank in self.levels:
            first = i * width
            start = first // 8
            word = int.from_bytes(self.fetch(chunk + start, (first + width + 7) // 8 - start), "little")
            value |= ((word >> (first % 8)) & ((1 << width) - 1)) << shift
            shift += width
            if bitmap is None:
                return value
            block = i // RANK_BITS
            start = block * RANK_BITS // 8
            bits = int.from_bytes(self.fetch(bitmap + start, (i >> 3) + 1 - start), "little")
            at = i - 8 * start
            if not bits >> at & 1:
                return value
            before = (bits & ((1 << at) - 1)).bit_count()
            i = int.from_bytes(self.fetch(rank + 4 * block, 4), "little") + before
        return value

    def all(self) -> np.ndarray:
        """Every value, level by level."""
        out, where, shift = np.zeros(self.n, dtype=np.uint32), None, 0
        for width, n, chunk, bitmap, _ in self.levels:
            part = _unpack_bits(self.fetch(chunk, (n * width + 7) // 8), n, width) << np.uint32(shift)
            if where is None:
                out, where = part, np.arange(n)
            else:
                out[where] |= part
            shift += width
            if bitmap is not None:
                bits = np.frombuffer(self.fetch(bitmap, (n + 7) // 8), np.uint8)
                where = where[np.unpackbits(bits, bitorder="little", count=n).astype(bool)]
        return out


INDEX = "shard long, segment long, first_token long, n_tokens long, n_docs long, start long, size long"


def write(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every text and write the file set to ``path``, documents by ascending id."""
    vocabulary = tokenizer or vocabulary_path("word_bpe_49k.json")
    spark = df.sparkSession
    end = end_id.to_bytes(4, "little")
    mark = f"\x00{uuid.uuid4().hex}\x00"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode_text = encoder(vocabulary).encode
        shard = TaskContext.get().partitionId()
        segment = first = held = start = 0
        keys, parts, key_type = [], [], None

        def close() -> pa.RecordBatch:
            nonlocal segment, first, held, start, keys, parts
            code = encode(np.frombuffer(b"".join(parts), "<u4"))
            sizes = pa.array([len(p) // 4 for p in parts], pa.int64())
            names = pa.record_batch([pa.array([shard] * len(keys), pa.int64()), pa.array(keys, key_type), sizes], ["shard", "id", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, names.schema.with_metadata({"first": str(first)})) as stream:
                stream.write_batch(names)
            names = sink.getvalue().to_pybytes()
            record = code + names + struct.pack("<I", len(names))
            line = dict(shard=shard, segment=segment, first_token=first, n_tokens=held, n_docs=len(keys), start=start, size=len(code))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(["code", "index"]),
                    pa.array([segment] * 2, pa.int64()),
                    pa.array([record, json.dumps(line).encode()], pa.binary()),
                ],
                names=["kind", "segment", "value"],
            )
            segment, first, held, start = segment + 1, first + held, 0, start + len(record) + len(mark)
            keys, parts = [], []
            return out

        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    parts.append(encode_text(text or "") + end)
                    keys.append(key)
                    held += len(parts[-1]) // 4
                    if held >= segment_tokens:
                        yield close()
        if keys:
            yield close()

    order = fresh(df, "_d_order")
    text = col(text_col).cast("string")
    dealt = (
        df.select(col(id_col), text.alias(text_col), F.xxhash64(text).alias(order))
        .repartitionByRange(col(id_col), col(order))
        .sortWithinPartitions(col(id_col), col(order))
    )
    records = dealt.select(col(id_col), col(text_col)).mapInArrow(run, "kind string, segment long, value binary")
    (
        records.sortWithinPartitions("kind", "segment")  # as the writer needs it; a shard's records keep their order
        .select("kind", F.col("value").cast("string"))  # the bytes as they are
        .write.partitionBy("kind")
        .option("lineSep", mark)
        .option("compression", "none")
        .text(f"{path}/codes")
    )
    about = [(mark, df.schema[id_col].dataType.simpleString())]
    spark.createDataFrame(about, "mark string, id_type string").coalesce(1).write.parquet(f"{path}/about")
    files, rows, first = {}, [], 0
    manifest = "shard long, first_token long, n_tokens long, n_docs long, code_file string, index_file string"
    # one row a file or shard: as many as the writing stage had tasks
    names = spark.read.format("binaryFile").load(f"{path}/codes").select("path").collect()
    for (name,) in names:
        kind, part = name.rsplit("/kind=", 1)[1].split("/part-")
        files[int(part.split("-")[0]), kind] = name
    if files:
        lines = spark.read.option("lineSep", mark).text(f"{path}/codes/kind=index")
        index = lines.select(F.from_json("value", INDEX).alias("x")).select("x.*")
        for r in index.groupBy("shard").agg(F.sum("n_tokens"), F.sum("n_docs")).orderBy("shard").collect():
            rows.append((r[0], first, r[1], r[2], files[r[0], "code"], files[r[0], "index"]))
            first += r[1]
    spark.createDataFrame(rows, manifest).coalesce(1).write.parquet(f"{path}/manifest")


class TokenFiles:
    """Single tokens of a file set: ``files[i]`` reads a few bytes of one file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.mark = spark.read.parquet(f"{path}/about").first()["mark"]
        self.shards = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
        self.firsts = [r["first_token"] for r in self.shards]
        self.held: dict[int, tuple] = {}

    def __len__(self) -> int:
        return self.shards[-1]["first_token"] + self.shards[-1]["n_tokens"] if self.shards else 0

    def _shard(self, k: int) -> tuple:
        """(index rows by first token, their first tokens, open file) of the k-th shard."""
        if k not in self.held:
            row = self.shards[k]
            lines = self.spark.read.option("lineSep", self.mark).text(row["index_file"])
            index = lines.select(F.from_json("value", INDEX).alias("x")).select("x.*").orderBy("segment").collect()
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(row["code_file"])
            file = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(where)
            self.held[k] = (index, [r["first_token"] for r in index], file)
        return self.held[k]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect_right(self.firsts, i) - 1
        index, firsts, file = self._shard(k)
        i -= self.firsts[k]
        segment = index[bisect_right(firsts, i) - 1]
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray

        def fetch(at: int, n: int) -> bytes:
            file.seek(segment["start"] + at)
            return bytes(read(file, min(n, segment["size"] - at)))

        return Reader(fetch)[i - segment["first_token"]]


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document: the id column, start, n_tokens and ids (little-endian 4-byte ids)."""
    about = spark.read.parquet(f"{path}/about").first()
    manifest = spark.read.parquet(f"{path}/manifest").select(
        "shard", F.col("first_token").alias("shard_start")
    )
    longs = T.LongType()
    schema = T.StructType(
        [
            T.StructField("shard", longs),
            *T.StructType.fromDDL(f"`{id_col}` {about['id_type']}").fields,
            T.StructField("local_start", longs),
            T.StructField("n_tokens", longs),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    if manifest.isEmpty():
        return spark.createDataFrame([], schema).select(col(id_col), F.col("local_start").alias("start"), "n_tokens", "ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for record in batch.column(0):
                data = record.as_buffer()
                raw = memoryview(data)
                (size,) = struct.unpack("<I", raw[-4:])
                with pa.ipc.open_stream(data.slice(len(raw) - 4 - size, size)) as stream:
                    first = int(stream.schema.metadata[b"first"])
                    names = stream.read_all().combine_chunks()
                ids = Reader(raw).all().astype("<u4").tobytes()
                sizes = names.column("n").to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cut = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                shard, keys = (names.column(c).combine_chunks() for c in ("shard", "id"))
                yield pa.RecordBatch.from_arrays(
                    [shard, keys, pa.array(starts + first), pa.array(sizes), pa.array(cut, pa.binary())],
                    names=schema.names,
                )

    codes = spark.read.option("lineSep", about["mark"]).text(f"{path}/codes/kind=code")
    rows = codes.select(F.col("value").cast("binary")).mapInArrow(run, schema)
    return rows.join(manifest, "shard").select(
        col(id_col), (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )

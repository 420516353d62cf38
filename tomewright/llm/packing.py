"""Packing: sum-of-squares online packing of token ids into fixed windows.

Every partition packs its own rows in one pass. A document of a window or more fills
whole windows first; what is left goes, uncut, to the fill level that minimises the sum
of the squared counts of partially filled windows, N(h) being the number of open windows
filled to h. N is one array of ``window`` + 1 counts. At the end of a partition the
emptiest open windows are cut up to top up the fullest ones, so a partition pads at most
one window. The same is done to half of the open windows whenever all of them hold more
than ``OPEN_IDS`` ids (as when every document is a little over half a window, and none
fits another): nothing is padded, and no more ids than that are ever held. No shuffle, no
group, whatever one source or key holds.

Defined results: null texts are empty documents (the end id alone); an empty table gives
no rows; repeated rows are packed once each; columns other than the id and the text are
ignored, so no name can clash. Pieces of one document stay in one partition's sequences.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col
from .tokens import encoder, vocabulary_path

WINDOW = 4096
END_ID = 2
#: Sequences are numbered from partition << SEQUENCE_BITS.
SEQUENCE_BITS = 40
#: Ids (four bytes each) that open windows hold at most.
OPEN_IDS = 1 << 21


class LevelPacker:
    """Packs pieces ``(key, start, ids, total)``; ids are little-endian 4-byte ids.

    ``add`` and ``finish`` return closed windows, each a list of pieces in order.
    """

    def __init__(self, window: int = WINDOW, open_ids: int = OPEN_IDS):
        self.window, self.open_ids, self.held = window, max(open_ids, 2 * window), 0
        self.count = np.zeros(window + 1, dtype=np.int64)  # N(h); N(0) = N(window) = 0
        self.open: dict[int, list[list[tuple]]] = {}

    def level(self, size: int) -> int:
        """The level to raise by ``size``: least change of the sum of N(h) squared.

        Raising one window from h to h + size changes the sum by
        2 (N(h + size) - N(h)) + 2; a new window (h = 0) by 2 N(size) + 1; completing
        one by 1 - 2 N(h). Ties go to the fullest level.
        """
        n, last = self.count, self.window - size
        change = 2 * (n[size:] - n[: last + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[last] -= 1
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Put a piece shorter than a window into the best level."""
        size = len(piece[2]) // 4
        h = self.level(size)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
        pieces.append(piece)
        if h + size == self.window:
            self.held -= h
            return [pieces]
        self.held += size
        self.open.setdefault(h + size, []).append(pieces)
        self.count[h + size] += 1
        return self.relieve(self.open_ids // 2) if self.held > self.open_ids else []

    def add(self, key, ids: bytes) -> list[list[tuple]]:
        total, step, closed, at = len(ids) // 4, self.window * 4, [], 0
        while len(ids) - at >= step:
            closed.append([(key, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            closed += self.place((key, at // 4, ids[at:], total))
        return closed

    def relieve(self, most: int) -> list[list[tuple]]:
        """Close the fullest windows, topped up with pieces of the emptiest, until ``most`` ids are open."""
        left = deque(w for h in sorted(self.open, reverse=True) for w in self.open[h])
        closed = []
        while left and self.held > most:
            pieces = left.popleft()
            room = self.window * 4 - sum(len(p[2]) for p in pieces)
            while room and left:
                key, start, ids, total = left[-1].pop()
                if len(ids) <= room:
                    pieces.append((key, start, ids, total))
                    room -= len(ids)
                else:
                    pieces.append((key, start, ids[:room], total))
                    left[-1].append((key, start + room // 4, ids[room:], total))
                    room = 0
                if not left[-1]:
                    left.pop()
            closed.append(pieces)
            self.held -= self.window - room // 4
        self.open = {}
        self.count[:] = 0
        for pieces in left:
            h = sum(len(p[2]) for p in pieces) // 4
            self.open.setdefault(h, []).append(pieces)
            self.count[h] += 1
        return closed

    def finish(self) -> list[list[tuple]]:
        """Close what is open: the emptiest windows are cut to top up the fullest."""
        return self.relieve(0)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row a piece: the id column, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers. A
    sequence is the pieces of one ``sequence_id`` by ``offset``; readers pad it to
    ``window``.
    """
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path).encode
        packer = LevelPacker(window)
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        key_type = None

        def rows(closed: list) -> pa.RecordBatch:
            nonlocal sequence
            out = [[] for _ in range(7)]
            for pieces in closed:
                at = 0
                for key, start, ids, total in pieces:
                    size = len(ids) // 4
                    for column, value in zip(out, (key, start, size, total, sequence, at, ids)):
                        column.append(value)
                    at += size
                sequence += 1
            kinds = [key_type] + [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds)], names=schema.names
            )

        for batch in batches:
            key_type = batch.column(0).type
            # a few rows at a time, so that a batch of long texts is never held as ids
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                closed = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    closed += packer.add(key, encode(text or "") + end)
                if closed:
                    yield rows(closed)
        if key_type is not None and (closed := packer.finish()):
            yield rows(closed)

    return df.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)

"""Token-id matrices: best-fit-decreasing packing with cumulative segment lengths and position resets.

Blocks of some millions of tokens are packed at a time. Pieces are taken by falling length; each goes to the bin with
the least room that still holds it. A segment tree over room sizes, whose nodes count bins, finds that size in
logarithmic time. Bins that stay under `good_fill` are taken apart and packed with the next block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pageloom.llm.common import id_and_text, slices
from pageloom.llm.tokens import ModelFile

Piece = tuple[object, int, bytes]  # doc_id, start, ids


class RoomTree:
    """Counts of bins by their room, 1 to `capacity`, in a segment tree."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)

    def change(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.tree[node] += by
            node >>= 1

    def least(self, room: int) -> int | None:
        """The smallest room of at least this size that a bin has."""
        node = room + self.width
        if self.tree[node]:
            return room
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Bins of pieces of at most `capacity` tokens; pieces of equal length keep their order."""
    tree, by_room, bins = RoomTree(capacity), {}, []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        size = len(piece[2]) // 4
        room = tree.least(size)
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = by_room[room].pop()
            tree.change(room, -1)
        bins[at].append(piece)
        if room > size:
            by_room.setdefault(room - size, []).append(at)
            tree.change(room - size, 1)
    return bins


def matrix_batch(sequence_ids: Iterator[int], bins: list[list[Piece]], capacity: int, pad_id: int, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in names]
    pad = pad_id.to_bytes(4, "little")
    for pieces in bins:
        lengths = [len(p[2]) // 4 for p in pieces]
        ends = np.cumsum([0, *lengths]).astype(np.int32)
        positions = np.concatenate([np.arange(start, start + n, dtype="<u4") for (_, start, _), n in zip(pieces, lengths, strict=True)])
        room = capacity - int(ends[-1])
        row = (next(sequence_ids), b"".join(p[2] for p in pieces) + pad * room, int(ends[-1]), ends.tolist(),
               positions.tobytes() + bytes(4 * room), [p[0] for p in pieces], [p[1] for p in pieces])
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(kind), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def matrices(
    docs: DataFrame, model: ModelFile, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, block_tokens: int = 2 << 20,
    good_fill: float = 0.99, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per sequence: (sequence_id, ids, n_tokens, cu_seqlens, position_ids, doc_ids, starts).

    `ids` and `position_ids` are rows of `capacity` little-endian unsigned 32-bit numbers; `cu_seqlens` bounds the
    segments; `doc_ids` and `starts` say which tokens of which document a segment holds, so that documents can be put
    together again. Positions start at 0 with every document and go on in its later segments, over all windows of an
    overlong document; padding has position 0. Tokens are the ids of the whole text and `end_id`; a null or empty text
    is `end_id` alone. Repeated rows and null ids are documents like others; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = model.encoder(), end_id.to_bytes(4, "little")
        sequence_ids = itertools.count(TaskContext.get().partitionId() << 40)
        waiting: list[Piece] = []
        tokens, kind = 0, None

        def packed(last: bool) -> tuple[list[list[Piece]], list[Piece]]:
            bins = best_fit_decreasing(waiting, capacity)
            if last:
                return bins, []
            fill = [sum(len(p[2]) for p in b) // 4 for b in bins]
            loose = sum(n for n in fill if n < good_fill * capacity)
            if loose > block_tokens // 2:  # such pieces do not fit together, waiting longer would not help
                return bins, []
            return ([b for b, n in zip(bins, fill, strict=True) if n >= good_fill * capacity],
                    [p for b, n in zip(bins, fill, strict=True) if n < good_fill * capacity for p in b])

        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                waiting.extend((doc_id, at // 4, ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity))
                tokens += len(ids) // 4
            if tokens >= block_tokens:
                bins, waiting = packed(False)
                tokens = sum(len(p[2]) // 4 for p in waiting)
                for at in range(0, len(bins), 256):
                    yield matrix_batch(sequence_ids, bins[at : at + 256], capacity, pad_id, kind, names)
        bins, waiting = packed(True)
        for at in range(0, len(bins), 256):
            yield matrix_batch(sequence_ids, bins[at : at + 256], capacity, pad_id, kind, names)

    names = ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"]
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, (
        f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, starts array<long>"))

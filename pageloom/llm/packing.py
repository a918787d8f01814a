"""Online packing of token ids into windows of a fixed length by the sum-of-squares rule.

A document of at least a window's length fills windows of its own; its rest, like any shorter document, goes in one
piece to the fill level for which the sum of the squared numbers of open windows per level is lowest afterwards. The
numbers are kept in a level array, so a placement is one vector operation whatever the number of open windows.

Every Spark partition packs what it reads, in the order it reads it, with no exchange. At its end, and whenever
`most_open` windows are open, the emptiest open windows are cut up to fill the fullest. So one window per partition at
most is not full, and memory is bounded by `most_open` windows.
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

Piece = tuple[object, int, int, bytes]  # doc_id, start, tokens of the document, ids
NEVER = 1 << 40


class SumOfSquares:
    """Windows of `capacity` tokens; `full` collects finished ones as (sequence_id, pieces)."""

    def __init__(self, capacity: int, first_id: int = 0, most_open: int = 2048):
        self.capacity, self.most_open = capacity, most_open
        self.ids = itertools.count(first_id)
        self.open: dict[int, list[list[Piece]]] = {}
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.leave = np.full(capacity + 1, NEVER, dtype=np.int64)  # change of the sum when a window leaves the level
        self.leave[0] = 0
        self.enter = np.ones(capacity + 1, dtype=np.int64)  # and when one enters it
        self.enter[capacity] = 0
        self.full: list[tuple[int, list[Piece]]] = []
        self.n_open = 0

    def add(self, doc_id: object, ids: bytes) -> None:
        total, c = len(ids) // 4, self.capacity
        whole = total // c * c
        for start in range(0, whole, c):
            self.full.append((next(self.ids), [(doc_id, start, total, ids[4 * start : 4 * (start + c)])]))
        if whole < total:
            self.place((doc_id, whole, total, ids[4 * whole :]))
        if self.n_open > self.most_open:
            self.compact()

    def place(self, piece: Piece) -> None:
        size, c = len(piece[3]) // 4, self.capacity
        change = self.leave[: c - size + 1] + self.enter[size:]
        level = c - size - int(np.argmin(change[::-1]))  # of equal changes the fullest level
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            self.shift(level, -1)
        self.settle(window, level + size)

    def settle(self, window: list[Piece], level: int) -> None:
        if level == self.capacity:
            self.full.append((next(self.ids), window))
        else:
            self.open.setdefault(level, []).append(window)
            self.shift(level, 1)

    def shift(self, level: int, by: int) -> None:
        self.n_open += by
        n = self.count[level] = self.count[level] + by
        self.leave[level] = 1 - 2 * n if n else NEVER
        self.enter[level] = 2 * n + 1

    def compact(self) -> None:
        """Fill the fullest open windows with cuts of the emptiest, until one window at most is open."""
        c = self.capacity
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        self.leave[1:], self.enter[:c] = NEVER, 1
        spare: list[Piece] = []
        low, high = 0, len(windows) - 1
        while low <= high:
            window = windows[high]
            room = c - sum(len(p[3]) // 4 for p in window)
            high -= 1
            while room and (spare or low <= high):
                if not spare:
                    spare = windows[low][::-1]
                    low += 1
                doc_id, start, total, ids = spare.pop()
                if len(ids) // 4 > room:
                    spare.append((doc_id, start + room, total, ids[4 * room :]))
                    ids = ids[: 4 * room]
                window.append((doc_id, start, total, ids))
                room -= len(ids) // 4
            self.settle(window, c - room)
        if spare:
            self.settle(spare[::-1], sum(len(p[3]) // 4 for p in spare))

    def close(self) -> None:
        self.compact()
        for windows in self.open.values():
            self.full.extend((next(self.ids), w) for w in windows)
        self.open = {}


def pieces_batch(done: list[tuple[int, list[Piece]]], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    rows = []
    for sequence_id, pieces in done:
        at = 0
        for doc_id, start, total, ids in pieces:
            rows.append((doc_id, start, len(ids) // 4, total, sequence_id, at, ids))
            at += len(ids) // 4
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, model: ModelFile, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids binary) per piece of a document.

    A document's tokens are the ids of its whole text and `end_id`; every one lies in one piece. `offset` is the
    piece's place in its sequence, without gaps from 0; `ids` are little-endian unsigned 32-bit numbers. A null or
    empty text is `end_id` alone. Repeated rows and null ids are documents like others; an empty table has no pieces.
    Sequence ids hold the partition's number in their upper bits. Feed it stored rows: a partition that is computed
    again must read its rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = model.encoder(), end_id.to_bytes(4, "little")
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 40)
        kind = None
        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            ids = encoder.encode(batch.column("text").to_pylist())
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                packer.add(doc_id, found + end)
            if len(packer.full) >= 256:
                yield pieces_batch(packer.full, names, kind)
                packer.full = []
        packer.close()
        if packer.full:
            yield pieces_batch(packer.full, names, kind)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")

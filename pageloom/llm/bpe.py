"""Byte-level BPE by rank files: encoding and decoding of whole texts.

Each piece of the splitting pattern is merged on its own. A segment tree over its byte positions holds, for every live
pair, rank and position as one number; the root is the leftmost pair of the lowest rank. A merge changes three leaves
(the pair itself, the one before, the dead one), each in logarithmic time. Pieces of up to 1024 bytes are merged many
at a time, one row of numpy arrays per piece; longer ones alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.common import id_and_text, slices, worker_state
from pageloom.llm.tokens import TokenCache

NONE = np.int64(1) << 62


class SegmentTreeBpe:
    def __init__(self, rank_file: bytes):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.no_token = max(self.bytes_of) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, NONE where there is no such token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def pieces(self, pieces: list[bytes], whole_first: bool = True) -> list[bytes]:
        """Little-endian 32-bit ids of each piece; a piece that is a token itself is not merged, if `whole_first`."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece) if whole_first or len(piece) == 1 else None
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            if width > 1024:
                for i in rows:
                    out[i] = self.merge_long(pieces[i], width).tobytes()
                continue
            step = max(1, (1 << 16) // width)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for i, ids in zip(some, self.merge_many([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n, w = len(pieces), width + 1  # the last column is the end on either side
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, w), self.no_token, dtype=np.int64)
        inside = np.arange(width)[None, :] < length[:, None]
        ids[:, :width] = np.where(inside, self.of_byte[raw], self.no_token)
        after = np.broadcast_to(np.arange(1, w + 1), (n, w)).copy()
        after[after >= length[:, None]] = width
        before = np.broadcast_to(np.arange(-1, w - 1), (n, w)).copy()
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        first = self.pair_rank(ids[:, :width], ids[:, 1:])
        tree[:, width:] = np.where(first < NONE, first * width + np.arange(width), NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def key(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            rank = self.pair_rank(left, right)
            return np.where(rank < NONE, rank * width + at, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            lowest = tree[rows, 1]
            at, merged = lowest % width, lowest // width
            dead = after[rows, at]
            follows, leads = after[rows, dead], before[rows, at]
            ids[rows, at] = merged
            ids[rows, dead] = -1
            after[rows, at] = follows
            before[rows, follows] = at  # for the end column this is never read
            update(rows, dead, np.broadcast_to(NONE, rows.shape))
            update(rows, at, key(merged, ids[rows, follows], at))
            has = leads != width
            if has.any():
                r, p = rows[has], leads[has]
                update(r, p, key(ids[r, p], merged[has], p))
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[:, :width]
        live = (flat >= 0) & inside
        found, ends = flat[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1) * 4).tolist()
        return (found[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def merge_long(self, piece: bytes, width: int) -> np.ndarray:
        none, pairs = 1 << 62, self.pairs
        n = len(piece)
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist() + [self.no_token]
        after, before = list(range(1, n + 1)) + [n], [n, *range(n)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            merged, at = divmod(tree[1], width)
            dead = after[at]
            follows, leads = after[dead], before[at]
            ids[at], ids[dead] = merged, -1
            after[at] = follows
            before[follows] = at
            update(dead, none)
            rank = pairs.get(merged << 32 | ids[follows])
            update(at, none if rank is None else rank * width + at)
            if leads != n:
                rank = pairs.get(ids[leads] << 32 | merged)
                update(leads, none if rank is None else rank * width + leads)
        return np.array([x for x in ids[:n] if x >= 0], dtype="<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def cache(self, pattern: str) -> TokenCache:
        def encode_new(chunks: list[str]) -> list[bytes]:
            cut = list(map(cache.pattern.findall, chunks))
            distinct = list(set().union(*cut))
            ids = dict(zip(distinct, self.pieces([piece.encode() for piece in distinct]), strict=True))
            return [b"".join(map(ids.__getitem__, c)) for c in cut]

        cache = TokenCache(pattern, encode_new)
        return cache


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) per row of `docs`: the ids of the text and their bytes.

    A null text counts as empty: no ids, no bytes. Rows are independent: repeated rows and null ids come out as they
    came in, an empty table gives an empty one, other columns are not read. The rank file is read on the driver.
    """
    with open(rank_path, "rb") as f:
        rank_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = worker_state("bpe", (hash(rank_file), pattern), lambda: (b := SegmentTreeBpe(rank_file), b.cache(pattern)))
        for batch in slices(batches):
            ids = [np.frombuffer(x, dtype="<i4") for x in cache.encode(batch.column("text").to_pylist())]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(offsets, np.concatenate(ids)), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()),
            ], ["doc_id", "n_tokens", "ids", "decoded"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded binary")

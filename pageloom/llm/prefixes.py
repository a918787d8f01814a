"""The prefix trie of conversations, from sorted sequences and range minima over their common prefixes.

Conversations are sorted as sequences of turn digests and dealt out in blocks of that order. In a block every prefix of every
conversation searches left and right by doubling steps through a sparse table of range minima over the lengths of
common prefixes (LCP) of neighbours. The interval it finds holds the prefix's members; prefixes are alone in their
search, no stack is kept. Subtree sums are differences of running sums over an interval. A prefix that reaches over the
edge of a block is summed up over its blocks afterwards; there are at most two conversations' worth of these a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import written

WORD = "[^\\x20\\x09-\\x0D]+"
PART = pa.schema([
    ("key", pa.binary()), ("block", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_key", pa.binary()), ("parent_conv_id", pa.int64()),
    ("first_rank", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_ends", pa.int64()),
    ("ends_sha256", pa.string()), ("ends", pa.list_(pa.int64()))])
KINDS = ", ".join(f"{f.name} {dict(binary='binary', int32='int', int64='long', string='string').get(str(f.type), 'array<long>')}" for f in PART)


def original(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns array<(key, words)>) with the turns in order; 16 bytes of a digest stand for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(
            F.col(turn_col).isNotNull().alias("given"), F.col(turn_col).alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation c - c % family; h is crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("firsts"))
    met = own.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    firsts = F.when(F.col("firsts").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("firsts", F.lit(1), F.col("h")))
    return met.select("conv_id", F.concat(firsts, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at step k the minimum of 2 ** k values from each position on."""
    tables = [values]
    while 2 << len(tables) - 1 <= len(values):
        half, last = 1 << len(tables) - 1, tables[-1]
        tables.append(np.minimum(last[: len(last) - half], last[half:]))
    return tables


def minimum(tables: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of the values from first to last, both included."""
    step = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), dtype=tables[0].dtype)
    for k in np.unique(step):
        at = step == k
        out[at] = np.minimum(tables[k][first[at]], tables[k][last[at] - (1 << int(k)) + 1])
    return out


def extents(tables: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, depth) the first and the last row around it that share that many turns with it."""
    left, right, n = row.copy(), row.copy(), len(tables[0])
    for k in range(len(tables) - 1, -1, -1):
        step, table = 1 << k, tables[k]
        at = right + 1
        fits = at + step <= n
        fits[fits] = table[at[fits]] >= depth[fits]
        right[fits] += step
        at = left - step + 1
        fits = at >= 0
        fits[fits] = table[at[fits]] >= depth[fits]
        left[fits] -= step
    return left, right


def common_lengths(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each sequence but the first, how many turns it begins like the one before it."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(1, len(lengths)), lengths[1:])
    at = np.arange(starts[1], starts[-1])
    place = at - starts[row]
    other = starts[row - 1] + place
    inside = place < lengths[row - 1]
    same = np.zeros(len(at), dtype=bool)
    same[inside] = (keys[at[inside]] == keys[other[inside]]).all(axis=1)
    out = lengths.copy()
    np.minimum.at(out, row[~same], place[~same])
    return out[1:]


def digests(keys: np.ndarray, most: int) -> list[bytes]:
    """Names of the prefixes of a sequence, from none to `most` turns."""
    state, out = hashlib.sha256(), []
    for k in range(most + 1):
        out.append(state.digest()[:16])
        if k < most:
            state.update(keys[k].tobytes())
    return out


def block_nodes(block: int, offset: int, before: list | None, after: list | None, ids: np.ndarray, turns: list[pa.Array], words: list[pa.Array]) -> pa.RecordBatch:
    """The prefixes of one block's conversations, with what the block adds to each; `before` and `after` are the neighbours' keys."""
    m = len(ids)
    flat = np.frombuffer(b"".join([*(before or []), *[k for t in turns for k in t.flatten().to_pylist()], *(after or [])]), dtype="<u8").reshape(-1, 2)
    sizes = np.concatenate([[len(before or [])], *[np.diff(t.offsets.to_numpy()) for t in turns], [len(after or [])]]).astype(np.int64)
    starts = np.append(0, np.cumsum(sizes))
    common = common_lengths(flat, starts)
    opening = int(common[0]) if before is not None else -1  # shared with the block before, and with the one after
    closing = int(common[m]) if after is not None else -1
    lcp, length, starts = np.append(-1, common[1:m]), sizes[1 : m + 1], starts[1 : m + 2]
    said = np.append(0, np.cumsum(np.concatenate([w.flatten().to_numpy(zero_copy_only=False) for w in words]).astype(np.int64)))
    word_at = starts - starts[0]

    def words_of(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return said[word_at[row] + np.maximum(depth, 0)] - said[word_at[row]]

    # Every prefix of every row, the empty one included, searches for itself; a row's candidates start at `own`.
    own = np.append(0, np.cumsum(length + 1))
    row = np.repeat(np.arange(m), length + 1)
    depth = np.arange(own[-1]) - own[row]
    left, right = extents(range_minima(lcp), row, depth)
    first = left == row
    parent = np.where(depth > 0, own[np.append(0, left[:-1])] + depth - 1, -1)  # the prefix before it in its row, at that one's first row
    fresh = first & ~((row == 0) & (depth <= opening))
    children = np.bincount(parent[fresh & (depth > 0)], minlength=own[-1])
    leaf = np.append(lcp[1:], closing) < length
    leaves = np.append(0, np.cumsum(leaf))
    again = np.append(0, words_of(np.arange(1, m), lcp[1:]).cumsum()) if m > 1 else np.zeros(1, dtype=np.int64)
    node = np.flatnonzero(first)
    at, deep, last = row[node], depth[node], right[node]
    reach = np.where(at == 0, np.maximum(deep - 1, opening), deep - 1)
    saved = again[last] - again[at] - (last - at + 1) * words_of(at, deep - 1) + words_of(at, reach)
    smallest = np.full(own[-1], -1, dtype=np.int64)
    smallest[node] = minimum(range_minima(ids), at, last)
    open_ = np.zeros(own[-1], dtype=bool)  # reaches over an edge of the block
    open_[node] = (at == 0) & (deep <= opening) | (last == m - 1) & (deep <= closing)
    equal = np.append(False, (lcp[1:] == length[1:]) & (length[1:] == length[:-1]))
    run_end = np.append(np.flatnonzero(~equal)[1:], m)[np.cumsum(~equal) - 1]  # past the rows equal to each row
    n_ends = np.where(length[at] == deep, run_end[at] - at, 0)
    of_first, of_last = digests(flat[sizes[0] :], max(opening, 0)), digests(flat[starts[m - 1] :], max(closing, 0))

    def name(k: int) -> bytes | None:
        return None if not open_[k] else of_first[depth[k]] if row[k] == 0 and depth[k] <= opening else of_last[depth[k]]

    keys, parent_keys, parent_ids, hashed, ends = [], [], [], [], []
    for k, a, n, p in zip(node.tolist(), at.tolist(), n_ends.tolist(), parent[node].tolist(), strict=True):
        keys.append(name(k))
        parent_keys.append(name(p) if p >= 0 else None)
        parent_ids.append(int(smallest[p]) if p >= 0 and not open_[p] else None)
        members = ids[a : a + n].tolist()
        hashed.append(None if open_[k] else hashlib.sha256(",".join(map(str, members)).encode()).hexdigest())
        ends.append(members if open_[k] else None)
    return pa.RecordBatch.from_arrays([
        pa.array(keys, pa.binary()), pa.array(np.full(len(node), block, dtype=np.int32)), pa.array(deep), pa.array(smallest[node]), pa.array(parent_keys, pa.binary()),
        pa.array(parent_ids, pa.int64()), pa.array(offset + at), pa.array(last - at + 1), pa.array(children[node]), pa.array(leaves[last + 1] - leaves[at]), pa.array(saved),
        pa.array(n_ends), pa.array(hashed, pa.string()), pa.array(ends, pa.list_(pa.int64()))], schema=PART)


def nodes_of_blocks(ordered: DataFrame, blocks: int) -> DataFrame:
    """`PART` per block and prefix; a row between blocks comes to each of them as its neighbour's."""
    edges = ordered.groupBy("block").agg(F.min(F.struct("keys", "conv_id")).alias("first"), F.max(F.struct("keys", "conv_id")).alias("last"), F.count("*").alias("n"))
    order = Window.orderBy("block")  # one row a block
    edges = edges.select(
        "block", F.lag("last.keys").over(order).alias("before"), F.lead("first.keys").over(order).alias("after"),
        (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))

    def marked(side: int, keys: Column, offset: Column, df: DataFrame) -> DataFrame:
        return df.select("block", F.lit(side).alias("side"), keys.alias("keys"), offset.cast("long").alias("conv_id"), F.lit(None).cast("array<long>").alias("words"))

    rows = ordered.select("block", F.lit(0).alias("side"), "keys", "conv_id", "words")
    met = rows.unionAll(marked(-1, F.col("before"), F.col("offset"), edges)).unionAll(marked(1, F.col("after"), F.lit(None), edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, offset, before, ids, turns, words = None, 0, None, [], [], []
        for batch in batches:
            of, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            changes = np.flatnonzero((of[1:] != of[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(of)], strict=True):
                if side[a] == -1:
                    block, offset, before, ids, turns, words = int(of[a]), batch.column("conv_id")[a].as_py(), batch.column("keys")[a].as_py(), [], [], []
                elif side[a] == 0:
                    ids.append(batch.column("conv_id")[a:b].to_numpy())
                    # Copied, so that offsets start at none and the batch can go.
                    turns.append(pa.concat_arrays([batch.column("keys")[a:b].take(pa.array(range(b - a)))]))
                    words.append(batch.column("words")[a:b].take(pa.array(range(b - a))))
                else:
                    found = block_nodes(block, offset, before, batch.column("keys")[a].as_py(), np.concatenate(ids), turns, words)
                    for at in range(0, found.num_rows, 1 << 13):
                        yield found.slice(at, 1 << 13)

    return met.repartitionById(blocks, "block").sortWithinPartitions("block", "side", "keys", "conv_id").mapInArrow(run, KINDS)


def merged(parts: DataFrame) -> DataFrame:
    """One row per prefix that reaches over blocks: sums over them, the ids that end there digested in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([held | {"ends_sha256": state.hexdigest(), "ends": None}], schema=PART)

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if held is None or r["key"] != held["key"]:
                    if held is not None:
                        yield row()
                    held, state = r, hashlib.sha256()
                    some = 0
                else:
                    held = held | {c: held[c] + r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")} | {"conv_id": min(held["conv_id"], r["conv_id"])}
                if r["ends"]:
                    state.update((("," if some else "") + ",".join(map(str, r["ends"]))).encode())
                    some += len(r["ends"])
        if held is not None:
            yield row()

    return parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, KINDS)


def prefix_trie(
    conversations: DataFrame, turns_per_block: int = 1 << 17, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row per distinct sequence of first turns of the rebuilt conversations, none included, that some of them start with.

    (conv_id, depth): smallest member and number of turns, which name a prefix; parent_conv_id: smallest member of the
    prefix without its last turn, null for none; first_rank, n_convs: the interval of members among the sorted
    conversations; n_children; n_leaves: prefixes without children at or below it; saved_tokens: what a store of
    prefixes saves at or below it, words of each last text times members but one; n_ends: members that have no more
    turns; ends_sha256: the digest of their ids in order, joined by commas.

    Turns are ordered by their number, null first, equal ones by a digest of role and text; repeated rows are turns
    of their own. A null role or text is empty. Rows without an id are left out. A conversation with few turns of its own
    may be left with none and ends at the root. An empty table gives an empty one. Columns of other names are not read.

    A task holds `turns_per_block` turns about, or the longest conversation, as digests of 16 bytes; however many
    conversations are equal or start alike, they are dealt out over blocks, since ids break ties in the order.
    """
    spark = conversations.sparkSession
    n = conversations.count()
    blocks = max(-(-n // turns_per_block), min(2 * spark.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    sequences = rebuilt(original(conversations, id_col, turn_col, role_col, text_col)).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    ordered = sequences.repartitionByRange(blocks, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").withColumn("block", F.spark_partition_id())
    ordered = written(ordered, "conversations")
    nodes = written(nodes_of_blocks(ordered, blocks), "prefix-nodes")
    parts = nodes.where("key is not null")
    joined = written(merged(parts), "prefix-edges")
    # Children find a parent that reaches over blocks within their own block, so no parent's children meet in one task.
    parents = parts.select("block", "key").join(joined.select("key", F.col("conv_id").alias("named")), "key").select("block", F.col("key").alias("parent_key"), "named")
    found = nodes.where("key is null").unionAll(joined).join(parents, ["block", "parent_key"], "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "first_rank", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256")

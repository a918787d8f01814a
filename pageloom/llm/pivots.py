"""Embedding near-duplicates by a pivot-permutation index.

Pivots are some of the vectors themselves. A vector is described by its nearest pivots in order of nearness. Inverted
lists hold, per pivot, the vectors that name it. Vectors that share enough pivots meet in the list of their smallest
shared pivot; their cosine is then computed on the vectors as given. Lists are dealt out in blocks, so a long list is many
pairs of blocks on many tasks, and a task returns sums and a spanning forest per block, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import written
from pageloom.llm.components import components

MOST_PIVOTS = 1 << 15  # what a task holds: 16 MB at 64 dimensions
FEWEST_SHARED = 2


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; cosines are the same."""
    _, exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponents[:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def participant(vector: Column) -> Column:
    """True for vectors without null or non-finite parts that are not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_and_classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, h1, h2), and classes of equal vectors (rep, h1, h2, least, m, vector) with smallest id and number of rows.

    A row finds its class by 128 bits of hashes, null for a vector that takes no part. Vectors keep the width they come in.
    """
    kind = vectors.schema[vector_col].dataType
    width = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    given = F.transform(F.col(vector_col).cast(f"array<{width}>"), lambda x: x + F.lit(0).cast(width))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), given.alias("vector"))
    rows = rows.withColumn("vector", F.when(participant(F.col("vector")), F.col("vector")))
    named = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "vector")).alias(f"h{k}") for k in (1, 2)]
    found = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = found.select(F.monotonically_increasing_id().alias("rep"), *named, "least", "m", "vector")
    return rows.select("vec_id", *named), written(classes, "vector-classes")


def described(classes: DataFrame, pivots: np.ndarray, length: int) -> DataFrame:
    """(rep, m, vector, pivots array<int>): the nearest pivots by cosine, the nearest first; ties go to the smaller one.

    Pivots of other lengths count with the components that both have; they only describe, they decide nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors, of = part.column("vector"), np.empty((part.num_rows, length), dtype=np.int32)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(sizes))
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    x = scaled(flat[starts[rows][:, None] + np.arange(size)])
                    near = (x / norms(x)[:, None]) @ pivots[:, :size].T if size <= pivots.shape[1] else (x[:, : pivots.shape[1]] / norms(x)[:, None]) @ pivots.T
                    order = np.argpartition(-near, length - 1, axis=1)[:, :length]
                    order.sort(axis=1)
                    of[rows] = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, axis=1), axis=1, kind="stable"), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, of.size + 1, length, dtype=np.int32)), pa.array(of.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", "m", "vector")], lists], ["rep", "m", "vector", "pivots"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("rep", "m", "vector").mapInArrow(run, f"rep long, m long, vector {kind}, pivots array<int>")


def shared_pairs(pivots: np.ndarray, own: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block pair that share enough pivots, of which `own`, whose list this is, is the smallest.

    Members are counted under the other pivots they name: how often i and j meet there is what they share besides `own`.
    """
    n, length = pivots.shape
    rest = pivots != own
    named, member = pivots[rest], np.repeat(np.arange(n), length)[rest.ravel()]
    order = np.lexsort((member, named))
    named, member = named[order], member[order]
    starts = np.flatnonzero(np.append(True, named[1:] != named[:-1])) if len(named) else np.empty(0, dtype=int)
    ends = np.append(starts[1:], len(named))
    counts = np.zeros(n * n, dtype=np.int32)
    # Position k meets the later ones of its run; a slice of positions at a time bounds the pairs held.
    later = np.repeat(ends, ends - starts) - np.arange(len(named)) - 1
    total, at = np.cumsum(later), 0
    while at < len(named):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        k = np.repeat(np.arange(at, to), later[at:to])
        step = np.arange(len(k)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to]) + 1
        i, j, smaller = member[k], member[k + step], named[k] < own
        # A pair that shares a smaller pivot belongs to that one's list.
        counts += np.bincount(i * n + j, weights=np.where(smaller, -(length + 1), 1), minlength=n * n).astype(np.int32)
        at = to
    i, j = np.divmod(np.flatnonzero(counts >= FEWEST_SHARED - 1), n)
    across = side[i] != side[j] if side.any() else np.ones(len(i), dtype=bool)
    return i[across], j[across]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the smallest member it is connected to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def close(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs have at least this cosine, in double precision."""
    x, keep = scaled(vectors), np.empty(len(i), dtype=bool)
    n = norms(x)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep[at : at + (1 << 15)] = np.einsum("ij,ij->i", x[a], x[b]) / (n[a] * n[b]) >= similarity
    return keep


def links_in_lists(index: DataFrame, similarity: float, block: int) -> DataFrame:
    """(rep, links, root): per block pair and member with links, the rows it is linked to there, and a member it is connected to."""
    sizes = index.select(F.explode("pivots").alias("p")).groupBy("p").agg(F.count("*").alias("size"))  # a row per pivot
    posted = index.select("rep", "m", "vector", "pivots", F.explode("pivots").alias("p"))
    # A pair's list is that of the smallest pivot it shares, and it shares a larger one, so none meets in a member's largest.
    posted = posted.where(F.col("p") < F.array_max("pivots")).join(F.broadcast(sizes), "p")
    posted = posted.withColumn("n", F.ceil(F.col("size") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = posted.select("rep", "m", "vector", "pivots", "p", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    dealt = dealt.select("rep", "m", "vector", "pivots", "p", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") > F.col("o")).alias("side"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, m, vector = (group.column(c).combine_chunks() for c in ("rep", "m", "vector"))
        rep, m, sizes = rep.to_numpy(), m.to_numpy(), np.diff(vector.offsets.to_numpy())
        pivots = group.column("pivots").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        side = group.column("side").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        if group.column("x")[0] == group.column("y")[0]:
            side[:] = False
        elif side.all() or not side.any():
            return empty
        i, j = shared_pairs(pivots, group.column("p")[0].as_py(), side)
        keep = sizes[i] == sizes[j]
        i, j = i[keep], j[keep]
        flat, starts = vector.flatten().to_numpy().astype(np.float64), np.append(0, np.cumsum(sizes))
        linked = np.zeros(len(i), dtype=bool)
        for size in np.unique(sizes[i]):
            pairs = np.flatnonzero(sizes[i] == size)
            rows, place = np.flatnonzero(sizes == size), np.zeros(len(rep), dtype=int)
            place[rows] = np.arange(len(rows))
            linked[pairs] = close(flat[starts[rows][:, None] + np.arange(size)], place[i[pairs]], place[j[pairs]], similarity)
        i, j = i[linked], j[linked]
        links = np.bincount(i, weights=m[j], minlength=len(rep)) + np.bincount(j, weights=m[i], minlength=len(rep))
        some = np.flatnonzero(links)
        root = rep[forest(i, j, len(rep))]
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]}, schema=schema)

    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    empty = schema.empty_table()
    return dealt.groupBy("p", "x", "y").applyInArrow(run, "rep long, links long, root long")


def similar_vectors(
    vectors: DataFrame, similarity: float = 0.9, per_root: float = 4.0, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links are pairs found with at least this cosine, none below it.

    n_links counts the other rows linked directly, component_id is the smallest id reachable by links, the row's own
    included, kept is whether that is the row's own. Equal vectors always link; they are one class from the start, so
    copies cost nothing more. The others are found if they share `FEWEST_SHARED` of their nearest pivots; the recall
    is measured in the tests. Only vectors of one length link. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing. A null id takes part but is never the smallest; a component of null ids
    alone has a null one, and its rows are kept. Repeated rows come out repeated and link. An empty table gives an
    empty one.

    There are `per_root` times the square root of the classes of pivots, those with the smallest hashes, `MOST_PIVOTS`
    at most, so lists stay short and random pairs rarely share two. A list of over `block` members is cut into
    blocks, and each pair of blocks is a group of its own: no row is left out, and no task holds more than two blocks.
    """
    rows, classes = rows_and_classes(vectors, id_col, vector_col)
    n = classes.count()
    chosen = classes.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(min(n, MOST_PIVOTS, math.ceil(per_root * math.sqrt(n)) + 2)).collect()
    pivots = np.zeros((len(chosen), max((len(r.vector) for r in chosen), default=0)))
    for at, r in enumerate(chosen):
        x = scaled(np.array([r.vector], dtype=np.float64))
        pivots[at, : len(r.vector)] = x[0] / norms(x)[0]
    length = min(len(pivots), max(8, len(pivots).bit_length()))
    index = written(described(classes, pivots, length), "pivot-lists")
    linked = written(links_in_lists(index, similarity, block), "vector-links")
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    sums = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = classes.select("rep", "h1", "h2", "least", "m").join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "root").select("h1", "h2", "n_links", "component_id")
    full = rows.join(known, ["h1", "h2"], "left")
    of = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.col("vec_id").eqNullSafe(of).alias("kept"))

"""Nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

A shard's graph is a set of flat arrays: vectors, neighbours per node and layer, and the ids that share a vector. One
index row holds one shard; index rows are stored in the shared folder. A search sends every query to every shard, each
of which streams its queries past its graph, and keeps the best of what the shards found.

Inner products are turned into distances by one more component, which gives all vectors of a graph the same norm. That
works where norms are alike, so a shard holds one graph per band of norms. A search goes from the longest band down and
ends where no vector of a shorter one can enter its list, by the bound |q| |x|; without that bound it visits all bands.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import written


class Graph:
    """Hierarchical navigable small-world graph over the rows of `vectors`."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, breadth: int = 80):
        self.vectors, self.degree, self.breadth = vectors, degree, breadth
        norm2 = (vectors * vectors).sum(axis=1)
        extra = np.sqrt(np.maximum(norm2.max(initial=0.0) - norm2, 0))
        self.points = np.ascontiguousarray(np.hstack([vectors, extra[:, None]]).astype(np.float32))
        n = len(vectors)
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-300) / math.log(degree)).astype(int), 12)
        # Twice the degree in the lowest layer; lists may overflow to half as much again before they are thinned.
        self.links = [np.full((n, 3 * degree if layer == 0 else 2 * degree), -1, dtype=np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1

    def build(self) -> Graph:
        for node in range(len(self.points)):
            self.insert(node)
        return self

    def insert(self, node: int) -> None:
        top = int(self.level[node])
        if self.entry < 0:
            self.entry = node
            return
        q, highest = self.points[node], int(self.level[self.entry])
        near = self.descend(q, highest, top)
        for layer in range(min(top, highest), -1, -1):
            found = self.search_layer(q, near, self.breadth, layer)
            chosen = self.spread([i for _, i in found], np.array([d for d, _ in found], dtype=np.float32), self.degree)
            links = self.links[layer]
            links[node, : len(chosen)] = chosen
            for other in chosen:
                row = links[other]
                free = int((row >= 0).sum())
                if free == len(row):
                    ids = np.append(row, node)
                    distances = self.distances(self.points[other], ids)
                    order = np.argsort(distances, kind="stable")
                    kept = self.spread(ids[order].tolist(), distances[order], 2 * self.degree if layer == 0 else self.degree)
                    row[:] = -1
                    row[: len(kept)] = kept
                else:
                    row[free] = node
            near = [i for _, i in found]
        if top > highest:
            self.entry = node

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        gap = self.points[ids] - q
        return np.einsum("ij,ij->i", gap, gap)

    def spread(self, ids: list[int], distances: np.ndarray, most: int) -> list[int]:
        """Of candidates from near to far those nearer to the node than to one already taken, then the nearest others."""
        if len(ids) <= most:
            return list(ids)
        points = self.points[ids]
        square = (points * points).sum(axis=1)
        between = square[:, None] + square[None, :] - 2 * points @ points.T
        closest = np.full(len(ids), np.inf, dtype=np.float32)
        taken, rest = [], []
        for k in range(len(ids)):
            if len(taken) == most:
                break
            if distances[k] < closest[k]:
                taken.append(k)
                np.minimum(closest, between[k], out=closest)
            else:
                rest.append(k)
        return [ids[k] for k in taken + rest[: most - len(taken)]]

    def descend(self, q: np.ndarray, highest: int, lowest: int) -> list[int]:
        node = self.entry
        best = float(self.distances(q, np.array([node]))[0])
        for layer in range(highest, lowest, -1):
            while True:
                row = self.links[layer][node]
                ids = row[row >= 0]
                if not len(ids):
                    break
                distances = self.distances(q, ids)
                k = int(distances.argmin())
                if distances[k] >= best:
                    break
                best, node = float(distances[k]), int(ids[k])
        return [node]

    def search_layer(self, q: np.ndarray, entries: list[int], breadth: int, layer: int) -> list[tuple[float, int]]:
        """Up to `breadth` (distance, node), nearest first, by best-first search."""
        links, seen = self.links[layer], np.zeros(len(self.points), dtype=bool)
        start = np.array(entries)
        seen[start] = True
        first = self.distances(q, start).tolist()
        todo = sorted(zip(first, entries, strict=True))
        best = [(-d, i) for d, i in todo[:breadth]]
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            row = links[node]
            ids = row[row >= 0]
            ids = ids[~seen[ids]]
            if not len(ids):
                continue
            seen[ids] = True
            distances = self.distances(q, ids)
            if len(best) >= breadth:
                nearer = distances < -best[0][0]
                ids, distances = ids[nearer], distances[nearer]
            for e, i in zip(distances.tolist(), ids.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-e, i))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, i))
                else:
                    continue
                heapq.heappush(todo, (e, i))
        return sorted((-d, i) for d, i in best)

    def search(self, q: np.ndarray, breadth: int) -> list[int]:
        if self.entry < 0:
            return []
        point = np.append(q, 0).astype(np.float32)
        near = self.descend(point, int(self.level[self.entry]), 0)
        return [i for _, i in self.search_layer(point, near, breadth, 0)]


BAND = 1.25  # the longest vector of a band is at most this much longer than the shortest


def unit_scale(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows times a power of two each (none overflows or vanishes), the exponents, and the logarithms (base 2) of norms."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    rows = np.ldexp(vectors, -exponents[:, None])
    return rows, exponents, np.log2(np.sqrt(np.einsum("ij,ij->i", rows, rows))) + exponents


class Shard:
    """The graphs of a shard's vectors, none zero, one per band of norms, the longest first."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        rows, exponents, logs = unit_scale(vectors)
        bands = np.floor(logs / math.log2(BAND)).astype(np.int64)
        order = np.lexsort((np.arange(len(bands)), -bands))
        cuts = np.flatnonzero(np.append(True, bands[order][1:] != bands[order][:-1]))
        self.members = np.split(order, cuts[1:]) if len(order) else []
        self.longest = [float(logs[m].max()) for m in self.members]
        self.exponents = [math.ceil(x) for x in self.longest]
        self.graphs = [Graph(np.ldexp(rows[m], (exponents[m] - e)[:, None])) for m, e in zip(self.members, self.exponents, strict=True)]

    def build(self) -> Shard:
        for graph in self.graphs:
            graph.build()
        return self

    def search(self, q: np.ndarray, breadth: int, k: int) -> np.ndarray:
        """Places of vectors among which the k of the largest inner product with q are looked for."""
        point = unit_scale(q[None, :])[0][0]
        point = point / np.sqrt(point @ point)
        found, best = [], []
        for members, longest, exponent, graph in zip(self.members, self.longest, self.exponents, self.graphs, strict=True):
            if len(best) == k and best[0] > longest + 1e-9:
                break
            near = np.array(graph.search(point, breadth), dtype=int)
            found.append(members[near])
            scores = graph.vectors[near] @ point
            for score in np.log2(scores[scores > 0]) + exponent:
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, float(score))
        return np.concatenate(found) if found else np.empty(0, dtype=int)

    def pack(self, ids: np.ndarray, owner: np.ndarray) -> bytes:
        out, arrays = io.BytesIO(), {}
        for b, graph in enumerate(self.graphs):
            arrays |= {f"level{b}": graph.level, f"entry{b}": graph.entry} | {f"links{b}_{j}": x for j, x in enumerate(graph.links)}
        np.savez(out, vectors=self.vectors, ids=ids, owner=owner, **arrays)
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> tuple[Shard, np.ndarray, np.ndarray]:
        held = np.load(io.BytesIO(raw))
        shard = Shard(held["vectors"])
        for b, graph in enumerate(shard.graphs):
            graph.level, graph.entry = held[f"level{b}"], int(held[f"entry{b}"])
            graph.links = [held[f"links{b}_{j}"] for j in range(int(graph.level.max(initial=0)) + 1)]
        return shard, held["ids"], held["owner"]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows with an id and a vector without null or non-finite parts that is not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    v = F.col("vector")
    return rows.where(
        F.col("id").isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.exists(v, lambda x: x != 0))


def shard_of(vector: Column, shards: int) -> Column:
    """Vectors of different lengths have shards of their own."""
    return F.size(vector).cast("long") * F.lit(1 << 24) + F.pmod(F.xxhash64(vector), F.lit(shards))


def task_of(shards: int) -> Column:
    """A shard's own task; shards of other lengths join those of the same number."""
    return F.pmod(F.col("shard"), F.lit(1 << 24)).cast("int") % shards


def floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """(shard, graph binary), one row a shard. Equal vectors are one node with its k + 1 smallest ids, which is all that
    a list of the k nearest without the query itself can need, so a vector of any number of rows costs no more."""
    smallest = Window.partitionBy("vector").orderBy("id")
    nodes = rows.dropDuplicates(["id", "vector"]).withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = nodes.select(shard_of(F.col("vector"), shards).alias("shard"), F.xxhash64("vector").alias("hash"), "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts = None, [], []

        def graph() -> pa.RecordBatch:
            vectors = np.concatenate(parts)
            new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
            packed = Shard(vectors[new]).build().pack(np.concatenate(ids), np.cumsum(new) - 1)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed], pa.binary())], ["shard", "graph"])

        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of[a] != shard and parts:
                    yield graph()
                    ids, parts = [], []
                shard = int(of[a])
                ids.append(batch.column("id")[a:b].to_numpy())
                parts.append(floats(batch.column("vector")[a:b]))
        if parts:
            yield graph()

    ordered = nodes.repartitionById(shards, task_of(shards)).sortWithinPartitions("shard", "hash", "vector", "id")
    return written(ordered.mapInArrow(run, "shard long, graph binary"), "graphs")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, breadth: int = 80, rows_per_shard: int = 1 << 16,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where `queries` holds, from all other rows.

    Nearest is the largest inner product, computed in double precision on the vectors as given; ties go to the smaller
    id. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an
    id. Repeated rows are one; a query's own id is never found. Only vectors of its length are candidates. With fewer
    candidates than k all are returned; an empty table gives an empty one. `queries` reads the columns of `vectors`.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    shards = max(math.ceil(n / rows_per_shard), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 512)), 1)
    index = build_index(rows, shards, k)
    asked = usable(vectors.where(queries), id_col, vector_col).dropDuplicates(["id", "vector"])
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "id", "vector").select(
        (F.size("vector").cast("long") * F.lit(1 << 24) + F.col("s")).alias("shard"), F.lit(None).cast("binary").alias("graph"), "id", "vector")
    held = index.select("shard", "graph", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph, ids, order, first = None, None, None, None, None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            columns = [batch.column(c) for c in ("shard", "graph", "id", "vector")]
            for shard, packed, own, vector in zip(*columns, strict=True):
                if packed.is_valid:
                    graph, ids, owner = Shard.unpack(packed.as_buffer().to_pybytes())
                    at, first = shard.as_py(), np.searchsorted(owner, np.arange(len(graph.vectors) + 1))
                    continue
                if shard.as_py() != at:
                    continue  # a shard without vectors
                q = vector.values.to_numpy()
                found = graph.search(q, max(breadth, 2 * k), k + 1)
                scores = graph.vectors[found] @ q
                mine, best = own.as_py(), []
                for node, score in sorted(zip(found.tolist(), scores.tolist(), strict=True), key=lambda x: -x[1])[: k + 1]:
                    best.extend((-score, int(i)) for i in ids[first[node] : first[node + 1]] if i != mine)
                out.extend((mine, i, -score) for score, i in sorted(best)[:k])
            query_id, vec_id, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    met = held.unionAll(sent).repartitionById(shards, task_of(shards)).sortWithinPartitions("shard", F.col("id").asc_nulls_first())
    found = met.mapInArrow(run, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

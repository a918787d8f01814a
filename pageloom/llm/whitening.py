"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the centred rows, each step is one distributed pass: every task multiplies its rows by a vector (u = Xv) and its
share of u by its rows (X^T u), and sends back one vector. A left vector u is a combination X y of the rows, so tasks rebuild
it from y and nothing as long as the table is kept. Both sides are fully reorthogonalised: the right vectors against each
other, the left ones by the products X^T u of earlier steps, (X^T u) v being u (X v). The small bidiagonal matrix is
decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import written

BLOCK = 1 << 12
EXACT = 1 << 62


@dataclass
class Spectrum:
    """Of n distinct rows: exact sums per dimension, eigenvectors (a column each) and eigenvalues, falling, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows as integers, a few thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield matrix(batch.column("x").slice(at, BLOCK))


def exact(x: np.ndarray, terms: int) -> np.ndarray:
    """The same integers in a type in which sums of so many of them, or products with so many, do not overflow."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    return x if most * terms < EXACT else x.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows minus the mean; n x - S is exact, so nothing cancels before the one division."""
    scaled = exact(x, 2 * n) * n - np.array(sums, dtype=object if max(map(abs, sums), default=0) >= EXACT else np.int64)
    return (scaled / n).astype(np.float64)


def total(fit: DataFrame, tasks: int, of: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of one vector of doubles each; what reaches the driver is bounded by the tasks, not by the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of(blocks(batches)).tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = [r.sums for r in fit.select("x").coalesce(tasks).mapInArrow(run, "sums array<double>").collect()]
    return np.sum(np.array(parts), axis=0)


def exact_sums(fit: DataFrame, tasks: int) -> tuple[int, list[int]]:
    """Number of rows and sums per dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for x in blocks(batches):
            found = exact(x, len(x)).sum(axis=0).astype(object)
            n, sums = n + len(x), found if sums is None else sums + found
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

    parts = fit.select("x").coalesce(tasks).mapInArrow(run, "n long, sums array<string>").collect()
    return sum(r.n for r in parts), [sum(map(int, column)) for column in zip(*[r.sums for r in parts], strict=True)]


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, size: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values, falling, of X given v -> (X^T X v, |X v|^2).

    `size` is the norm of X, against which a length counts as zero. A chain that ends early, as it does where values
    repeat or vectors span less than all, is continued from a new direction, until all d or `steps` are spanned.
    """
    rng = np.random.default_rng(12)
    right, left, back = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))
    entries: list[tuple[int, int, float]] = []
    nothing = 1e-13 * size

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    while right.shape[1] < min(d, steps):
        j = right.shape[1]
        right = np.column_stack([right, v])
        z = v.copy()
        for _ in range(2):
            z = z - left @ (back.T @ z)
        u_back, length2 = product(z)
        alpha, beta = np.sqrt(length2), 0.0
        if alpha > nothing:
            entries.append((left.shape[1], j, float(alpha)))
            left, back = np.column_stack([left, z / alpha]), np.column_stack([back, u_back / alpha])
            rest = apart(u_back / alpha)
            beta = float(np.linalg.norm(rest))
        if right.shape[1] == d:
            break
        if beta > nothing:
            entries.append((left.shape[1] - 1, j + 1, beta))
            v = rest / beta
        else:
            v = apart(rng.standard_normal(d))
            v = apart(v / np.linalg.norm(v))
            v /= np.linalg.norm(v)
    small = np.zeros((max(left.shape[1], 1), right.shape[1] + 1))
    for i, j, value in entries:
        small[i, j] = value
    _, values, rows = np.linalg.svd(small[:, : right.shape[1]], full_matrices=False)
    return right @ rows.T, values


def spectrum(fit: DataFrame, d: int, components: int, steps: int | None = None) -> Spectrum:
    """The leading eigenvectors and eigenvalues of the covariance (divisor n) of the rows x of `fit`, all of d dimensions."""
    tasks = max(1, 2 * fit.sparkSession.sparkContext.defaultParallelism)
    n, sums = exact_sums(fit, tasks)

    def squares(rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([sum(float((centred(x, n, sums) ** 2).sum()) for x in rows)])

    all_squares = float(total(fit, tasks, squares)[0])

    def product(z: np.ndarray) -> tuple[np.ndarray, float]:
        def both(rows: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(d + 1)
            for x in rows:
                c = centred(x, n, sums)
                u = c @ z
                out[:d] += u @ c
                out[d] += u @ u
            return out

        found = total(fit, tasks, both)
        return found[:d], float(found[d])

    if not all_squares:
        return Spectrum(n, sums, np.empty((d, 0)), np.empty(0), 0.0, 0.0)
    vectors, singular = bidiagonalise(product, d, np.sqrt(all_squares), d if steps is None else max(steps, components))
    k = min(components, int((singular > 1e-12 * singular[0]).sum()))
    vectors, values = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0), singular[:k] ** 2 / n
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)

    def moments(middle: np.ndarray, power: int) -> np.ndarray:
        def of(rows: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(k ** power)
            for x in rows:
                w = (centred(x, n, sums) @ vectors) / np.sqrt(values) - middle
                out += w.sum(axis=0) if power == 1 else (w.T @ w).ravel()
            return out

        return total(fit, tasks, of) / n

    covariance = moments(moments(np.zeros(k), 1), 2).reshape(k, k)
    return Spectrum(n, sums, vectors, values, all_squares / n, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; null where a long cannot hold it."""
    low, high = min(int(x.min()), 0), max(int(x.max()), 0)
    most = max(abs(n * low), abs(n * high)) + max(map(abs, sums))
    wide = most * most * x.shape[1] >= EXACT
    gap = x.astype(object if wide else np.int64) * n - np.array(sums, dtype=object if wide else np.int64)
    return [int(s) if s < 1 << 63 else None for s in (gap * gap).sum(axis=1)]


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, steps: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component, numbered from 1.

    Parts of a vector become whole numbers, floor(scale * part). The covariance is that of the distinct vectors, n of
    them, divisor n, centred before multiplying. `whitened` is the centred row on the component over its deviation,
    `explained` the component's share of the variance, `deviation` the exact sum over dimensions of (n x - S) squared,
    null where a long cannot hold it; `identity_error` tells how far the covariance of the whitened vectors is from one.

    Vectors that are null, empty or hold a null or non-finite part are left out. Vectors have one length: the most
    frequent among the distinct ones, the longer on a tie; others are left out. Repeated rows and rows without an id come
    out as often as they go in. There are fewer components where the vectors span fewer dimensions, and so no rows for
    an empty table or for one distinct vector. A direction's sign makes its largest entry positive. `steps` bounds the
    passes over the vectors, which are otherwise as many as dimensions; with it, components are those found so far, and of
    equal eigenvalues some may be missing.
    """
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(~odd, F.lit(False)) & (F.size("v") > 0)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))
    fit = written(rows.select("x").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths.d if lengths else 1
    fit, rows = fit.where(F.size("x") == d), rows.where(F.size("x") == d)
    found = spectrum(fit, d, components, steps) if lengths else Spectrum(0, [], np.empty((d, 0)), np.empty(0), 0.0, 0.0)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column("x"))
                white = (centred(x, found.n, found.sums) @ found.vectors) / np.sqrt(found.values)
                of, m = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, found.n, dtype=np.int64)),
                    pa.array(deviations(x, found.n, found.sums), pa.int64()).take(of), pa.array(white.ravel()),
                    pa.array(np.tile(found.values / found.trace, len(x))), pa.array(np.full(m, found.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

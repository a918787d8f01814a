"""Near-duplicate vectors and whitening against plain numpy."""

import numpy as np
import pytest

from pageloom.llm import pivots, queries, whitening


def brute(ids, vectors, similarity=0.9):
    """(n_links, component) by all pairs, in blocks."""
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = [np.flatnonzero(v @ x >= similarity) for x in v]
    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in enumerate(near):
        for j in js:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(v)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(near[i]) - 1, least[find(i)]) for i in range(len(v))}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_op11_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    got = queries.op11_embedding_near_duplicates(spark, "/root/testdata/sf0.1")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    true, got = brute([r.vec_id for r in rows], [r.embedding for r in rows]), found(got)
    assert got == true  # no vector of this table is near another


def noisy(rng, centres, copies, noise):
    """Copies of each centre at cosines from 1 down to below the threshold."""
    x = np.repeat(centres, copies, axis=0)
    return x + rng.random((len(x), 1)) * noise * rng.standard_normal(x.shape)


@pytest.mark.parametrize("block", [1024, 40])
def test_recall_with_pairs_at_the_threshold_and_crowded_lists(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 48))
    vectors = np.concatenate([noisy(rng, centres, 6, 0.5), noisy(rng, centres[:1], 300, 0.25), rng.standard_normal((600, 48))]) * 10.0 ** rng.integers(-3, 4, (1800, 1))
    ids = [int(i) for i in rng.permutation(len(vectors))]
    true = brute(ids, vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = found(pivots.similar_vectors(df, block=block))
    assert all(got[i][0] <= true[i][0] for i in true)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in true.values())


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    vectors = noisy(rng, rng.standard_normal((4, 16)), 60, 0.4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert found(pivots.similar_vectors(df, block=7)) == found(pivots.similar_vectors(df)) == found(pivots.similar_vectors(df.repartition(5)))


def test_odd_vectors(spark):
    big, small = 1e200, 1e-200
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, None),
            (10, [big, big]), (9, [small, small]), (11, [1.0, 1.0]), (12, [-1.0, -1.0]), (13, [1.0, 1.0, 0.0]), (14, [2.0, 2.0, -0.0]), (15, [2.0, 2.0, 0.0]),
            (None, [5.0, -5.0]), (None, [5.0, -5.0]), (20, [0.0, 3.0, 4.0]), (20, [0.0, 3.0, 4.0]), (None, [-7.0, -7.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, kept string, rep int").repartition(3)
    got = sorted(pivots.similar_vectors(df).collect(), key=str)
    expected = [(i, 0, i, True) for i in range(7)] + [(9, 2, 9, True), (10, 2, 9, False), (11, 2, 9, False), (12, 1, 12, True), (13, 2, 13, True), (14, 2, 13, False), (15, 2, 13, False),
                (None, 1, None, True), (None, 1, None, True), (20, 1, 20, True), (20, 1, 20, True), (None, 1, 12, False)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert pivots.similar_vectors(df.limit(0)).count() == 0
    assert found(pivots.similar_vectors(df.where("vec_id = 11"))) == {11: (0, 11)}


def test_similarity_at_the_threshold_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(pivots.similar_vectors(df)) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def plain(vectors, scale=256):
    """Distinct whole vectors, their mean, and the eigenvectors and eigenvalues of their covariance, falling."""
    x = np.unique(np.floor(scale * np.asarray(vectors, dtype=np.float64)), axis=0)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, x.mean(axis=0), values[::-1], directions[:, ::-1]


def test_op12_against_a_dense_decomposition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    fit, mean, values, directions = plain([r.embedding for r in rows])
    sums = [int(s) for s in fit.sum(axis=0)]
    out = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.1").toPandas().set_index(["component", "vec_id"]).sort_index()
    assert len(out) == 4 * len(rows) and (out.n == len(fit)).all() and out.identity_error.max() < 1e-9
    for k in range(4):
        of = out.loc[k + 1].loc[[r.vec_id for r in rows]]
        x = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float64))
        white = (x - mean) @ directions[:, k] / np.sqrt(values[k])
        white *= np.sign(white @ of.whitened)
        assert np.abs(white - of.whitened).max() < 1e-9
        assert np.allclose(of.explained, values[k] / values.sum(), rtol=1e-10)
        assert of.deviation.tolist() == [sum((len(fit) * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def whitened(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, whitened double").repartition(3)
    return whitening.whiten(df, **options).toPandas()


def test_whitening_of_odd_and_repeated_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 3)) * [4, 2, 1])]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, [float("-inf"), 0.0, 0.0])]
    out = whitened(spark, [*rows, *odd, *rows[:5], (None, rows[0][1]), (200, [0.0, 0.0, 0.0])])
    assert len(out) == 3 * (60 + 5 + 1 + 1) and set(out.component) == {1, 2, 3} and (out.n == 61).all() and out.vec_id.isna().sum() == 3
    assert abs(out.drop_duplicates("component").explained.sum() - 1) < 1e-12 and out.identity_error.max() < 1e-10
    assert len(whitened(spark, [])) == len(whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == len(whitened(spark, odd[:4])) == 0


def test_whitening_with_equal_eigenvalues_and_few_dimensions(spark):
    """Repeated eigenvalues need more than one chain; vectors that span a plane have two components."""
    axes = [(i, (s * row).tolist()) for i, (s, row) in enumerate((s, row) for s in (-1, 1) for row in np.eye(6))]
    out = whitened(spark, axes)
    assert len(out) == 48 and np.allclose(out.explained, 1 / 6) and out.identity_error.max() < 1e-10
    plane = [(i, [float(p) for p in (a, b, a + b, 2 * a, 0)]) for i, (a, b) in enumerate((a, b) for a in range(5) for b in range(7))]
    out = whitened(spark, plane)
    assert set(out.component) == {1, 2} and abs(out.drop_duplicates("component").explained.sum() - 1) < 1e-12


def test_whitening_of_large_parts_is_exact_where_a_long_holds_it(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 5.0]), (3, [3e11, 2.0])]
    out = whitened(spark, rows)
    assert out.deviation.isna().all() and out.identity_error.max() < 1e-6
    out = whitened(spark, [(1, [1e6, 1.0]), (2, [-1e6, 5.0]), (3, [3e5, 2.0])])
    x = np.array([[256 * 10**6, 256], [-256 * 10**6, 1280], [256 * 3 * 10**5, 512]], dtype=object)
    assert dict(zip(out.vec_id, out.deviation, strict=True)) == {i + 1: sum((3 * x[i] - x.sum(axis=0)) ** 2) for i in range(3)}

"""Whitening against plain matrix products, and on odd rows."""

import itertools

import numpy as np
import pytest

from presswire.llm import whitening

VECTORS = "vec_id long, embedding array<double>, n int, x string"


def test_products_are_exact():
    draw = np.random.default_rng(1)
    for rows, size, top in ((1, 1, 1), (63, 3, 7), (65, 5, 300), (200, 4, 2**40), (70, 3, 2**63)):
        y = draw.integers(0, top, (rows, size), np.uint64, endpoint=True)
        big = y.astype(object)
        assert (whitening.products(y) == big.T @ big).all()


@pytest.mark.parametrize("low, high", [(-200, 200), (-2**62, 2**62), (5, 6)])
def test_scatter_and_its_parts(low, high):
    x = np.random.default_rng(2).integers(low, high, (500, 4))
    held = whitening.Scatter(4)
    for start in range(0, 500, 128):
        held.add(np.ascontiguousarray(x[start:start + 128]))
    big = x.astype(object)
    assert held.n == 500 and (held.sums == big.sum(axis=0)).all() and (held.cross == big.T @ big).all()
    cells = held.cells()
    assert len(cells) == 1 + 4 + 10
    for row in cells.itertuples():
        value = sum(getattr(row, f"l{k}") << 32 * k for k in range(whitening.LIMBS))
        assert value == (held.n if row.i < 0 else held.sums[row.i] if row.j < 0 else held.cross[row.i, row.j])


def test_whitened_against_a_plain_covariance(spark, sf):
    from presswire.llm.queries import op11_whitening

    found = op11_whitening(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.floor(np.stack(rows.embedding.to_numpy()).astype(float) * 256).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = (n * (fit.T @ fit) - np.outer(sums, sums)) / n**2
    e, axes = np.linalg.eigh(v)
    assert len(found) == 4 * len(rows) and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    for c in range(4):
        one = found[found.component == c + 1].set_index("vec_id").loc[rows.vec_id]
        mine = (x - sums / n) @ axes[:, -1 - c] / np.sqrt(e[-1 - c])
        assert min(np.abs(one.whitened - mine).max(), np.abs(one.whitened + mine).max()) < 1e-9
        assert np.allclose(one.explained, e[-1 - c] / np.trace(v), rtol=1e-9)
        assert (one.deviation == ((n * x - sums) ** 2).sum(axis=1)).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 5, "a"), (1, [1.0, 2.0], 5, "a"), (None, [0.0, 1e308], 5, "b"), (2, [float("nan"), 1.0], 5, None), (3, None, 1, "c"),
            (4, [], 2, "d"), (5, [1.0, None], 2, "e"), (6, [1.0, 2.0, 3.0], 1, "f"), (7, [float("-inf"), 3.0], 0, "g"), (8, [-0.0, 0.5], 1, "h")]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted([(1, 1), (1, 2)] * 2 + [(0, 1), (0, 2), (6, 1), (6, 2), (6, 3), (8, 1), (8, 2)])
    fit = [(256, 512), (0, 2**63 - 1), (0, 128)]
    sums = [sum(c) for c in zip(*fit)]
    for r in found:
        if r.vec_id == 6:  # alone among vectors of three entries: no variance
            assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None)
        else:
            x = {1: fit[0], None: fit[1], 8: fit[2]}[r.vec_id]
            assert r.n == 3 and r.deviation is None  # beyond a long
            assert int(r.deviation_exact) == sum((3 * c - s) ** 2 for c, s in zip(x, sums)) and r.identity_error < 1e-4


def test_ties_long_vectors_and_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    # equal eigenvalues: any axes will do, all rows on the same ones
    corners = [(i, [float(a) for a in c], i, "") for i, c in enumerate(itertools.product((0, 1), repeat=3))]
    found = whitening.whiten(spark.createDataFrame(corners, VECTORS)).toPandas()
    assert np.allclose(found.explained, 1 / 3) and found.identity_error[0] < 1e-9
    assert np.allclose(found.groupby("vec_id").whitened.apply(lambda w: (w**2).sum()), 3)
    draw = np.random.default_rng(3)
    wide = [(i, draw.normal(size=300).tolist(), i, "") for i in range(20)]
    assert whitening.whiten(spark.createDataFrame(wide, VECTORS)).toPandas().identity_error.max() < 1e-9

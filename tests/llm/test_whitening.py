import numpy as np
import pytest

from tests.conftest import SF
from tracewell.llm import queries, whitening


def brute(x, k=4):
    """{component: (whitened, explained)} up to the sign, and the deviations, of long vectors x."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {i + 1: ((x - s / n) @ v[:, i] / np.sqrt(e[i]), e[i] / (c * c).sum() * n) for i in range(k)}, ((n * x - s) ** 2).sum(1), n


def held_against_brute(rows, ids, x, k=4):
    parts, far, n = brute(x, k)
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, got in by.items():
        want, share = parts[c]
        order = {i: j for j, i in enumerate(ids)}
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: order[r.vec_id])])
        assert len(mine) == len(x) and min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert all(abs(r.explained - share) < 1e-9 * share and r.n == n and r.identity_error < 1e-9 for r in got)
        assert [r.deviation for r in sorted(got, key=lambda r: order[r.vec_id])] == far.tolist()


def test_query_equals_eigendecomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    held_against_brute(queries.op12_embedding_whitening(spark, SF).collect(), [r.vec_id for r in rows], x)


def test_copies_count_once_and_odd_rows_are_left_out(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(60, 6)).astype(np.float32)
    v[40:] = v[3]  # a group of copies under ids of their own
    rows = [(i, [float(c) for c in r], "a", 1.0) for i, r in enumerate(v)]
    odd = [(100, None, None, None), (101, [1.0, None] + [0.0] * 4, "x", 0.1), (102, [float("nan")] + [0.0] * 5, None, 2.0), (103, [float("inf")] * 6, "y", None)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x string, whitened double")
    got = whitening.whiten(table).collect()
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    held_against_brute(got, list(range(60)), x)
    assert {r.n for r in got} == {40}


def test_null_ids_repeated_rows_and_short_vectors(spark):
    rows = [(None, [1.0, 2.0, 0.5]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, []), (9, [3.0, -1.0, 0.25]), (10, [1.0, 1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 18 and {r.n for r in got} == {5}
    assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 7 for r in got) == 6
    full = np.array([v + [0.0] * (3 - len(v)) for _, v in rows])
    far = ((5 * np.floor(256 * full) - np.floor(256 * np.unique(full, axis=0)).sum(0)) ** 2).sum(1)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(far.astype(int).tolist())


def test_components_without_variance_have_no_rows(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-12
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("width", [3, 20, 150])
def test_iteration_on_close_eigenvalues(width):
    rnd = np.random.default_rng(width)
    q = np.linalg.qr(rnd.normal(size=(width, width)))[0]
    values = 1 + np.linspace(1, 0, width) ** 2 * 0.3
    v = q * values @ q.T
    seen = []

    def times(block):
        seen.append(block.shape[1])
        return v @ block

    y, e, residuals = whitening.leading(times, width)
    k = min(4, width)
    assert np.allclose(e, values[:k], rtol=1e-12) and residuals.max() < 1e-11
    assert np.abs(np.abs(y.T @ q[:, :k]) - np.eye(k)).max() < 1e-7
    assert max(seen) <= 12 and len(seen) < 60


def test_uncertified_components_raise():
    v = np.diag(np.linspace(2, 1, 300))
    with pytest.raises(ArithmeticError):
        whitening.leading(lambda q: v @ q, 300, passes=3)


def test_deviation_beyond_a_long_raises():
    w = whitening.Whitening(10**6, np.array([0]), np.eye(1), np.ones(1), 1.0, np.zeros(1))
    with pytest.raises(OverflowError):
        w.deviations(np.array([[10**5]]))

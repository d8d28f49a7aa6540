import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF
from tracewell.llm import ann, queries, topk, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def made(seed, n, width=16, spread=0.3):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(12, width))
    return (centers[rnd.integers(0, 12, n)] + spread * rnd.normal(size=(n, width))).astype(np.float32)


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("least", [64, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "LEAST_ROWS", least)
    monkeypatch.setattr(topk, "STEP", 16)
    x = made(1, 400)
    x[100:140] = x[100]  # ties
    got = ranked(topk.exact_top_k(table(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])).collect())
    y = np.floor(256 * x.astype(float)).astype(np.int64)
    for q in range(0, 400, 50):
        s = y @ y[q]
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        assert got[q] == [(int(i), int(s[i])) for i in want]


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (50, [0.0, 0.0], 0), (1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [], 0), (6, [3.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (8, [1e30, 1.0], 0)]
    got = ranked(topk.exact_top_k(table(spark, rows)).collect())
    assert [i for i, _ in got[0]] == [8, 7, 7, 6, 5] and got[0][0][1] == topk.LONG and got[0][3] == (6, 256 * 768)
    assert [i for i, _ in got[50]] == [0, 0, 5, 6, 7] and {s for _, s in got[50]} == {0}
    assert topk.exact_top_k(table(spark, [])).count() == 0
    assert topk.exact_top_k(table(spark, [(0, [1.0], 0)])).count() == 0


def test_pivot_bounds_hold():
    x = np.floor(256 * made(2, 200).astype(float))
    pivots = topk.choose_pivots(x[:60])
    d = topk.distances(x, pivots)
    low = np.abs(d[:, None, :] - d[None, :, :]).max(2)
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (low <= true + 1e-6).all()


def test_elimination_evaluates_fewer(monkeypatch):
    x = np.floor(256 * made(3, 3000, spread=0.02).astype(float))
    ids, seen = np.arange(len(x)), []
    plain = topk.scores
    monkeypatch.setattr(topk, "scores", lambda q, rows: seen.append(len(rows)) or plain(q, rows))
    list(topk.answers(ids[:5], x[:5], ids, x, topk.choose_pivots(x[:500]), 5))
    assert sum(seen) < 0.6 * 5 * len(x)


def test_places_bound_distances_better_than_any_pivot():
    x = np.floor(256 * made(2, 200).astype(float))
    pivots = topk.choose_pivots(x[:60])
    d = topk.distances(x, pivots)
    at = topk.places(d, pivots)
    low = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (low <= true + 1).all() and (low >= np.abs(d[:, None, :] - d[None, :, :]).max(2) - 1).all()


def test_few_embeddings_are_evaluated(monkeypatch):
    t = pq.read_table(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").to_pandas()
    x = np.floor(256 * np.array(t["embedding"].tolist(), float))
    ids, seen, plain = t["vec_id"].to_numpy(), [], topk.scores
    monkeypatch.setattr(topk, "scores", lambda q, rows: seen.append(len(rows)) or plain(q, rows))
    asked = np.flatnonzero(ids % 50 == 0)
    list(topk.answers(ids[asked], x[asked], ids, x, topk.choose_pivots(x), 5))
    assert sum(seen) < 0.06 * len(asked) * len(x)


def test_query_over_embeddings_against_brute_force(spark):
    sf = SF.replace("0.001", "0.1")
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pandas().sort_values("vec_id")
    y, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    got, hit, n = ranked(queries.op10_ann(spark, sf).collect()), 0, 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = (y * y[np.flatnonzero(ids == q)[0]]).sum(1)
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert all(score == pytest.approx(s[np.flatnonzero(ids == i)[0]], abs=1e-12) for i, score in found)
        hit, n = hit + len({i for i, _ in found} & set(want)), n + 20
    assert hit / n >= 0.95


def test_anisotropic_codes_keep_the_parallel_part():
    x = ann.units(made(4, 1500, 32).astype(float))
    books = ann.fit(x)
    pairs = np.arange(16)
    back = lambda codes: books[pairs[None], codes].reshape(len(x), -1)
    along = lambda codes: np.abs(((x - back(codes)) * x).sum(1)).mean()
    assert along(ann.assign(x, books, ann.eta(32))) < along(ann.assign(x, books, 1.0))


def test_table_scan_equals_products_with_decoded_vectors():
    x = made(5, 300, 14).astype(float)
    books = ann.fit(x)
    codes = ann.assign(x, books, ann.eta(14))
    look, packed = ann.tables(x[:7], books), ann.packed(codes)
    scan = sum(look[j][:, packed[:, j]] for j in range(len(look)))
    assert np.allclose(scan, x[:7] @ books[np.arange(7)[None], codes].reshape(300, -1).T, atol=1e-3)


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "RERANK", 60)
    x = made(6, 2000, 32, spread=0.8)
    x[300:330] = x[300]
    got = ranked(ann.nearest(table(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])).collect())
    y, hit, n = x.astype(float), 0, 0
    for q in range(0, 2000, 20):
        s = (y * y[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:20]
        assert all(score == s[i] for i, score in got[q]) and len(got[q]) == 20
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        hit, n = hit + len({i for i, _ in got[q]} & set(want)), n + 20
    assert hit / n >= 0.9


def test_ann_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0, 0.5], 0), (0, [1.0, 2.0, 0.5], 0), (20, [0.0, 0.0], 0), (1, None, 0), (2, [nan, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0], 0), (6, [3.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0)]
    got = ranked(ann.nearest(table(spark, rows)).collect())
    assert got == {0: [(7, 5.0), (7, 5.0), (6, 3.0)]}
    assert ann.nearest(table(spark, [])).count() == 0

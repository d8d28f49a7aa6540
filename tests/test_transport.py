import itertools
import math
import random
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features as X, transport as W


def permuted(cost, supply, demand):
    """The least cost by all assignments of single units."""
    left, right = np.repeat(np.arange(len(supply)), supply), np.repeat(np.arange(len(demand)), demand)
    return min(sum(cost[i, right[p]] for i, p in zip(left, order)) for order in itertools.permutations(range(len(right))))


def test_transport_is_least_over_all_assignments():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        n, m = rnd.integers(1, 5, 2)
        units = int(rnd.integers(max(n, m), 7))
        supply, demand = 1 + rnd.multinomial(units - n, np.ones(n) / n), 1 + rnd.multinomial(units - m, np.ones(m) / m)
        cost = rnd.integers(0, 4, (n, m)).astype(float) if rnd.random() < 0.5 else rnd.random((n, m))
        least = permuted(cost, supply, demand)
        assert W.transport_cost(cost, supply, demand) == (pytest.approx(least, abs=1e-9), True)
        bound, solved = W.transport_cost(cost, supply, demand, least * 0.9 - 1e-9)
        assert bound <= least + 1e-9 and (solved or bound > least * 0.9 - 1e-9)


def test_large_transport_meets_its_dual():
    """No rearrangement of three moves is cheaper, and row by row bounds lie below."""
    rnd = np.random.default_rng(6)
    x, y = rnd.normal(size=(60, 4)), rnd.normal(size=(50, 4))
    supply, demand = rnd.integers(1, 9, 60) * 50, None
    demand = np.full(50, supply.sum() // 50)
    demand[0] += supply.sum() - demand.sum()
    cost = W.distances(x, y)
    got, _ = W.transport_cost(cost, supply, demand)
    assert got >= max((cost.min(1) * supply).sum(), (cost.min(0) * demand).sum()) - 1e-9
    unit = np.repeat(np.arange(60), supply // 50)
    assert got == pytest.approx(W.transport_cost(cost[unit], np.full(len(unit), 50), demand)[0], rel=1e-12)  # split supplies cost the same


def vectors_of(frames):
    """By plain loops."""
    met, total = {}, {}
    for w in frames:
        for a in range(len(w)):
            for b in range(max(0, a - 2), min(len(w), a + 3)):
                if w[a] is not None and w[b] is not None:
                    met[w[a], w[b]] = met.get((w[a], w[b]), 0) + 1
    for (a, _), n in met.items():
        total[a] = total.get(a, 0) + n
    whole, out = sum(total.values()), {}
    for (a, b), n in met.items():
        bits = int(hashlib.md5(b.encode()).hexdigest()[:8], 16)
        signs = np.array([1.0 if bits >> (31 - d) & 1 else -1.0 for d in range(32)])
        out[a] = out.get(a, 0) + max(0.0, math.log(n * whole / (total[a] * total[b]))) * signs
    return {t: v / (np.linalg.norm(v) or 1) for t, v in out.items()}


@pytest.fixture(scope="module")
def traces():
    rnd = random.Random(8)
    rows = [[rnd.choice("abcdefghijklmnop") * 2 for _ in range(rnd.choice([1, 1, 2, 3, 5, 8]))] for _ in range(40)]
    rows[7] = list(rows[6])
    rows[9] = rows[8] + ["aa"]
    rows[11] = ["aa"] * 30  # one frame over and over
    rows[12] = ["é🙂", "", "é🙂"]
    return rows


def test_frame_vectors_against_plain_loops(spark, traces):
    odd = [*traces, [None, "zz", None], [], None]
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(odd)], "id long, frames array<string>, term string")
    got = {bytes(r.frame): np.array(r.v) for r in W.frame_vectors(df).collect()}
    want = {hashlib.md5(t.encode()).digest(): v for t, v in vectors_of([w for w in odd if w]).items()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-12) for t in want)


@pytest.mark.parametrize("frames", [20, 1024])
def test_nearest_equals_brute_force(spark, traces, monkeypatch, frames):
    monkeypatch.setattr(W, "BLOCK_FRAMES", frames)
    df = spark.createDataFrame(list(enumerate(traces)), "id long, frames array<string>")
    rows = W.placed_bags(X.term_counts(df, F.col("frames")), W.frame_vectors(df))
    found, steps = W.nearest_traces(rows, 3)
    held = {r.id: (np.array(r.frames), np.array(r.counts), np.array(r.v).reshape(-1, 32)) for r in rows.collect()}
    solved = steps.agg(F.sum("solved")).first()[0]

    def plain(x, y):  # nothing cancelled, no bound
        return W.transport_cost(W.distances(x[2], y[2]), x[1] * y[1].sum(), y[1] * x[1].sum())[0] / (x[1].sum() * y[1].sum())

    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.d, r.nn))
    for q in held:
        best = sorted((round(plain(held[q], held[o]), 6), o) for o in held if o != q)[:3]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in best], abs=2e-6)
        assert all(round(plain(held[q], held[nn]), 6) == pytest.approx(d, abs=2e-6) for d, nn in got[q])
    assert got[6][0] == (0.0, 7) and 0 < solved < 40 * 39 // 2


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "id long, frames array<string>")
    rows = W.placed_bags(X.term_counts(df, F.col("frames")), W.frame_vectors(df))
    assert [(r.q, r.nn) for r in W.nearest_traces(rows, 5)[0].orderBy("q").collect()] == [(1, 2), (2, 1)]
    assert W.nearest_traces(rows.limit(0), 5)[0].count() == 0
    assert W.frame_vectors(df.limit(0)).count() == 0

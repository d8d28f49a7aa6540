"""Blocks of dense vectors against plain loops, with nulls, copies and zero vectors, in several blocks."""

import math

import numpy as np
import pytest

from tracewell.functions.hashing import band_grid
from tracewell.operators import dense

GRID = band_grid(64)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(9, 64))
    rows = [(i, [float(x) for x in base[i % 9] + rnd.normal(size=64) * rnd.choice([0, 0.3, 2])]) for i in range(40)]
    return rows + [(50, [0.0] * 64), (51, None), (52, [None, *[1.0] * 63]), (53, [float("nan"), *[1.0] * 63])]


def similarity(x, y):
    """(1 + cosine) / 2 to nine places, None for null."""
    if x is None or y is None or None in x or None in y:
        return None
    if any(map(math.isnan, x + y)):
        return math.nan
    if not any(x) or not any(y):
        return None
    return round((1 + sum(a * b for a, b in zip(x, y)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))) / 2, 9)


def order(p):
    """Largest first, NaN before all and null after all; ties to the smaller id."""
    nn, s = p
    return (2, nn) if s is None else (0, -math.inf, nn) if math.isnan(s) else (0, -s, nn)


def signs(x):
    return [1 if a is not None and (a > 0 or math.isnan(a)) else -1 for a in x]


def shares(x, y, n, k):
    return x is not None and y is not None and any(signs(x)[b * k : b * k + k] == signs(y)[b * k : b * k + k] for b in range(n))


@pytest.fixture(scope="module")
def plain(vectors):
    return {q: [(nn, similarity(x, y), [shares(x, y, n, k) for n, k in GRID]) for nn, y in vectors if nn != q] for q, x in vectors}


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 4)
    monkeypatch.setattr(dense, "STRIP", 5)


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "id long, v array<double>")


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9)


def test_nearest(spark, vectors, plain):
    got = {}
    for r in dense.nearest(frame(spark, vectors), 5).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.nn, r.s))
    for q, others in plain.items():
        want = sorted(((nn, s) for nn, s, _ in others), key=order)[:5]
        assert [nn for nn, _ in got[q]] == [nn for nn, _ in want] and all(same(a, b) for (_, a), (_, b) in zip(got[q], want))


def test_counts_and_ranks(spark, vectors, plain):
    counts = {(r.q, r.g): r for r in dense.counts(frame(spark, vectors), GRID).collect()}
    means = {(r.q, r.g): r.value for r in dense.mean_ranks(frame(spark, vectors), GRID).collect()}
    assert len(counts) == len(means) == len(vectors) * len(GRID)
    for q, others in plain.items():
        ranked = sorted(((nn, s) for nn, s, _ in others), key=order)
        rank = {nn: 1 + next(i for i, (_, t) in enumerate(ranked) if same(s, t)) for nn, s in ranked}
        for g, (n, k) in enumerate(GRID):
            p = lambda s: s is not None and (math.isnan(s) or 1 - (1 - s**k) ** n >= 0.5)
            found = sorted(((nn, s) for nn, s, met in others if met[g]), key=order)
            known = [s for _, s in found if s is not None]
            r = counts[q, g]
            assert (r.many, r.got, r.there) == (len(found), sum(p(s) for _, s in found), sum(p(s) for _, s, _ in others))
            assert same(r.low, min(known, key=lambda s: (math.isnan(s), s)) if known else None)
            want = [1.0 if i > rank[nn] else (i + 1) / (rank[nn] + 1) for i, (nn, _) in enumerate(found, 1)]
            assert same(means[q, g], sum(want) / len(want) if want else None)


def test_best_candidates(spark, vectors, plain):
    got = {}
    for r in dense.found_nearest(frame(spark, vectors), GRID, 3).orderBy("i").collect():
        got.setdefault((r.q, r.g), []).append((r.i, r.nn, r.many))
    for q, others in plain.items():
        for g in range(len(GRID)):
            found = sorted(((nn, s) for nn, s, met in others if met[g]), key=order)
            assert got.get((q, g), []) == [(i, nn, len(found)) for i, (nn, _) in enumerate(found[:3], 1)]


def test_nearest_in_buckets(spark, vectors, plain):
    """Buckets of copies are larger than a block here, and most pairs share several bands."""
    got = {}
    for r in dense.nearest_in_buckets(frame(spark, vectors), 8, 8, 6).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.nn, r.s))
    for q, others in plain.items():
        want = sorted(((nn, s) for nn, s, met in others if met[3]), key=order)[:6]
        assert [nn for nn, _ in got.get(q, [])] == [nn for nn, _ in want] and all(same(a, b) for (_, a), (_, b) in zip(got.get(q, []), want))


def test_pairs(spark, vectors):
    ids = [i for i, _ in vectors]
    agree = {(r.i, r.j): r.agree for r in dense.agreeing(frame(spark, vectors), 8).collect()}
    soft = {(r.i, r.j): r.soft for r in dense.soft_agreeing(frame(spark, vectors), 8).collect()}
    by = dict(vectors)
    assert agree.keys() == soft.keys() == {(i, j) for i in ids for j in ids if i < j}
    for (i, j), value in agree.items():
        x, y = by[i], by[j]
        assert value == (0 if x is None or y is None else sum(signs(x)[s * 8 : s * 8 + 8] == signs(y)[s * 8 : s * 8 + 8] for s in range(8)) / 8)
        whole = x is not None and y is not None and None not in x and None not in y
        if not whole:
            assert soft[i, j] is None
        elif not (math.isnan(x[0]) or math.isnan(y[0])):
            assert soft[i, j] == pytest.approx(1 - sum(max(abs(a - b) for a, b in zip(x[s * 8 : s * 8 + 8], y[s * 8 : s * 8 + 8])) for s in range(8)) / 16)


def test_an_empty_table(spark, vectors):
    none = frame(spark, vectors).where("false")
    assert dense.nearest(none, 5).count() == dense.counts(none, GRID).count() == dense.agreeing(none, 8).count() == dense.mean_ranks(none, GRID).count() == 0


def test_ranks_shuffle_vectors_and_no_similarities(spark, vectors, plain, monkeypatch):
    """Queries a few at a time, and one exchange, of vectors."""
    monkeypatch.setattr(dense, "HELD", 100)
    means = dense.mean_ranks(frame(spark, vectors), GRID)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "binary" not in means._jdf.queryExecution().analyzed().toString() and "FlatMapGroupsInArrow" not in plan
    got = {(r.q, r.g): r.value for r in means.collect()}
    for q, others in plain.items():
        ranked = sorted(((nn, s) for nn, s, _ in others), key=order)
        rank = {nn: 1 + next(i for i, (_, t) in enumerate(ranked) if same(s, t)) for nn, s in ranked}
        for g in range(len(GRID)):
            found = sorted(((nn, s) for nn, s, met in others if met[g]), key=order)
            want = [1.0 if i > rank[nn] else (i + 1) / (rank[nn] + 1) for i, (nn, _) in enumerate(found, 1)]
            assert same(got[q, g], sum(want) / len(want) if want else None)


def test_counts_take_every_two_blocks_once(spark, vectors, monkeypatch):
    """A pair counts for both of its rows where it is worked out; a row leaves a group once, with all settings."""
    calls, plain_in_blocks = [], dense.in_blocks
    monkeypatch.setattr(dense, "in_blocks", lambda *x, **y: calls.append(plain_in_blocks(*x, **y)) or calls[-1])
    full = {(r.q, r.g): r for r in dense.counts(frame(spark, vectors), GRID).collect()}
    for r in dense.counts(frame(spark, vectors), GRID, least_similar=False).collect():
        want = full[r.q, r.g]
        assert r.low is None and (r.many, r.got, r.there) == (want.many, want.got, want.there)
    blocks = -(-len(vectors) // max(-(-dense.BLOCK // dense.LARGER), -(-len(vectors) // dense.MANY)))
    assert calls[0].count() <= len(vectors) * (blocks + 1)


def test_met_counts_pairs_in_their_tasks(spark, vectors, plain):
    """Cells of equal signs and first settings, of a chosen part of the pairs."""
    want, by = {}, dict(vectors)
    for i, others in plain.items():
        for j, s, met in others:
            if i < j and (i + j) % 3 and s is not None:
                cell = sum(x == y for x, y in zip(signs(by[i]), signs(by[j]))), met.index(True) if any(met) else len(GRID)
                want[cell] = want.get(cell, 0) + 1
    got = dense.met(frame(spark, vectors), GRID, lambda i, j: (i + j) % 3 != 0)
    assert {(r.same, r.level): r.n for r in got.collect()} == want


@pytest.mark.parametrize("width", [64, 70, 20])
def test_pairs_of_other_widths_are_rounded_where_they_are_made(spark, width):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=width)]) for i in range(13)]
    by, n = dict(rows), width // 7
    agree = {(r.i, r.j): r.agree for r in dense.agreeing(frame(spark, rows), 7).collect()}
    soft = {(r.i, r.j): r.soft for r in dense.soft_agreeing(frame(spark, rows), 7).collect()}
    assert len(agree) == len(soft) == 78
    for (i, j), value in agree.items():
        x, y = by[i], by[j]
        assert value == round(sum(signs(x)[s * 7 : s * 7 + 7] == signs(y)[s * 7 : s * 7 + 7] for s in range(n)) / n, 9)
        assert soft[i, j] == round(1 - sum(max(abs(a - b) for a, b in zip(x[s * 7 : s * 7 + 7], y[s * 7 : s * 7 + 7])) for s in range(n)) / (2 * n), 9)


@pytest.mark.parametrize("top", [1, 6])
def test_best_candidates_among_the_nearest_and_beyond(spark, vectors, plain, monkeypatch, top):
    """Blocks of many rows, where the rows a setting finds are among the most similar ones or not."""
    monkeypatch.setattr(dense, "TOP", top)
    monkeypatch.setattr(dense, "BLOCK", 64)
    got = {}
    for r in dense.found_nearest(frame(spark, vectors), GRID, 2).orderBy("i").collect():
        got.setdefault((r.q, r.g), []).append((r.i, r.nn, r.many))
    for q, others in plain.items():
        for g in range(len(GRID)):
            found = sorted(((nn, s) for nn, s, met in others if met[g]), key=order)
            assert got.get((q, g), []) == [(i, nn, len(found)) for i, (nn, _) in enumerate(found[:2], 1)]

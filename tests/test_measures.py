import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import features as X, measures as M, pairs as P, stats

X4, Y4, Z5 = list("abcd"), list("bcxd"), list("bcxde")
TOTAL = {"a": 1, "b": 2, "c": 2, "d": 2, "x": 1, "e": 1}


def value(spark, sql, x, y, prepare=None):
    g = lambda f: 1 + math.log(4 / TOTAL.get(f, 1))
    p = lambda f: TOTAL.get(f, 0) / 4
    row = (x, y, [g(f) for f in x], [g(f) for f in y], [p(f) for f in x], [p(f) for f in y])
    df = spark.createDataFrame([row], "x array<string>, y array<string>, gx array<double>, gy array<double>, px array<double>, py array<double>")
    for name, part in (prepare or {}).items():
        df = df.withColumn(name, F.expr(part))
    return df.select(F.expr(sql).alias("v")).first().v


# Worked out by hand or by plain Python loops from the definitions.
@pytest.mark.parametrize("sql,values", [
    (M.levenshtein_sql(), (0.5, 0.5)), (M.pdm_sql(), (0.596024513190895,) * 4), (M.nw_sql(), (0.25, 0.25, 0.0, 0.0)),
    (M.brodie_sql(), (0.3360544415469306, 0.4371428848323695, 0.3360544415469306, 0.43875152573021775)),
    (M.lerch_sql(), (0.6016409212498197, 0.6016409212498195, 0.6016409212498197, 0.43024780286587877)), (M.prefix_sql(), (0.0, 0.0))])
def test_alignments(spark, sql, values):
    for (x, y), want in zip(((X4, Y4), (Y4, X4), (X4, Z5), (Z5, X4)), values):
        assert value(spark, sql, x, y) == pytest.approx(want, abs=1e-9)


def test_moroo_and_tracesim(spark):
    both = {"lerch": M.lerch_sql(), "pdm": M.pdm_sql()}
    for (x, y), want in zip(((X4, Y4), (Z5, X4)), (0.5988195482507197, 0.49974696431429666)):
        assert value(spark, M.moroo_sql(), x, y, both) == pytest.approx(want, abs=1e-9)
    weights = {f"w{s}": M.stack_weights_sql(f"g{s}", 0.5, 0.5, 0.0) for s in "xy"}
    for (x, y), want in zip(((X4, Y4), (X4, Z5), (Z5, X4)), (0.6977101271028437, 0.6426327434709582, 0.6426327434709582)):
        assert value(spark, M.tracesim_sql(), x, y, weights) == pytest.approx(want, abs=1e-9)


def test_identity(spark):
    assert value(spark, M.pdm_sql(), X4, X4) == 1
    assert value(spark, M.levenshtein_sql(), X4, X4) == 1
    assert value(spark, M.prefix_sql(), X4, X4) == 0
    assert value(spark, M.prefix_sql(), X4, [*X4[:2], "q"]) == pytest.approx(0.5)


def test_levenshtein_against_a_loop(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(4)
    for _ in range(8):
        x, y = (rnd.choices("abc", k=rnd.randint(1, 9)) for _ in "xy")
        assert value(spark, M.levenshtein_sql(), x, y) == pytest.approx(1 - edits(x, y) / max(len(x), len(y)))


def test_jaccard_of_sets(spark):
    items = spark.createDataFrame([(0, f) for f in "abcda"] + [(1, f) for f in "bcxd"], "id long, item string")
    got = {(r.i, r.j): r.sim for r in M.jaccard(items, 4).collect()}
    assert got[0, 1] == pytest.approx(0.6) and got[0, 2] == 0 and got[2, 3] is None and len(got) == 6


def test_cosine_of_zero_vector_is_null(spark):
    w = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1)], "id long, term string, w long")
    got = {(r.i, r.j): r.sim for r in M.cosine(w, 3).collect()}
    assert got[0, 1] == pytest.approx(2 / math.sqrt(5)) and got[0, 2] is None


def test_aligned_fills_pairs_without_shared_frames(spark):
    f = spark.createDataFrame([(0, X4), (1, Y4), (2, ["q"])], "id long, frames array<string>")
    got = {(r.i, r.j): r.sim for r in M.aligned(f, M.nw_sql(), 3, "-1D").collect()}
    assert got == {(0, 1): 0.25, (0, 2): -1.0, (1, 2): -1.0}


def test_upper_triangle_has_each_pair_once(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(23)], "id long, v long")
    got = P.upper_triangle(rows, 4).collect()
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    assert all(r.v_i == 2 * r.i and r.v_j == 2 * r.j for r in got)


def test_catalog_breaks_ties_by_text(spark):
    docs = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), ("c\r",)], "text string")
    assert [(r.id, r.text) for r in X.catalog(docs, 2).orderBy("id").collect()] == [(0, "c"), (1, "a")]


def test_dictionary_and_ranks(spark):
    f = spark.createDataFrame([(0, ["b", "a"]), (1, ["c", "a", "a"])], "id long, frames array<string>")
    d = X.frame_dictionary(f.select("frames"))
    assert {r.frame: r["rank"] for r in d.collect()} == {"a": 1, "b": 2, "c": 3}
    new = spark.createDataFrame([(7, ["c", "z", "a"])], "id long, frames array<string>")
    assert X.ranked_frames(new, d).first().ranks == [3, 0, 1]


def test_kendall_against_pairs():
    import numpy as np

    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 5, 60), rnd.integers(0, 5, 60)
    con = dis = tx = ty = 0
    for i in range(60):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            con, dis, tx, ty = con + (a * b > 0), dis + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n = 60 * 59 // 2
    assert stats.tau_b(x, y) == pytest.approx((con - dis) / math.sqrt((n - tx) * (n - ty)))
    assert stats.tau_b(x, np.zeros(60)) is None


def test_histogram_closes_the_last_bin(spark):
    v = spark.createDataFrame([(float(i),) for i in (0, 1, 2, 3, 4)], "v double")
    assert [r.n for r in stats.histogram(v, "v", 2).orderBy("bin").collect()] == [2, 3]
    assert stats.histogram(v.where("v > 9"), "v", 2).count() == 0

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewell.operators import learned, stats, trace_hash as L
from tracewell.plans import catalog, learned_traces as P
from tracewell.sources import io


def explicit(tower, x):
    """A convolution over one-hot frames, filter by filter and window by window."""
    tops = []
    for k, t in zip(tower.kernels, tower.tables):
        for f in range(tower.filters):
            tops.append([max(sum(float(np.eye(t.shape[1])[row[p + j]] @ t[j, :, f]) for j in range(k)) for p in range(len(row) - k + 1)) for row in x])
    return tower.dense.output(np.maximum(np.array(tops).reshape(-1, len(x)).T, 0))


def test_convolution_equals_explicit_one_hot(spark, tmp_path):
    rnd = np.random.default_rng(1)
    tower = learned.Conv(9, 5, [12])
    x = rnd.integers(0, 10, (6, 11))
    assert np.allclose(tower.output(x), explicit(tower, x))
    io.save_model(spark, learned.state(tower), str(tmp_path / "cnn"))
    again = learned.restored(io.load_model(spark, str(tmp_path / "cnn")))
    assert np.array_equal(again.output(x), tower.output(x))


def test_sparse_rows_hash_as_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 3)
    rnd = np.random.default_rng(2)
    x = rnd.random((10, 6)) * (rnd.random((10, 6)) < 0.4)
    x[4] = 0
    cells = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(0, "unknown", 9.0)]
    places = spark.createDataFrame([(f"t{j}", j) for j in range(6)], "term string, place int")
    rows = L.sparse_rows(spark.range(10), spark.createDataFrame(cells, "id long, term string, w double"), places)
    tower = learned.Dense([6, 5, 8])
    got = {r.id: r.h for r in L.sparse_hashed(rows, tower, 6).collect()}
    assert np.allclose([got[i] for i in range(10)], tower.output(x))
    assert L.sparse_hashed(rows.where("false"), tower, 6).count() == 0


def test_vocabulary_is_bounded_and_ordered(spark):
    counts = spark.createDataFrame([(1, "b", 5), (2, "b", 1), (1, "a", 1), (2, "a", 1), (3, "c", 9), (3, "d", 1)], "id long, term string, n long")
    assert [(r.term, r.place) for r in L.vocabulary(counts, 3).orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert {r.term for r in L.vocabulary(counts, 9, least=2).collect()} == {"a", "b"}


def test_frame_numbers(spark):
    docs = spark.createDataFrame([(1, ["x", "y", "?", "x", "x"]), (2, []), (3, None), (4, ["y"])], "id long, frames array<string>")
    words = spark.createDataFrame([("x", 1), ("y", 2)], "frame string, rank int")
    assert {r.id: r.seq for r in L.frame_numbers(docs, words, 4).collect()} == {1: [1, 2, 0, 1], 2: [0] * 4, 3: [0] * 4, 4: [2, 0, 0, 0]}


def test_strata(spark):
    sims = [(i, i + 1, s) for i, s in enumerate([0.0, 0.01, 0.05, 0.09, 0.31, 0.95, 1.0, None])]
    got = sorted(r.sim for r in L.strata(spark.createDataFrame(sims, "i long, j long, sim double"), 2).collect())
    assert len(got) == 5 and got[2:] == [0.31, 0.95, 1.0]


def test_both_objectives_fall_and_codes_cover_the_table(spark):
    model = P._Bags(spark, SF)
    towers = model.towers()
    assert set(towers) == {"deep", "baseline", "untrained"} and all(v[-1] < v[0] for v in model.losses.values())
    rows, ids = model.rows()
    codes = {r.id: r.h for r in model.codes(towers["deep"], model.cat).collect()}
    assert sorted(codes) == sorted(ids) and np.allclose([codes[i] for i in ids], towers["deep"].output(rows))
    guess = L.predicted(model.pairs.limit(50), model.codes(towers["deep"], model.cat), P.WIDE).collect()
    sign = {i: np.array(codes[i]) > 0 for i in ids}
    assert all(r.guess == pytest.approx((sign[r.i] == sign[r.j]).reshape(-1, P.WIDE).all(1).mean()) for r in guess)


def test_tower_of_an_empty_table_and_of_odd_vectors(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(path)
    assert catalog.learned_hash(spark, str(tmp_path)).count() == 0
    odd = [(1, None), (2, [0.0] * 64), (3, [1.0, None] * 32), (4, [1.0] * 64), (5, [-1.0] * 64)]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(path)
    assert catalog.learned_hash(spark, str(tmp_path)).count() == 5


def plain_tau(x, y):
    top = ux = uy = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            top, ux, uy = top + a * b, ux + (a != 0), uy + (b != 0)
    return top / math.sqrt(ux * uy) if ux and uy else None


def test_kendall_over_partitions_equals_pairs(spark):
    rnd = np.random.default_rng(3)
    groups = {}
    for k, n in enumerate((220, 90, 1, 60)):
        x = np.round(rnd.normal(size=n), 1)
        groups[k] = x, np.round(x * (k - 1) + rnd.normal(size=n), 1)
    groups[0][1][:120] = 0  # a frequent value of y, and one of x
    groups[1][0][:50] = 0.5
    groups[3][1][:] = 2.0
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y)], "k int, x double, y double")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = {r.k: r for r in stats.kendall(rows).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    for k, (x, y) in groups.items():
        want = plain_tau(x, y)
        assert got[k].n == len(x) and (got[k].tau is None) == (want is None) and (want is None or got[k].tau == pytest.approx(want, abs=1e-12))
    assert stats.kendall(rows.where("false")).count() == 0


def test_weighted_inversions():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 37):
        v, w = rnd.integers(0, 9, n).astype(float), rnd.integers(1, 5, n)
        assert stats._weighted_inversions(v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])


def test_each_part_of_kendall_is_a_bounded_group(spark):
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 7919 % 4001).cast("double").alias("y"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        parts = rows.groupBy("k", "x", "y").count().repartitionByRange("k", "x", "y").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2000

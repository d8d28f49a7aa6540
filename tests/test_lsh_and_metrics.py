import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import learned, lsh, metrics as Q, stats
from tracewell.plans import catalog
from tracewell.sources import io


def test_simhash_forms(spark):
    w = spark.createDataFrame([(0, "foo", 2.0), (0, "bar", 1.0), (1, "foo", 3.0), (1, "bar", 1.0), (1, "baz", 1.0)], "id long, term string, w double")
    code = lambda df: {r.id: int("".join(map(str, r.code)), 2) for r in df.collect()}
    assert code(lsh.simhash(w)) == {0: 0xDCB27518FED9D577, 1: 0xDCBB7519FFF9D577}
    assert code(lsh.simhash(w, symmetric=True)) == {0: 0xDCB27518FED9D577, 1: 0xDCB27518FED9D577}


def test_slot_agreement_equals_slot_combinations(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2, 64)
    codes = [[int(b) for b in np.where(rnd.random(64) < 0.08, 1 - base, base)] for _ in range(14)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id long, code array<int>")
    found = {(r.q, r.nn) for r in lsh.slot_candidates(df).where(F.col("g") == 8 - 3).collect()}
    want = {(i, j) for i in range(14) for j in range(14) if i != j for c in itertools.combinations(range(8), 3) if all(codes[i][8 * s : 8 * s + 8] == codes[j][8 * s : 8 * s + 8] for s in c)}
    assert found == want


def test_band_candidates_and_lookup(spark):
    h = spark.createDataFrame([(0, [1, 1, -1, -1]), (1, [1, 1, 1, 1]), (2, [-1, -1, 1, -1]), (3, [1, -1, 1, -1])], "id long, h array<int>")
    banded = lsh.bands(h, 2, 2)
    assert {(r.q, r.nn) for r in lsh.candidates(banded).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)}
    hit = {(r.q, r.band): r.ids for r in lsh.lookup(lsh.bands(h.where("id = 0").withColumn("id", F.lit(9)), 2, 2), banded).collect()}
    assert hit == {(9, 0): [0, 1], (9, 1): [0]}
    assert [r.id for r in lsh.without_candidates(h, lsh.candidates(lsh.bands(h, 1, 4))).orderBy("id").collect()] == [0, 1, 2, 3]


def test_hamming_forms(spark):
    df = spark.createDataFrame([([1, 1, -1, -1], [1, 1, -1, 1])], "a array<int>, b array<int>")
    r = df.select(lsh.segment_hamming(F.col("a"), F.col("b"), 2).alias("h"), lsh.soft_hamming(F.col("a"), F.col("b"), 2).alias("s")).first()
    assert (r.h, r.s) == (0.5, 0.5)


def test_metrics_by_hand(spark):
    real = spark.createDataFrame([(0, n, s) for n, s in enumerate((0.9, 0.8, 0.8, 0.5, 0.2), 1)], "q long, nn long, s double")
    grid = spark.createDataFrame([(0, 8, 8)], "g int, bands int, width int")
    asked = spark.createDataFrame([(0,), (9,)], "q long")
    found = spark.createDataFrame([(0, 8, 8, 0, n, s) for n, s in ((1, 0.9), (2, 0.8), (5, 0.2))], "g int, bands int, width int, q long, nn long, s double")
    got = lambda df: {r.q: r.value for r in df.collect()}
    assert got(Q.reciprocal_ranks(found, real, grid, asked)) == {0: pytest.approx(0.8888888889), 9: None}
    p, r = Q.precision(found, grid, asked), Q.recall(found, real, grid, asked)
    assert got(p) == {0: pytest.approx(2 / 3), 9: None}
    assert got(r) == {0: pytest.approx(2 / 3), 9: None}
    assert got(Q.f_score(p, r)) == {0: pytest.approx(2 / 3), 9: None}
    assert got(Q.smallest_probability(found, grid, asked))[0] == pytest.approx(1 - (1 - 0.2**8) ** 8)
    one = Q.recall_at_k(found, real, grid, 3).first()
    assert (one.queries, one.recall) == (1, pytest.approx(2 / 3))
    assert Q.cascaded_recall_at_k(found, real, asked, 3).first().recall == pytest.approx(1 / 3)


def test_f_score_with_nulls(spark):
    rows = lambda v: spark.createDataFrame([(8, 8, q, x) for q, x in enumerate(v)], "bands int, width int, q long, value double")
    got = {r.q: r.value for r in Q.f_score(rows([0.0, None, None]), rows([None, 0.0, 0.5])).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: None}


def test_minhash_of_equal_sets_is_equal(spark):
    ranked = spark.createDataFrame([(0, 3), (0, 9), (1, 9), (1, 3), (2, 4)], "id long, rank long")
    got = {r.id: r.sig for r in lsh.minhash(ranked, 16).collect()}
    assert got[0] == got[1] != got[2]
    perms = lsh.permutations(16)
    assert got[0] == [min((a * x + b) % lsh.MINHASH_PRIME for x in (3, 9)) for a, b in perms]
    bits = lsh.minhash_bits(lsh.minhash(ranked, 16)).where("id = 0").first().h
    assert [int("".join(map(str, bits[16 * i : 16 * i + 16])), 2) for i in range(16)] == [v % 65536 for v in got[0]]


def test_towers_learn_and_travel(spark, tmp_path):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 12))
    y = np.where(rnd.random((300, 1)) < 0.5, x + 0.05 * rnd.normal(size=x.shape), rnd.normal(size=x.shape))
    want = np.clip((x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1), 0, 1)
    for objective in (learned.hash_objective, learned.baseline_objective):
        tower = learned.Dense([12, 24, 32], sigmoid=objective is learned.baseline_objective)
        losses = learned.train(tower, x, y, want, 8, objective, epochs=12, batch=64, rate=0.01)
        assert losses[-1] < losses[0]
    io.save_model(spark, learned.state(tower), str(tmp_path / "model"))
    again = learned.restored(io.load_model(spark, str(tmp_path / "model")))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(5)], "id long, v array<double>")
    got = {r.id: r.h for r in learned.hashed(rows, again, "v").collect()}
    assert np.allclose([got[i] for i in range(5)], tower.output(x[:5]))


def test_hash_objective_gradient():
    rnd = np.random.default_rng(1)
    x, y, want = np.tanh(rnd.normal(size=(4, 8))), np.tanh(rnd.normal(size=(4, 8))), rnd.random(4)
    for objective in (learned.hash_objective, learned.baseline_objective):
        _, gx, gy = objective(x, y, want, 4)
        for i, j in ((0, 1), (3, 6)):
            d = np.zeros_like(x)
            d[i, j] = 1e-6
            assert (objective(x + d, y, want, 4)[0] - objective(x - d, y, want, 4)[0]) / 2e-6 == pytest.approx(gx[i, j], abs=1e-5)
            assert (objective(x, y + d, want, 4)[0] - objective(x, y - d, want, 4)[0]) / 2e-6 == pytest.approx(gy[i, j], abs=1e-5)


def test_conv_tower_learns():
    rnd = np.random.default_rng(5)
    x = rnd.integers(1, 12, (200, 9))
    y = np.where(rnd.random((200, 1)) < 0.5, x, rnd.integers(1, 12, (200, 9)))
    want = (x == y).mean(1)
    tower = learned.Conv(12, 8, [16])
    losses = learned.train(tower, x, y, want, 4, epochs=15, batch=50, rate=0.01)
    assert losses[-1] < losses[0] and tower.output(x).shape == (200, 16)


def test_csv_keeps_newlines_and_quotes(spark, tmp_path):
    rows = [(1, 'a\n"b", c'), (2, ""), (3, " x "), (4, None)]
    io.write_csv(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "t"))
    assert sorted((r.id, r.text) for r in io.read_csv(spark, str(tmp_path / "t"), "id long, text string").collect()) == rows


def test_permutations_keep_ranks_beyond_sixteen_bits_apart(spark):
    ranked = spark.createDataFrame([(0, 5), (1, 5 + 65521), (2, 5 + 2 * 65521)], "id long, rank long")
    sigs = [tuple(r.sig) for r in lsh.minhash(ranked, 16).collect()]
    assert all(len({s[k] for s in sigs}) == 3 for k in range(16))


def test_average_ranks_over_range_partitions(spark):
    rnd = np.random.default_rng(3)
    v = [float(x) for x in rnd.integers(0, 300, 3000)]
    got = {r.v: r.rank_v for r in stats.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()}
    assert got == pd.Series(v).rank().groupby(np.array(v)).first().to_dict()


def test_slot_lookup_against_a_loop(spark):
    rnd = np.random.default_rng(4)
    code = lambda n: [[int(x) for x in np.repeat(rnd.integers(0, 2, 8), 8)] for _ in range(n)]
    asked, held = code(6), code(9)
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, code array<int>")
    got = {(r.q, r.nn): r.agree for r in lsh.slot_lookup(frame(asked), frame(held), 5).collect()}
    same = {(q, n): sum(a[8 * s : 8 * s + 8] == b[8 * s : 8 * s + 8] for s in range(8)) for q, a in enumerate(asked) for n, b in enumerate(held)}
    assert got == {k: n for k, n in same.items() if n >= 5}


def test_candidates_are_told_apart_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(lsh, "HOT", 8)
    rnd = np.random.default_rng(5)
    rows = [(k, [int(x) for x in rnd.choice([-1, 1], 8)]) for k in range(60)]
    rows += [(60, None), (61, [1] * 5), (62, [1] * 5), (63, []), (64, [1] * 9), (3, [1] * 8), (4, [-1] * 8), (4, [-1] * 8)]  # odd lengths, repeated ids
    for some in (rows[:60], rows):
        h = spark.createDataFrame(some, "id long, h array<int>")
        got = [tuple(r) for r in lsh.code_candidates(h, 4, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in lsh.candidates(lsh.bands(h, 4, 2)).collect()}
    plan = lsh.code_candidates(spark.createDataFrame(rows[:60], "id long, h array<int>"), 4, 2)._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(q#\w+, nn#", plan)  # no pair is shuffled


def test_lookup_lists_a_bucket_once(spark):
    index = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "b"), (4, 1, "a"), (5, 0, None)], "id long, band int, key string")
    asked = spark.createDataFrame([(7, 0, "a"), (8, 0, "a"), (8, 0, "b"), (9, 0, None), (10, 1, "b"), (11, 0, "b"), (11, 0, "b")], "id long, band int, key string")
    got = sorted((r.q, r.band, r.ids) for r in lsh.lookup(asked, index).collect())
    assert got == [(7, 0, [1, 2]), (8, 0, [1, 2, 3]), (11, 0, [3, 3])]
    plan = lsh.lookup(asked.where("id = 7"), index)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # lists are made below the join


def test_minhash_gathers_ranks_only(spark):
    sets = {1: [3, 7, 7, 40_000], 2: [5], 3: list(range(1, 300))}
    ranked = spark.createDataFrame([(i, r) for i, x in sets.items() for r in x] + [(4, None)], "id long, rank long")
    found = lsh.minhash(ranked, 8)
    want = {i: [min((a * r + b) % lsh.MINHASH_PRIME for r in x) for a, b in lsh.permutations(8)] for i, x in sets.items()}
    assert {r.id: r.sig for r in found.collect()} == want
    assert "min(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row of 64 minima is shuffled


def test_simhash_of_rows_in_a_vocabulary(spark):
    rows = spark.createDataFrame([(1, [("a", 2), ("b", 1), ("x", 5)]), (2, [("x", 1)]), (3, [])], "id long, counts array<struct<term: string, n: long>>")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "term string")
    want = lsh.simhash(spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "id long, term string, w double")).first()
    assert lsh.simhash_rows(rows, vocabulary).collect() == [want]


def test_smallest_rows_are_cut_by_ids_alone(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in (5, 3, 9, 3, 1, 7, 7, 7)], "id long, text string")
    for most, want in ((0, []), (2, [1, 3]), (3, [1, 3, 3]), (6, [1, 3, 3, 5, 7, 7]), (20, [1, 3, 3, 5, 7, 7, 7, 9])):
        assert sorted(r.id for r in catalog._smallest(rows, most).collect()) == want
    assert catalog._smallest(rows.where("false"), 5).count() == 0
    assert "GlobalLimit" not in catalog._smallest(rows, 3)._jdf.queryExecution().optimizedPlan().toString()  # no task gathers texts

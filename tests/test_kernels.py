import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features as X, kernels as K, measures as M

WEIGHTS = {f"w{s}": M.stack_weights_sql(f"known{s}", 0.5, 0.5, 0.0) for s in "xy"}
#: Each measure by a kernel and by nested aggregates.
FORMS = {
    "levenshtein": (dict(kernel=K.levenshtein), dict(value_sql=M.levenshtein_sql())),
    "pdm": (dict(kernel=K.pdm), dict(value_sql=M.pdm_sql())),
    "nw": (dict(kernel=K.needleman_wunsch), dict(value_sql=M.nw_sql())),
    "brodie": (dict(kernel=K.brodie, arrays=("p",)), dict(value_sql=M.brodie_sql())),
    "moroo": (dict(kernel=K.pdm, swapped=True, prepare={"lerch": M.lerch_sql()}, value_sql=M.moroo_sql(pdm="value")), dict(value_sql=M.moroo_sql(), swapped=True, prepare={"lerch": M.lerch_sql(), "pdm": M.pdm_sql()})),
    "tracesim": (dict(kernel=K.tracesim, swapped=True, arrays=("w",), prepare=WEIGHTS), dict(value_sql=M.tracesim_sql(), swapped=True, prepare=WEIGHTS)),
}


@pytest.fixture(scope="module")
def weighted(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choices("abcdefg", k=rnd.choice([1, 1, 2, 5, 9, 14]))) for i in range(24)]
    rows[5] = (5, rows[4][1])  # equal traces
    frames = spark.createDataFrame(rows, "id long, frames array<string>")
    return M.with_statistics(frames, X.frame_statistics(X.term_counts(frames, F.col("frames")), 24), 24).cache()


@pytest.mark.parametrize("cells", [8, 1 << 17])
@pytest.mark.parametrize("name", list(FORMS))
def test_kernels_equal_nested_aggregates(spark, weighted, monkeypatch, name, cells):
    monkeypatch.setattr(K, "CELLS", cells)
    mine, plain = FORMS[name]
    got = {(r.i, r.j): r.sim for r in M.aligned_by(weighted, n=24, default="0D", **mine).collect()}
    want = {(r.i, r.j): r.sim for r in M.aligned(weighted, n=24, default="0D", **plain).collect()}
    assert len(got) == 24 * 23 // 2 and got.keys() == want.keys()
    assert all((got[p] is None) == (want[p] is None) and (want[p] is None or got[p] == pytest.approx(want[p], abs=1e-12)) for p in want)


def side(frames, filler, **more):
    return K.Side(pa.array(frames, pa.list_(pa.int64())), {k: pa.array(v, pa.list_(pa.float64())) for k, v in more.items()}, filler)


def test_empty_sides():
    x, y = side([[], [1, 2], []], -1, w=[[], [0.5, 0.25], []]), side([[3], [], []], -2, w=[[1.0], [], []])
    assert K.tracesim(x, y).tolist() == [1.0, 1.0, 0.0]
    with np.errstate(invalid="ignore"):
        assert K.levenshtein(x, y)[:2].tolist() == [0.0, 0.0]


def test_long_traces_against_loops():
    rnd = np.random.default_rng(8)
    a, b = rnd.integers(0, 20, 300).tolist(), rnd.integers(0, 20, 260).tolist()
    row = list(range(len(b) + 1))
    for i, f in enumerate(a, 1):
        last, row = row, [i]
        for j, g in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (f != g)))
    assert K.levenshtein(side([a, b], -1), side([b, a], -2)).tolist() == pytest.approx([1 - row[-1] / 300] * 2)


def test_no_pairs(spark):
    frames = spark.createDataFrame([(0, ["a"]), (1, ["b"])], "id long, frames array<string>")
    assert [tuple(r) for r in M.aligned_by(frames, K.levenshtein, 2, "-1D").collect()] == [(0, 1, -1.0)]
    assert M.aligned_by(frames.where("false"), K.levenshtein, 0, "0D").count() == 0

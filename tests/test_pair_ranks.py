"""Rank correlations of all pairs of vectors against plain loops."""

import math

import numpy as np
import pytest

from tests.test_dense import frame, similarity, signs
from tests.test_learned_traces import plain_tau
from tracewell.operators import dense, pair_ranks
from tracewell.plans import catalog, learned_traces as P


def ranks(x):
    return [sum(a < b for a in x) + (sum(a == b for a in x) + 1) / 2 for b in x]


def plain(vectors):
    pairs = [(similarity(x, y), signs(x), signs(y)) for n, (i, x) in enumerate(vectors) for _, y in vectors[n + 1 :] if similarity(x, y) is not None]
    sim = [s for s, _, _ in pairs]
    for width in (4, 1):
        guess = [sum(x[k : k + width] == y[k : k + width] for k in range(0, 64, width)) * width / 64 for _, x, y in pairs]
        yield len(pairs), float(np.corrcoef(ranks(sim), ranks(guess))[0, 1]), plain_tau(sim, guess), math.sqrt(sum((a - b) ** 2 for a, b in zip(sim, guess)) / len(pairs))


@pytest.mark.parametrize("held, width, run", [(1 << 23, 17, 64), (1, 14, 64), (40, 12, 3), (1 << 23, 24, 2)])
def test_agreement(spark, monkeypatch, held, width, run):
    """Pairs one by one and in tables, narrow and wide ranges, copies (equal similarities and codes), null and zero vectors."""
    for module, name, value in ((dense, "BLOCK", 9), (dense, "COLUMNS", 5), (pair_ranks, "HELD", held), (pair_ranks, "RANGE", width), (pair_ranks, "RUN", run), (pair_ranks, "CHUNK", 30)):
        monkeypatch.setattr(module, name, value)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(5, 64))
    vectors = [(i, [float(x) for x in base[i % 5] + rnd.normal(size=64) * rnd.choice([0, 0.3, 2])]) for i in range(30)] + [(50, [0.0] * 64), (51, None), (52, [None, *[1.0] * 63])]
    got = pair_ranks.agreement(frame(spark, vectors), 4, ("segments", "bits"))
    for (_, n, rho, tau, error), want in zip(got, plain(vectors), strict=True):
        assert n == want[0] and (rho, tau, error) == pytest.approx(want[1:], abs=1e-9)
    assert pair_ranks.agreement(frame(spark, vectors[:0]), 4, ("a", "b")) == []


def test_hamming_validation_takes_every_pair(spark):
    """No part of the pairs is left out, by the code or by its SQL."""
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert [r.n for r in P.hamming_validation(spark, sf).collect()] == [n * (n - 1) // 2] * 2
    assert "% 5" not in catalog.ORACLE_SQL["hamming_validation"]

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries, toxicity as T
from tests.conftest import SF


def random_chain(seed=1):
    rnd = np.random.default_rng(seed)
    c = T.Chain()
    c.words, c.steps, c.start = rnd.normal(size=T.BUCKETS), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    return c


def brute(chain, e):
    """Probability of tag 1 of each token by all tag sequences."""
    total, ones = 0.0, np.zeros(len(e))
    for tags in itertools.product((0, 1), repeat=len(e)):
        w = chain.start[tags[0]] + sum(x for t, x in zip(tags, e) if t) + sum(chain.steps[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(w)
        ones += np.exp(w) * np.array(tags)
    return ones / total


def test_marginals_equal_all_tag_sequences():
    chain, rnd = random_chain(), np.random.default_rng(2)
    sizes = [1, 7, 3, 10, 2, 2]
    texts = [rnd.normal(size=n) * 2 for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum(sizes) - sizes] = True
    got = chain.marginals(np.concatenate(texts), first)
    assert np.allclose(got, np.concatenate([brute(chain, e) for e in texts]), atol=1e-12)
    assert len(chain.marginals(np.zeros(0), np.zeros(0, bool))) == 0


def test_marginals_of_strong_weights_stay_finite():
    chain = random_chain()
    e = np.tile([800.0, -800.0, 3.0], 4000)
    first = np.zeros(len(e), bool)
    first[0] = True
    p = chain.marginals(e, first)
    assert np.isfinite(p).all() and p[0] > 0.999 and p[1] < 0.001


def test_gradient_equals_differences():
    chain, rnd = random_chain(3), np.random.default_rng(4)
    feature = rnd.integers(0, 12, (3, 5, T.FEATURES)).astype(np.int32)
    tag, size = rnd.integers(0, 2, (3, 5)), np.array([5, 1, 3])
    _, (words, steps, start) = chain.gradient(feature, tag, size)
    for p, g, places in ((chain.words, words, [(i,) for i in range(12)]), (chain.steps, steps, list(np.ndindex(2, 2))), (chain.start, start, [(0,), (1,)])):
        for at in places:
            old = p[at]
            p[at] = old + 1e-5
            more = chain.gradient(feature, tag, size)[0]
            p[at] = old - 1e-5
            less = chain.gradient(feature, tag, size)[0]
            p[at] = old
            assert g[at] == pytest.approx((more - less) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    return docs, labels, T.toxicity(docs, labels, spans=True).collect()


def test_held_out_documents(scored):
    docs, labels, rows = scored
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(toxic[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in held)
    assert np.mean([p == t for t, _, p in held]) > 0.95
    assert np.mean([p for t, _, p in held if not t]) < 0.03
    everything = [(toxic[r.doc_id], r.predicted) for r in rows if r.doc_id in toxic]
    assert np.mean([p for t, p in everything if t]) > 0.8


def test_spans_are_words_of_the_text(scored):
    docs, _, rows = scored
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [(text[r.doc_id][s.start : s.end], s.p) for r in rows for s in r.spans]
    assert spans and all(w and not any(map(str.isspace, w)) and p >= 0.5 for w, p in spans)
    assert sum(bool(r.spans) for r in rows if r.predicted) >= 0.9 * sum(r.predicted for r in rows)


def test_query_gives_the_operators_rows(spark):
    got = queries.op13_toxicity(spark, SF).collect()
    want = T.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    key = lambda r: (r.doc_id, round(r.score, 9), r.predicted, r.held_out)
    assert sorted(map(key, got)) == sorted(map(key, want)) and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]


def test_score_does_not_depend_on_other_columns_or_rows(spark, scored):
    docs, labels, rows = scored
    chain = T.fit(docs.where(T.fold() != 0), labels)
    some = docs.where("doc_id % 9 = 0").select(F.lit(5).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(3.0).alias("predicted"))
    again = sorted(round(r.score, 9) for r in T.score(some, chain).collect())
    assert again == sorted(round(r.score, 9) for r in rows if r.doc_id % 9 == 0)


def test_odd_rows_and_labels(spark, odd, none):
    bad = " ".join(["fine words here", "vileword"] * 5)
    good = "fine words here and there " * 5
    docs = odd.select("doc_id", "text", "lang", "score").union(spark.createDataFrame([(100 + i, f"{bad if i % 2 else good} {i}", "en", 1.0) for i in range(60)], "doc_id long, text string, lang string, score double"))
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (101, 1, None), (2, 0, 1), (999, 0, 1), (5, None, 7)], "doc_id long, quality int, toxic int")
    rows = T.toxicity(docs, labels, spans=True).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id and r.doc_id >= 100)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1 and all(not r.spans for r in rows if r.doc_id in (2, 3, 4)) and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert T.toxicity(none, labels).count() == 0
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert {(r.score, r.predicted) for r in T.toxicity(docs, few).collect()} == {(0.0, 0)}

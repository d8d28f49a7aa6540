import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tracewell.llm import pst


def part(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 5


def brute(docs):
    words = [(i, (t or "").encode().lower().split() + [None]) for i, t in docs]
    c = Counter(w for i, ws in words if part(i) not in (1, None) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, part(i) in (1, None), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words]


def agree(rows, docs):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    want = sorted(brute(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)


def test_base_score_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pst.fit_and_score(df).collect()
    agree(rows, [(r.doc_id, r.text) for r in df.collect()])


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    monkeypatch.setattr(pst, "WORD_SHARE", 1e-3)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    agree(pst.fit_and_score(df).collect(), [(r.doc_id, r.text) for r in df.collect()])


def chain(spark, rows=400):
    """Texts in which `alpha beta` is always followed by `gamma`, other words by chance."""
    rnd = random.Random(0)
    names = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(rows):
        out = []
        while len(out) < 60:
            out += ["alpha", "beta", "gamma"] if rnd.random() < 0.3 else [rnd.choice([*names, "beta", "alpha", "gamma"])]
        docs.append((i, " ".join(out)))
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_contexts_help_on_held_out_texts(spark):
    docs, df = chain(spark)
    tree, _ = pst.fit(df.where("crc32(cast(doc_id as string)) % 5 <> 1"))
    assert tree.levels[0]["kept"].any()
    rows = [r for r in pst.fit_and_score(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.95


def test_contexts_that_say_nothing_are_dropped(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(25)}" for _ in range(400))) for i in range(60)], "doc_id long, text string")
    tree, _ = pst.fit(df)
    assert len(tree.levels[0]["kept"]) == 25 and tree.levels[0]["kept"].mean() < 0.1


def test_states_are_distributions(spark):
    _, df = chain(spark)
    tree, _ = pst.fit(df)
    word = np.arange(-1, len(tree.words))
    p0 = np.append([1 - ((tree.counts + 0.5) / tree.norm).sum()], (tree.counts + 0.5) / tree.norm)
    for i in np.flatnonzero(tree.levels[0]["kept"])[:5]:
        assert tree.refine(0, np.full(len(word), i), word, p0).sum() == pytest.approx(1, abs=1e-9)


def test_odd_rows(odd, none):
    rows = pst.fit_and_score(odd).collect()
    agree(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert pst.fit_and_score(none).count() == 0
    untaught = pst.fit_and_score(odd.where("doc_id is null")).collect()
    assert [(r.train_tokens, r.n_known) for r in untaught] == [(0, 0)] and untaught[0].base_score == 0


def plain_scores(docs):
    """The score of every text by loops over a tree of dictionaries, without quantized or hashed numbers."""
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in docs]
    train = [ws for i, ws in texts if part(i) not in (1, None)]
    n = sum(map(len, train))
    unigram = Counter(w for ws in train for w in ws)
    norm = n + 0.5 * (len(unigram) + 1)
    often = {w for w, c in unigram.items() if c >= n * pst.WORD_SHARE}
    after = {}
    for ws in train:
        for d in range(1, pst.DEPTH + 1):
            for j in range(d, len(ws)):
                after.setdefault(tuple(ws[j - d : j]), Counter())[ws[j]] += 1
    levels, states = [{(w,): unigram[w] for w in often if w is not None and unigram[w] >= n * pst.CONTEXT_SHARE}], {}

    def state(context, seen, kept, most):
        low = {w: through(context[1:], w, most) for w in kept}
        other, left = seen - sum(kept.values()), max(1 - sum(low.values()), 1e-12)
        gain = sum(c * math.log(c / (seen * low[w])) for w, c in kept.items()) + (other * math.log(other / (seen * left)) if other else 0)
        if gain >= pst.GAIN + pst.GAIN_PER_WORD * len(kept):
            return seen, kept, (other + pst.STRENGTH * left) / ((seen + pst.STRENGTH) * left)

    def through(context, w, most):
        p = (unigram[w] + 0.5) / norm
        for d in range(1, min(len(context), most) + 1):
            if found := states.get(tuple(context[-d:])):
                seen, kept, rest = found
                p = (kept[w] + pst.STRENGTH * p) / (seen + pst.STRENGTH) if w in kept else p * rest
        return p

    for d in range(1, pst.DEPTH + 1):
        longer = {}
        for context, seen in levels[-1].items():
            kept = {w: c for w, c in after.get(context, {}).items() if w in often and c >= max(2, n * pst.PAIR_SHARE)}
            if found := state(context, seen, kept, d - 1):
                states[context] = found
            longer |= {(*context, w): c for w, c in kept.items() if w is not None and c >= n * pst.CONTEXT_SHARE}
        levels.append(longer)
    held, deep = levels[pst.DEPTH - 1], {}
    for context, words in after.items():
        if len(context) == pst.DEPTH and context not in held:
            kept = {w: c for w, c in words.items() if w in often and c >= pst.LEAST}
            if kept and (found := state(context, sum(words.values()), kept, pst.DEPTH)):
                deep[context] = found
    states |= deep
    return {i: sum(math.log10(through(ws[max(0, j - pst.DEPTH) : j], w, pst.DEPTH)) for j, w in enumerate(ws)) for i, ws in texts}, len(deep)


@pytest.mark.parametrize("shares", [None, (1e-4, 1e-3, 1e-4)])
def test_score_against_plain_loops(spark, monkeypatch, shares):
    for name, x in zip(("WORD_SHARE", "CONTEXT_SHARE", "PAIR_SHARE"), shares or ()):
        monkeypatch.setattr(pst, name, x)
    monkeypatch.setattr(pst, "COUNTED", 10_000)
    monkeypatch.setattr(pst, "PACKED", 5_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, deep = plain_scores(docs)
    assert deep or not shares
    rows = pst.fit_and_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], abs=5e-4 * r.n_tokens + 1e-6)


def test_texts_that_occur_twice_stand_out_however_large_the_corpus(spark, monkeypatch):
    """Contexts that occur twice are far below the shares; they count all the same."""
    for name, x in (("WORD_SHARE", 1e-4), ("CONTEXT_SHARE", 1e-2), ("PAIR_SHARE", 1e-2)):
        monkeypatch.setattr(pst, name, x)
    rnd = random.Random(5)
    made = lambda: " ".join(f"w{rnd.randrange(300)}" for _ in range(80))
    learned = [i for i in range(2000) if part(i) != 1]
    twice = [made() for _ in range(30)]
    docs = list(zip(learned, twice + twice + [made() for _ in range(400)]))
    rows = {r.doc_id: r.score / r.n_tokens for r in pst.fit_and_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert min(rows[i] for i in learned[:60]) > max(rows[i] for i in learned[60:460]) + 0.5


def test_packed_places_come_back():
    rnd = np.random.default_rng(0)
    held = pst.Places(3)
    key, word, text, low = rnd.integers(0, 2**64, 5000, np.uint64), rnd.integers(0, 65536, 5000), rnd.integers(0, 40, 5000), rnd.integers(0, 65536, 5000)
    uids, learned = rnd.integers(-(2**63), 2**63, 40), rnd.random(40) < 0.5
    held.add(uids, learned, key, word, text, low)
    back = set()
    for task, n, size, blob in held.packed():
        slot, w, t, p, u, f = pst._unpacked(n, size, blob)
        back |= set(zip(slot.tolist(), w.tolist(), u[t].tolist(), p.tolist(), f[t].tolist()))
    assert back == set(zip((key & np.uint64(2**36 - 1)).tolist(), word.tolist(), uids[text].tolist(), low.tolist(), learned[text].tolist()))

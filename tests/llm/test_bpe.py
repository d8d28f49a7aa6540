import random

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tracewell.llm import bpe
from tracewell.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def check(vocab, texts):
    for t, x in zip(texts, vocab.encode(texts)):
        assert np.frombuffer(x, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_texts(texts):
    with open(PATH, encoding="utf-8") as f:
        check(bpe.vocabulary(f.read()), texts)


def test_words_and_runs(vocab):
    rnd = random.Random(2)
    check(vocab, ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 40))) for _ in range(2000)])
    check(vocab, ["a" * 1000, "=-" * 900, "á" * 300, "  x \n\n y\x1c z\x85 q", "it's 'S don't I'LL", "a<|endoftext|> <|endoftext|>b  ", ""])


def test_every_token_encodes_to_itself_or_is_left_out(vocab):
    sample = vocab.tokens[:: 97]
    coded = vocab.encode_words([t for t in sample if t in vocab.age])
    assert all(len(x) == 4 for x in coded.values())


def test_shared_prefixes_are_worked_out_once(vocab, monkeypatch):
    asked = []
    plain = type(vocab).is_stable
    monkeypatch.setattr(type(vocab), "is_stable", lambda self, a, b: asked.append((a, b)) or plain(self, a, b))
    monkeypatch.setattr(vocab, "stable", {})
    words = [b"unhappiness" + bytes([c]) * 3 for c in b"abc"]
    vocab.encode_words([words[0]])
    alone = len(asked)
    asked.clear()
    vocab.stable.clear()
    vocab.encode_words(words)
    assert len(asked) < 2 * alone


def test_cache_starts_anew(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    for texts in (["one two three"], ["four five six seven"], ["one four nine ten eleven twelve " + "z" * 500]):
        check(vocab, texts)
    assert len(vocab.cache) <= 8


def test_tables_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = bpe.decode(bpe.encode(docs, PATH, keep=("source",)), PATH).collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert {r.doc_id: (r.text, r.source) for r in rows} == texts
    assert all(np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode(r.text, add_special_tokens=False).ids for r in rows[:40])


def test_only_the_verdict_on_the_round_trip_leaves_the_task(spark, odd):
    both = bpe.encode(odd, PATH, back="decoded", same="round_trip")
    assert both.columns == ["doc_id", "ids", "decoded", "round_trip"]
    assert all(r.round_trip is True for r in both.collect())
    bad = spark.createDataFrame([(1, "plain"), (2, None), (3, "")], "doc_id long, text string")
    assert bpe.encode(bad, PATH, same="round_trip").columns == ["doc_id", "ids", "round_trip"]
    assert {r.doc_id: (len(r.ids), r.round_trip) for r in bpe.encode(bad, PATH, same="round_trip").collect()} == {1: (4, True), 2: (0, True), 3: (0, True)}
    plan = corpus_pipeline.tokens(spark, bad, SF)._jdf.queryExecution().executedPlan().toString()
    assert "decoded" not in plan and "plain" not in plan.split("MapInArrow")[0]


def test_odd_rows(odd, none):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.text for r in rows} == {r.doc_id: r.text or "" for r in odd.collect()}
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    assert bpe.decode(bpe.encode(odd, PATH).selectExpr("doc_id", "unhex('ff000000') as ids"), PATH).first().text == LIBRARY.decode([255], skip_special_tokens=False)

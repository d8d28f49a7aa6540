import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.conftest import SF
from tracewell.llm import materialise as M
from tracewell.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, key):
    slots = M.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (M.unpermute(slots, n, key) == np.arange(n)).all()


def test_keys_give_different_orders():
    a, b = (M.permute(np.arange(500), 500, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(500))[0, 1]) < 0.2


def whole(rows):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.part] = np.frombuffer(r.ids, "<u2").tolist()
    return {k: sum((v[i] for i in sorted(v)), []) for k, v in by.items()}


def test_round_trip_and_resumed_reading(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    layout = M.write_shards(docs, str(tmp_path), RANKS, length=64, shard_places=500)
    rows = M.read_shards(spark, str(tmp_path)).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(layout["sequences"])) and len(layout["counts"]) > 3
    with open(RANKS, "rb") as f:
        encode = M._encoder(f.read()).encode_ordinary
    assert whole(rows) == {r.doc_id: [*encode(r.text), 50256] for r in docs.collect()}
    assert all(os.path.getsize(tmp_path / M.shard_name(i)) == n * layout["stride"] for i, n in enumerate(layout["counts"]) if n)
    for start in (0, 137, layout["counts"][0] - 1, layout["sequences"] - 2):
        for (slot, doc, part, ids), r in zip(M.read_sequences(str(tmp_path), start, 5), rows[start:]):
            assert (slot, doc, part, ids.tobytes()) == (r.slot, r.doc_id, r.part, r.ids)
    assert [r.byte_offset for r in rows if r.shard == 1] == [layout["stride"] * i for i in range(layout["counts"][1])]


def test_same_input_gives_the_same_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in "ab":
        M.write_shards(docs, str(tmp_path / d), RANKS, length=64, shard_places=1000)
    names = sorted(os.listdir(tmp_path / "a"))
    assert names == sorted(os.listdir(tmp_path / "b"))
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)


def test_odd_rows(spark, odd, none, tmp_path):
    layout = M.write_shards(odd, str(tmp_path / "a"), RANKS, length=64)
    rows = M.read_shards(spark, str(tmp_path / "a")).collect()
    assert len(rows) == layout["sequences"] and sum(r.part == 0 for r in rows) == odd.count()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert [np.frombuffer(r.ids, "<u2").tolist() for r in rows if r.doc_id in (2, 3)] == [[50256], [50256]]
    assert M.write_shards(none, str(tmp_path / "b"), RANKS)["sequences"] == 0
    assert M.read_shards(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(StopIteration):
        next(M.read_sequences(str(tmp_path / "b")))

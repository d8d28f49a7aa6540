import duckdb
import pytest

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_pii import brute as spans
from tests.test_queries import TABLES, rows
from tracewell.llm import queries
from tracewell.llm.queries import TOKENIZERS
from tracewell.storage import stored


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert rows(got) == rows(c.execute(queries.ORACLE_SQL[name]).fetchdf())


def test_stages_on_what_their_predecessors_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stored(stage(spark, docs, SF), name)
        now = {r.doc_id for r in out.collect()}
        assert now and now <= ids
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            groups = components(list(before.items()), 5, 80)
            assert now == {i for i, (_, c) in groups.items() if i == c}
        if name == "personal_data":
            assert now == ids
            for r in out.collect():
                assert not spans(r.text) and (r.text == before[r.doc_id]) <= (not spans(before[r.doc_id])) and r.n_chars == len(r.text)
        if name == "tokens":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "round_trip"] and all(r.round_trip for r in out.collect())
        else:
            assert out.columns == columns
        docs, ids = out, now
    assert ids == {r.doc_id for r in C.run(spark, SF).collect()}


def test_toxic_documents_leave_the_mixture(spark):
    big = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    left = {r.doc_id for r in C.mixture(spark, docs, big).collect()}
    share = lambda good: sum(i in left for i in good) / len(good)
    assert share([i for i, r in labels.items() if r.toxic]) < 0.3
    assert share([i for i, r in labels.items() if r.quality and not r.toxic]) > 0.85


def test_vocabulary_folder_is_outside_the_repository():
    assert not TOKENIZERS.startswith(C.__file__.rsplit("/", 1)[0])

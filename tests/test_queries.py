"""Every registered query of the similarity-search operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from tracewell.plans import catalog, learned_traces, movers, whole  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(None if x is None or x != x else (float(x) if isinstance(x, float) else x) for x in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(db.execute(catalog.ORACLE_SQL[name]).fetchdf())
    else:
        assert len(got)


def test_minhash_metrics_are_registered_with_sql():
    names = {f"minhash_{m}" for m in ("prob", "mrr", "precision", "recall", "recall_at_k", "recall_cascade")}
    assert names <= set(catalog.QUERIES) and names <= set(catalog.ORACLE_SQL)


def test_pair_measures_make_the_catalog_once(spark, monkeypatch):
    calls, plain = [], catalog.traces
    monkeypatch.setattr(catalog, "traces", lambda *x: calls.append(x) or plain(*x))
    assert catalog.QUERIES["pair_measures"](spark, SF).columns[:2] == ["i", "j"] and len(calls) == 1

"""Every query with SQL gives the same rows as DuckDB on the same files."""

import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


def rows(frame, columns):
    key = lambda r: str(r)
    return sorted([tuple(None if v != v else v for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=key)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, list(got.columns)) == rows(want, list(got.columns))


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


@pytest.mark.parametrize("name", ["stem_terms", "ann_topk"])
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_stems_of_the_query(spark, sf_dir):
    from quern.functions.stem import stem

    rows = entry.queries()["stem_terms"](spark, sf_dir).collect()
    assert len(rows) == len({r.term for r in rows}) and all(r.stem == stem(r.term) for r in rows)

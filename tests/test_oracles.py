"""Every query with SQL against DuckDB on the tables of the correctness gate; rows must agree and exist."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from linkwright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    plain = lambda x: None if x is None or x is pd.NA or x != x else x if isinstance(x, (str, bool)) else round(float(x), 6) + 0.0
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["char4_topk", "tfidf_topk_forward", "tfidf_topk_reverse"])
def test_records_that_share_only_very_common_tokens_meet(spark, tmp_path, name):
    ids = [0, 4, *(i for i in range(1, 26700) if i % 4)]
    docs = pd.DataFrame({"doc_id": ids, "lang": "en", "text": [f"common\nx{i}" for i in ids]})
    assert len(docs) > 20000
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert set(got.qi) == {0, 4} and rows(got) == rows(want)

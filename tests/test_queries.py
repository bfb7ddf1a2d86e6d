"""Every query that has SQL against that SQL, and the contract of the entry module."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from ledgerloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].astype(object).where(df[columns].notna(), None).astype(str).sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got, want = comparable(QUERIES[name](spark, SF).toPandas()), comparable(oracle.execute(SQL[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_manual_clusters_keep_the_direction_of_empty_amounts(spark, tmp_path):
    rows = [(1, "view", "0.0"), (2, "view", "5.25"), (3, "purchase", "0.0"), (4, "click", "0.0"), (5, "signup", "0.0"), (6, "view", "-3.0"), (7, "error", "null"), (8, "click", "null")]
    values = ", ".join(f"({i}, timestamp '2024-01-01 00:00:00', 9, '{kind}', cast({value} as double), '{{\"k\": 7}}')" for i, kind, value in rows)
    con = duckdb.connect()
    con.execute(f"copy (select * from (values {values}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = comparable(QUERIES["manual_normalize_cluster"](spark, str(tmp_path)).toPandas()), comparable(con.execute(SQL["manual_normalize_cluster"]).df())
    pd.testing.assert_frame_equal(got, want)
    assert set(got.loc[got["members"].isin(["1,2,6", "5", "7"]), "transaction_type"]) == {"CREDIT"} and len(got) == 5


def test_entry_module(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns[:2] == ["statement_id", "counterparty_name"]

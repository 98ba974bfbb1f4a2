"""Registered queries against their oracle SQL on sf0.001, and over an empty copy of the tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from shelfwise.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE_SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr)
    assert key(got) == key(want)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_toxicity", "op8_url_filters", "op11_periodic_runs", "op12_ranked_search", "op13_nearest_vectors"])
def test_empty_tables(spark, scratch, name):
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(os.path.join(scratch, f"{t}.parquet"))
    assert QUERIES[name](spark, scratch).count() == 0

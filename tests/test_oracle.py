"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lodestone.oracle import ORACLE_SQL
from lodestone.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if pd.isna(v):
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 9))
        return str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_context_block_reads_every_part(spark, data, tmp_path):
    parts = spark.read.parquet(f"{data}/part.parquet")
    parts.where("p_partkey > 150").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["context_block"](spark, str(tmp_path)).first()
    assert got["total_nodes"] == parts.where("p_partkey > 150").selectExpr("p_partkey % 120 as id").distinct().count() > 0


def test_only_file_scan_has_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"file_scan"}

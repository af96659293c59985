"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from checks.registry import ORACLES as SQL, QUERIES
import __spark_entry__ as entry  # noqa: F401  registers them
from compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(autouse=True, scope="module")
def compiled(spark):
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_sizes_beyond_64_bits(spark, tmp_path):
    keys = [0, 1, 5, 3000, 524_287, 524_288, 9_000_000, 54_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["size"] for r in QUERIES["format_sizes"](spark, str(tmp_path)).collect()}
    assert got == {
        0: "0 B", 1: "64 B", 5: "7.8 KB", 3000: "1.6 TB", 524_287: "8.0 EB", 524_288: "8.0 EB", 9_000_000: "40467.6 EB", 54_000_000: "8741007.9 EB",
    }

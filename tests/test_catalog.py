"""Every query with SQL gives the rows that SQL gives; the others give rows."""

import duckdb
import pytest

import __spark_entry__
from gausslake.plans import catalog
from tests.oracle import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "n"), [("chamfer", 9000), ("overlap_fraction", 17_000), ("adds_error", 5000)])
def test_whole_table_above_the_sample_size(spark, name, n, tmp_path):
    made = "array(" + ", ".join(f"cast(2 * rand({k}) as float)" for k in range(11)) + ") as embedding"
    spark.range(n).selectExpr("id as vec_id", made, "cast(id % 10 as int) as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

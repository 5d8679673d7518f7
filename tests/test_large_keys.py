"""Queries against their SQL twins on tables whose order numbers are large, as in larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import ORACLES, QUERIES, table_of


@pytest.fixture(scope="module")
def large_keys(spark, small, tmp_path_factory):
    """Lines of all sizes of order numbers: point ids have from 4 to 13 digits."""
    folder = tmp_path_factory.mktemp("large_keys")
    lines = spark.read.parquet(f"{small}/lineitem.parquet").where("l_partkey % 4 = 0")
    lines.withColumn("l_orderkey", F.col("l_orderkey") * 4999).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["occupancy_grid", "voxel_export", "static_points", "visible_samples"])
def test_large_point_ids(spark, large_keys, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{large_keys}/lineitem.parquet/*.parquet'")
    assert con.execute("SELECT max(l_orderkey) * 8 * 2000 * 64 > 5e12 FROM lineitem").fetchone()[0]
    df = QUERIES[name](spark, large_keys)
    cur = con.execute(ORACLES[name])
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of([d[0] for d in cur.description], cur.fetchall())

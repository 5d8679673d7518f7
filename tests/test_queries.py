"""Every registered query against its SQL twin on the small tables, and the shape of its plan."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayline.plans import load_all

QUERIES, ORACLES = load_all()

#: binary sweeps are unpacked with numpy, trajectories and lanes are solved by recursions, planes are searched
WITH_PYTHON = {"lidar_sweep_decode", "filtered_trajectory", "corrected_residuals", "resampled_lanes", "fixed_lane_points", "support_plane_inliers"}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "frame", "cam_us", "sweep", "sweep_us"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 120 and len(QUERIES) - len(ORACLES) <= 16


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, got) == table_of(names, cur.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in WITH_PYTHON:
        assert "Python" not in plan and "InPandas" not in plan

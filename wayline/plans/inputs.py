"""Sensor-shaped views of the given tables, for Spark and as SQL text.

The select lists are written once and used on both sides, so that both start
from the same numbers; the work done on them is written separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

T_SPARK = "unix_micros(cast(ts as timestamp))"
T_SQL = "epoch_us(ts)"

POSE_COLUMNS = [
    "user_id AS run_id",
    "event_id AS idx",
    "{T} AS t_us",
    "event_type AS kind",
    "37e0 + (event_id % 997) / 1e4 AS lat",
    "-122e0 + (event_id % 991) / 1e4 AS lon",
    "value AS height",
    "(event_id % 13) - 6e0 AS v_north",
    "(event_id % 11) - 5e0 AS v_east",
    "((event_id % 7) - 3e0) / 10 AS v_up",
    "((event_id % 5) - 2e0) AS rot_y",
    "((event_id % 9) - 4e0) / 2 AS rot_x",
    "(event_id % 360) * 1e0 AS azimuth",
]

# boxes: a part is a frame, 'F' lines are truths and 'O' lines detections
BOX_COLUMNS = [
    "l_partkey AS frame",
    "((l_orderkey * 8 + l_linenumber) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS box_id",
    "l_linestatus AS side",
    "l_quantity * 10 AS x1",
    "l_extendedprice / 100 AS y1",
    "l_quantity * 10 + (20 + l_tax * 1000) AS x2",
    "l_extendedprice / 100 + (20 + l_discount * 500) AS y2",
    "l_extendedprice AS score",
    "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE -1 END AS class_id",
    "l_orderkey AS track_id",
]

# points of a cloud: a part is a sweep, an order line a return
POINT_COLUMNS = [
    "l_partkey AS sweep",
    "((l_orderkey * 8 + l_linenumber) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id",
    "l_quantity AS x",
    "l_extendedprice / 1000 AS y",
    "l_discount * 100 AS z",
    "l_tax * 1000 AS intensity",
    "l_linenumber AS laser",
]

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("{T}", T_SPARK) for c in POSE_COLUMNS])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*BOX_COLUMNS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*POINT_COLUMNS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: 100 times the first four elements, label as run."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").cast("bigint").alias("run_id"),
        *[(e[i].cast("double") * 100).alias(n) for i, n in enumerate(["x", "y", "z", "intensity"])],
    )


def _cte(name: str, columns: list[str], source: str) -> str:
    cols = ", ".join(c.replace("{T}", T_SQL) for c in columns)
    return f"{name} AS (SELECT {cols} FROM {source})"


POSES = _cte("poses", POSE_COLUMNS, "events")
BOXES = _cte("boxes", BOX_COLUMNS, "lineitem")
POINTS = _cte("points", POINT_COLUMNS, "lineitem")
VECTORS = """vectors AS (SELECT vec_id, CAST(label AS BIGINT) AS run_id,
  CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y,
  CAST(embedding[3] AS DOUBLE) * 100 AS z, CAST(embedding[4] AS DOUBLE) * 100 AS intensity FROM embeddings)"""


def q(col: Column, digits: int = 4) -> Column:
    """Quantise by plain double arithmetic, which both engines do alike."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / scale


def qs(expr: str, digits: int = 4) -> str:
    """The same in SQL."""
    scale = f"1e{digits}"
    return f"floor(({expr}) * {scale} + 0.5e0) / {scale}"

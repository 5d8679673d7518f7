"""Calibration tables and the export of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline import schemas


def flatten_calibration(documents: DataFrame, text: str = "value") -> DataFrame:
    """Nested calibration JSON to rows (path, values): ``lidar/height``, ``cam/0/KK``, ...; matrices row by row."""
    keep = [c for c in documents.columns if c != text]
    d = documents.withColumn("_c", F.from_json(text, schemas.CALIBRATION))

    def entry(prefix, name, value, kind):
        values = {"matrix": lambda v: F.flatten(v), "vector": lambda v: v, "scalar": lambda v: F.array(v)}[kind](value)
        return F.struct(F.concat(prefix, F.lit(name)).alias("path"), F.when(value.isNotNull(), values).alias("values"))

    lidar = [entry(F.lit("lidar/"), "T_from_l_to_i", F.col("_c.lidar.T_from_l_to_i"), "matrix"), entry(F.lit("lidar/"), "height", F.col("_c.lidar.height"), "scalar")]
    radar = [entry(F.lit("radar/"), "R", F.col("_c.radar.R"), "matrix"), entry(F.lit("radar/"), "T", F.col("_c.radar.T"), "vector")]
    kinds = {"KK": "matrix", "distort": "vector", "E": "matrix", "R": "matrix", "displacement": "vector", "width": "scalar", "height": "scalar"}
    cams = F.flatten(
        F.transform(
            F.coalesce(F.col("_c.cam"), F.array()),
            lambda cam, i: F.array(*[entry(F.concat(F.lit("cam/"), i.cast("string"), F.lit("/")), n, cam[n], k) for n, k in kinds.items()]),
        )
    )
    return d.select(*keep, F.explode(F.concat(F.array(*lidar, *radar), cams)).alias("_e")).select(*keep, "_e.*").where("values IS NOT NULL")


def run_documents(kinds: dict[str, DataFrame], run: str, time: str) -> DataFrame:
    """One JSON row per record: run, kind, time and the record's fields as ``payload``; kinds without a time have none."""
    out = None
    for kind, df in kinds.items():
        fields = [c for c in df.columns if c not in (run, time)]
        t_us = F.col(time) if time in df.columns else F.lit(None).cast("bigint")
        part = df.select(run, F.lit(kind).alias("kind"), t_us.alias("t_us"), F.to_json(F.struct(*fields)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def export_manifest(spark: SparkSession, path: str, run: str) -> DataFrame:
    """What an export folder holds: (run as text, kind, batch, files, bytes), one row per run and kind.

    Of exports at the same time that wrote the same run and kind, the batch
    first by name counts.
    """
    schema = f"{run} string, kind string, batch string, files bigint, bytes bigint"
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    first = F.min(F.struct("batch", "files", "bytes"))
    return spark.read.json(f"{path}/manifest", schema=schema).groupBy(run, "kind").agg(first.alias("_b")).select(run, "kind", "_b.*")


def export_runs(documents: DataFrame, run: str, path: str) -> str | None:
    """Write gzip JSON by run and kind; what the manifest of ``path`` names already is skipped.

    Every call writes a batch folder of its own, ``data/batch=...``, and appends
    to the manifest only when all of it is there. So a write that breaks leaves
    a batch that no reader looks at, and the next call writes its runs again;
    such folders may be removed while no export runs. The manifest comes from
    the listing of the batch, no data are read for it. Null and empty run names
    are one run. Returns the batch's name, None if there was nothing to write.
    """
    spark = documents.sparkSession
    there = export_manifest(spark, path, run).select(F.col(run).alias("_run"), F.col("kind").alias("_kind"))
    name = F.nullif(F.col(run).cast("string"), F.lit(""))
    todo = documents.join(there, name.eqNullSafe(F.col("_run")) & (F.col("kind") == F.col("_kind")), "left_anti")
    batch = uuid.uuid4().hex
    folder = f"{path}/data/batch={batch}"
    # the payload parts what has equal times or none, so that a long run is spread over tasks
    order = [run, "kind", "t_us", "payload"]
    ordered = todo.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.partitionBy(run, "kind").option("compression", "gzip").json(folder)
    schema = f"path string, modificationTime timestamp, length bigint, content binary, {run} string, kind string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz")
    if files.load(folder).select("path").isEmpty():
        return None
    done = files.schema(schema).load(folder).groupBy(run, "kind").agg(F.lit(batch).alias("batch"), F.count("*").alias("files"), F.sum("length").alias("bytes"))
    done.write.mode("append").json(f"{path}/manifest")
    return batch


def read_runs(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The records of all finished exports of a folder: run as text, kind, time and payload."""
    schema = f"t_us bigint, payload string, batch string, {run} string, kind string"
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.json(f"{path}/data", schema=schema)
    done = export_manifest(spark, path, run).select(F.col("batch").alias("_batch"), F.col(run).alias("_run"), F.col("kind").alias("_kind"))
    here = (F.col("batch") == F.col("_batch")) & (F.col("kind") == F.col("_kind")) & F.col(run).eqNullSafe(F.col("_run"))
    return rows.join(done, here, "left_semi").select(run, "kind", "t_us", "payload")

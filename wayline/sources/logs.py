"""Text and binary sensor logs to tables.

Parsers take DataFrames of lines (or of binary content), so the same code runs
on files, on tables and on streams; ``read_*`` add the file source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.functions import geodesy
from wayline.operators import segments


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, split start and a line id; (split_start, line_id) is the order inside a file.

    A split is read by one task from front to back, so the id rises within it,
    and splits are ordered by where they start; files need not fit one task.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )


def run_of_file(file: Column, suffix: str) -> Column:
    """Run name: file stem without the suffix."""
    return F.regexp_extract(file, rf"([^/]+?){suffix}(?:\.gz|\.bz2)?$", 1)


# fixed values: fields 10 to 19 of a pose record
POSE_FIELDS = ("seconds", "lat", "lon", "height", "v_north", "v_east", "v_up", "rot_y", "rot_x", "azimuth")


def parse_poses(lines: DataFrame, text: str = "value") -> DataFrame:
    """Pose records from log lines; others drop out. Adds the fields, week and t_us."""
    tokens = F.split(F.rtrim(F.col(text)), ",")
    d = lines.withColumn("_t", tokens)
    at = F.array_position(F.transform("_t", lambda t: t.contains("PVA")), F.lit(True))
    # without a tag the last token is where the search ends
    d = d.withColumn("_t", F.slice("_t", F.when(at > 0, at).otherwise(F.size("_t")).cast("int"), F.size("_t")))
    tagged = F.concat(F.slice("_t", 1, 11), F.slice("_t", 13, 10))
    d = d.withColumn("_t", F.when(F.size("_t") == 22, tagged).otherwise(F.col("_t"))).where(F.size("_t") == 21)
    fields = {n: F.element_at("_t", i + 11).try_cast("double") for i, n in enumerate(POSE_FIELDS)}
    d = d.withColumns(fields).withColumn("week", F.get(F.split(F.element_at("_t", 10), ";"), F.lit(1)).try_cast("int"))
    d = d.where(F.col("seconds").isNotNull() & F.col("week").isNotNull())
    return d.withColumn("t_us", geodesy.gps_to_utc_us(F.col("week"), F.col("seconds"))).drop("_t", text)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    d = parse_poses(read_lines(spark, path))
    return d.withColumn("run_id", run_of_file(F.col("file"), r"_gps(?:mark[12])?\.out"))


# fixed values: substrings that route a message to a log
MARKS = {1: "MARK1PVAA", 2: "MARK2PVAA"}


def route_marks(lines: DataFrame, text: str = "value") -> DataFrame:
    """Add ``mark`` (1, 2 or null for other messages)."""
    mark = F.lit(None).cast("int")
    for number, tag in reversed(MARKS.items()):
        mark = F.when(F.col(text).contains(tag), F.lit(number)).otherwise(mark)
    return lines.withColumn("mark", mark)


def write_routed(lines: DataFrame, path: str) -> None:
    """One folder per mark; messages without one are left out."""
    routed = route_marks(lines).where("mark IS NOT NULL")
    routed.write.mode("overwrite").partitionBy("mark").parquet(path)


# fixed values: places of the variances in a covariance line
COVARIANCE_TOKENS = {"tx": 7, "ty": 11, "tz": 15, "rx": 16, "ry": 20, "rz": 24}


def parse_covariances(lines: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, text: str = "value") -> DataFrame:
    """Standard deviations from the line after each line that holds INSCOV."""
    d = segments.follow_marker(lines, keys, order, text, "INSCOV", width).where(~F.col(text).contains("INSCOV"))
    tokens = F.split(text, " ")
    return d.select(*keys, *order, *[F.sqrt(F.get(tokens, F.lit(i)).try_cast("double")).alias(n) for n, i in COVARIANCE_TOKENS.items()])


def read_covariances(spark: SparkSession, path: str) -> DataFrame:
    return parse_covariances(read_lines(spark, path), ["file"], ["split_start", "line_id"], 1)


LIDAR_RECORD = 6  # float32 values per point


def decode_sweeps(files: DataFrame, content: str, sweep_us: str) -> DataFrame:
    """Points of binary sweeps: little-endian float32 x, y, z, intensity, laser, microseconds before the sweep's end."""
    schema = "sweep_us bigint, x float, y float, z float, intensity float, laser int, dt_us int, t_us bigint"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw, end in zip(batch["_content"], batch["_end"]):
                v = np.frombuffer(raw, "<f4")
                v = v[: len(v) // LIDAR_RECORD * LIDAR_RECORD].reshape(-1, LIDAR_RECORD)
                dt = v[:, 5].astype(np.int64)
                yield pd.DataFrame(
                    {
                        "sweep_us": np.full(len(v), end, np.int64),
                        **{n: v[:, i] for i, n in enumerate(("x", "y", "z", "intensity"))},
                        "laser": v[:, 4].astype(np.int32),
                        "dt_us": dt.astype(np.int32),
                        "t_us": end - dt,
                    }
                )

    return files.select(F.col(content).alias("_content"), F.col(sweep_us).cast("bigint").alias("_end")).mapInPandas(decode, schema)


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Sweep files; the file name is the sweep's end in microseconds."""
    files = spark.read.format("binaryFile").load(path).select(
        "content", F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("bigint").alias("sweep_us")
    )
    return decode_sweeps(files, "content", "sweep_us")


def write_points(points: DataFrame, path: str, run: str = "run_id") -> None:
    """Parquet by run, sorted by time, so that time ranges prune row groups."""
    points.repartitionByRange(run, "t_us").sortWithinPartitions(run, "t_us").write.mode("overwrite").partitionBy(run).parquet(path)


# fixed values: fields of radar object and target lines
RADAR_FIELDS = {
    "O": ("id", "dist", "lat_dist", "rel_spd", "dyn_prop", "rcs", "w", "l"),
    "T": ("id", "dist", "lat_dist", "rel_spd", "dyn_prop", "traj", "w", "l", "obst_probab", "exist_probab", "rel_acc", "type", "lost_reason"),
}


def parse_radar(lines: DataFrame, text: str = "value") -> DataFrame:
    """Objects and targets in one table; fields the other kind has are null."""
    d = lines.withColumns({"kind": F.substring(text, 1, 1), "_t": F.split(F.rtrim(F.expr(f"substring({text}, 3)")), " ")}).drop(text)
    fields = list(dict.fromkeys(f for names in RADAR_FIELDS.values() for f in names))
    cols = {}
    for f in fields:
        value = F.lit(None).cast("double")
        for kind, names in RADAR_FIELDS.items():
            if f in names:
                value = F.when(F.col("kind") == kind, F.get("_t", F.lit(names.index(f))).try_cast("double")).otherwise(value)
        cols[f] = value.cast("int") if f == "id" else value
    sizes = F.when(F.col("kind") == "O", len(RADAR_FIELDS["O"])).when(F.col("kind") == "T", len(RADAR_FIELDS["T"]))
    return d.where(F.size("_t") == sizes).withColumns(cols).drop("_t")


def read_radar(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path)
    return parse_radar(lines).withColumn("sweep_us", F.regexp_extract("file", r"(\d+)\.[^./]+$", 1).try_cast("bigint"))


def parse_nmea(lines: DataFrame, text: str = "value") -> DataFrame:
    """GPGGA positions and GPHDT headings; degrees from ddmm.mm, sentence kind in ``sentence``."""
    body = F.regexp_extract(text, r"\$(GP(?:GGA|HDT),[^*\r\n]*)", 1)
    d = lines.withColumn("_t", F.split(body, ",")).withColumn("sentence", F.get("_t", F.lit(0))).where(F.col("sentence").isin("GPGGA", "GPHDT"))

    def field(i, kind):
        return F.when(F.col("sentence") == kind, F.get("_t", F.lit(i)))

    def degrees(i, digits):
        raw = field(i, "GPGGA")
        return F.substring(raw, 1, digits).try_cast("double") + F.substring(raw, digits + 1, F.length(raw)).try_cast("double") / 60

    return d.withColumns(
        {
            "utc": field(1, "GPGGA").try_cast("double"),
            "lat": degrees(2, 2),
            "north": field(3, "GPGGA") == "N",
            "lon": degrees(4, 3),
            "east": field(5, "GPGGA") == "E",
            "fix": field(6, "GPGGA").try_cast("int"),
            "satellites": field(7, "GPGGA").try_cast("int"),
            "hdop": field(8, "GPGGA").try_cast("double"),
            "altitude": field(9, "GPGGA").try_cast("double"),
            "heading": field(1, "GPHDT").try_cast("double"),
        }
    ).drop("_t", text)


def catalogue(files: DataFrame, path: str = "file") -> DataFrame:
    """Route, segment, split and run of GPS log paths ``<route>/<segment>_<split>_..gps.out``."""
    file = F.col(path)
    name = F.substring_index(file, "/", -1)
    return files.withColumns(
        {
            "route": F.regexp_extract(file, r"([^/]+)/[^/]+$", 1),
            "segment": F.regexp_extract(name, r"^(.*?)_[A-Za-z]_", 1),
            "split": F.regexp_extract(name, r"^.*?_([A-Za-z])_", 1),
            "run_id": F.regexp_extract(name, r"^(.*?_[A-Za-z])_", 1),
        }
    ).where(name.endswith("gps.out") & (F.col("split") != ""))


def camera_number(video: Column) -> Column:
    """Trailing digits of a video name."""
    return F.regexp_extract(video, r"(\d+)\.(?:avi|zip)$", 1).try_cast("int")

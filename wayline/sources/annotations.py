"""Annotation lists: line format, XML and tracker dumps, in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline import schemas

def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``"name@frame": (x1, y1, x2, y2):score/silhouette, ...;`` to one row per box.

    Coordinates are rounded, the frame is -1 when absent, and an image without
    boxes gives one row with a null box number.
    """
    d = lines.withColumn("_name", F.substring_index(F.expr(f"substring({text}, 2)"), '"', 1))
    d = d.where(F.col(text).startswith('"') & (F.col("_name") != ""))
    number = F.substring_index("_name", "@", -1)
    d = d.withColumn("_frame", F.when(F.col("_name").contains("@"), number.try_cast("bigint")))
    before = F.expr("substring(_name, 1, length(_name) - length(substring_index(_name, '@', -1)) - 1)")
    # every box opens with a bracket; the rest of its text up to the next one holds all of it
    rest = F.expr(f"substring({text}, length(_name) + 3)")
    pieces = F.split(rest, r"\(")
    d = d.withColumns(
        {
            "image": F.when(F.col("_frame").isNotNull(), F.regexp_replace(before, "/$", "")).otherwise(F.col("_name")),
            "frame": F.coalesce("_frame", F.lit(-1)),
            "_pieces": F.slice(pieces, 2, F.size(pieces)),
        }
    )
    d = d.select("*", F.posexplode_outer("_pieces").alias("box_no", "_piece")).drop("_pieces", "_name", "_frame", text)
    d = d.withColumn("_parts", F.split(F.translate("_piece", " );\r", ""), ","))
    d = d.withColumn("_tail", F.get("_parts", F.lit(3)))
    plain = F.substring_index("_tail", "/", 1)

    def number_at(i):
        return F.rint(F.get("_parts", F.lit(i)).try_cast("double"))

    return d.withColumns(
        {
            **{c: number_at(i) for i, c in enumerate(("x1", "y1", "x2"))},
            "y2": F.rint(F.substring_index(plain, ":", 1).try_cast("double")),
            "score": F.when(plain.contains(":"), F.substring_index(plain, ":", -1).try_cast("double")),
            "silhouette": F.when(F.col("_tail").contains("/"), F.substring_index("_tail", "/", -1).try_cast("int")),
        }
    ).drop("_piece", "_parts", "_tail")


def read_line_lists(spark: SparkSession, path: str) -> DataFrame:
    """Line lists; gzip and bzip2 by file extension."""
    return parse_lines(spark.read.text(path))


def explode_annotations(documents: DataFrame, annotation: str) -> DataFrame:
    """Rows per box from annotation structs; images without boxes keep one row."""
    a = F.col(annotation)
    d = documents.select("*", a["image"]["name"].alias("image"), F.coalesce(a["image"]["frameNr"], F.lit(-1)).alias("frame"), F.posexplode_outer(a["annorect"]).alias("box_no", "_r"))
    names = {"x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2", "score": "score", "scale": "scale", "classID": "class_id", "track_id": "track_id"}
    return d.select(*[c for c in documents.columns if c != annotation], "image", "frame", "box_no", *[F.col("_r")[k].alias(v) for k, v in names.items()])


def parse_xml(texts: DataFrame, text: str = "value") -> DataFrame:
    """One ``<annotation>`` element per row of text."""
    d = texts.withColumn("_a", F.from_xml(F.col(text), F.lit(schemas.ANNOTATION_XML), {"rowTag": "annotation"})).drop(text)
    return explode_annotations(d, "_a")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(schemas.ANNOTATION_XML).option("rowTag", "annotation").xml(path)
    return explode_annotations(d.select(F.struct("image", "annorect").alias("_a")), "_a")


def parse_track_dump(dumps: DataFrame, text: str = "value") -> DataFrame:
    """Tracker output in JSON: one row per track in, one row per visible box out, by frame."""
    d = dumps.withColumn("_d", F.from_json(text, schemas.TRACK_DUMP)).select(
        *[c for c in dumps.columns if c != text], F.col("_d.track").alias("track_id"), F.explode("_d.boxes").alias("_b")
    )
    return d.where("_b.lost = 0").select(
        *[c for c in dumps.columns if c != text], F.col("_b.frame").alias("frame"), "track_id",
        *[F.col("_b")[k].alias(v) for k, v in (("xtl", "x1"), ("ytl", "y1"), ("xbr", "x2"), ("ybr", "y2"))],
    )


def to_lines(boxes: DataFrame, ident: str) -> DataFrame:
    """Line format: image, frame and ``value``; an image is one line, its boxes in order of their id."""
    coords = [F.col(c).cast("bigint").cast("string") for c in ("x1", "y1", "x2", "y2")]
    box = F.concat(F.lit(" ("), F.concat_ws(", ", *coords), F.lit(")"), F.coalesce(F.concat(F.lit(":"), F.col("score").cast("string")), F.lit("")))
    d = boxes.withColumn("_box", F.struct(F.col(ident).alias("i"), box.alias("t"))).groupBy("image", "frame").agg(F.array_sort(F.collect_list("_box")).alias("_b"))
    name = F.concat(F.lit('"'), F.col("image"), F.when(F.col("frame") >= 0, F.concat(F.lit("@"), F.col("frame").cast("string"))).otherwise(F.lit("")), F.lit('":'))
    return d.select("image", "frame", F.concat(name, F.concat_ws(",", F.col("_b.t")), F.lit(";")).alias("value"))


def to_xml_rows(boxes: DataFrame, ident: str) -> DataFrame:
    """Annotation structs, one per image, its boxes in order of their id."""
    rect: Column = F.struct(F.col(ident).alias("_id"), *[F.col(c) for c in ("x1", "y1", "x2", "y2", "score")], F.col("class_id").cast("int").alias("classID"))
    d = boxes.groupBy("image", "frame").agg(F.array_sort(F.collect_list(rect)).alias("_b"))
    rects = F.transform("_b", lambda r: F.struct(*[r[c].alias(c) for c in ("x1", "y1", "x2", "y2", "score", "classID")]))
    return d.select(F.struct(F.col("image").alias("name"), F.col("frame").alias("frameNr")).alias("image"), rects.alias("annorect"))


def write_annotations(boxes: DataFrame, ident: str, path: str, form: str = "lines", compression: str = "none") -> None:
    if form == "lines":
        to_lines(boxes, ident).select("value").write.mode("overwrite").option("compression", compression).text(path)
    else:
        to_xml_rows(boxes, ident).write.mode("overwrite").option("rowTag", "annotation").option("rootTag", "annotationlist").xml(path)

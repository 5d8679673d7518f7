"""File sources and sinks on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import boxes as box_ops
from wayline.sources import annotations, logs, tables

POSE = "head,#{tag},COM1,0,0,0,0,0,0,0,FINESTEERING;1786,400000.0,{event}37.5,-122.25,10.0,1.0,2.0,0.1,0.5,-0.5,90.0,*sum"


def test_pose_log_files(spark, tmp_path):
    lines = [POSE.format(tag="MARK1PVAA", event=""), "noise", POSE.format(tag="MARK2PVAA", event="77,"), POSE.format(tag="INSPVAA", event="1,2,")]
    (tmp_path / "seg_a_gps.out").write_text("\n".join(lines) + "\n")
    rows = logs.read_poses(spark, str(tmp_path)).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r.run_id, r.week, r.t_us, r.lat, r.azimuth) == ("seg_a", 1786, 1396537584000000, 37.5, 90.0)
    out = str(tmp_path / "routed")
    logs.write_routed(logs.read_lines(spark, str(tmp_path / "seg_a_gps.out")), out)
    assert {(r.mark, r.n) for r in spark.read.parquet(out).groupBy("mark").agg(F.count("*").alias("n")).collect()} == {(1, 1), (2, 1)}


def test_covariance_file(spark, tmp_path):
    record = " ".join(str(i * i) for i in range(25))
    (tmp_path / "x_gpscov.out").write_text(f"first\n#INSCOVA,1\n{record}\nother\n#INSCOVA,2\n#INSCOVA,3\n{record}\n")
    rows = logs.read_covariances(spark, str(tmp_path)).collect()
    assert [(r.tx, r.ty, r.tz, r.rx, r.ry, r.rz) for r in rows] == [(7, 11, 15, 16, 20, 24)] * 2


def test_lidar_files_and_point_table(spark, tmp_path):
    a = np.array([[1, 2, 3, 40, 5, 100], [4, 5, 6, 50, 31, 0]], "<f4")
    (tmp_path / "ldr").mkdir()
    (tmp_path / "ldr" / "1396537584000000.ldr").write_bytes(a.tobytes())
    d = logs.read_sweeps(spark, str(tmp_path / "ldr"))
    assert {(r.x, r.laser, r.t_us) for r in d.collect()} == {(1.0, 5, 1396537583999900), (4.0, 31, 1396537584000000)}
    out = str(tmp_path / "points")
    logs.write_points(d.withColumn("run_id", F.lit("r")), out)
    back = spark.read.parquet(out).where("run_id = 'r' AND t_us < 1396537584000000")
    assert back.count() == 1


def test_radar_file(spark, tmp_path):
    (tmp_path / "55.rdr").write_text("O 3 10.5 1 -2 0 7.5 1.8 4.5\nT 3 10.5 1 -2 0 9 1.8 4.5 0.9 0.8 0.1 2 0\nT 1 2\n")
    rows = {r.kind: r for r in logs.read_radar(spark, str(tmp_path)).collect()}
    assert rows["O"].rcs == 7.5 and rows["O"].traj is None and rows["O"].sweep_us == 55
    assert rows["T"].traj == 9 and rows["T"].rcs is None and rows["T"].l == 4.5 and len(rows) == 2


def test_nmea(spark):
    d = spark.createDataFrame([("$GPGGA,120000.5,3730.5000,N,12215.2500,W,4,9,0.8,25.5,M\r",), ("x$GPHDT,87.5,T*1",), ("$GPVTG,1",)], "value string")
    rows = {r.sentence: r for r in logs.parse_nmea(d).collect()}
    assert rows["GPGGA"].lat == pytest.approx(37 + 30.5 / 60) and rows["GPGGA"].lon == pytest.approx(122 + 15.25 / 60)
    assert rows["GPGGA"].north and not rows["GPGGA"].east and rows["GPGGA"].satellites == 9
    assert rows["GPHDT"].heading == 87.5 and len(rows) == 2


LINES = ['"img/a.png@7": (1.4, 2.6, 3, 4):0.5/2, (5, 6, 7, 8);', '"img/b.png";', '"img/c.png@9":;']


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_annotation_lines(spark, tmp_path, suffix):
    import gzip

    p = tmp_path / f"list.idl{suffix}"
    (gzip.open(p, "wt") if suffix else open(p, "w")).write("\n".join(LINES) + "\n")
    rows = annotations.read_line_lists(spark, str(p)).collect()
    got = {(r.image, r.frame, r.box_no, r.x1, r.y1, r.score, r.silhouette) for r in rows}
    assert got == {
        ("img/a.png", 7, 0, 1.0, 3.0, 0.5, 2), ("img/a.png", 7, 1, 5.0, 6.0, None, None),
        ("img/b.png", -1, None, None, None, None, None), ("img/c.png", 9, None, None, None, None, None),
    }


def boxes(spark, n=5):
    rows = [("i.png", 3, k, float(k), 1.0, float(k + 9), 20.0, None if k % 2 else 0.25, 1) for k in range(n)]
    return spark.createDataFrame(rows, "image string, frame bigint, id bigint, x1 double, y1 double, x2 double, y2 double, score double, class_id int")


def test_line_sink_round_trip(spark):
    b = boxes(spark)
    lines = annotations.to_lines(b, "id")
    back = annotations.parse_lines(lines.select("value"))
    assert {(r.x1, r.x2, r.score) for r in back.collect()} == {(r.x1, r.x2, r.score) for r in b.collect()}
    assert lines.count() == 1


def test_an_image_of_many_boxes_keeps_their_order(spark):
    b = spark.range(2500).selectExpr("id", "'i.png' AS image", "3L AS frame", "id * 7 % 2500 + 0e0 AS x1", "1e0 AS y1", "id * 7 % 2500 + 5e0 AS x2", "9e0 AS y2", "cast(null AS double) AS score")
    back = annotations.parse_lines(annotations.to_lines(b.repartition(7), "id").select("value")).orderBy("box_no").collect()
    assert [r.x1 for r in back] == [i * 7 % 2500 for i in range(2500)] and [r.box_no for r in back] == list(range(2500))


def test_long_names_and_lines(spark):
    name = "n" * (1 << 20) + "x"
    rows = annotations.parse_lines(spark.createDataFrame([(f'"{name}@3": (1, 2, 3, 4);',)], "value string")).collect()
    assert rows[0].image == name and rows[0].frame == 3 and rows[0].y2 == 4


def test_xml_round_trip(spark, tmp_path):
    out = str(tmp_path / "xml")
    annotations.write_annotations(boxes(spark), "id", out, "xml")
    rows = annotations.read_xml(spark, out).collect()
    assert {(r.image, r.frame, r.x1, r.score, r.class_id) for r in rows} == {("i.png", 3, float(k), None if k % 2 else 0.25, 1) for k in range(5)}


def run_rows(spark, runs, kind="gps"):
    d = spark.createDataFrame([(r, t, t * 2) for r in runs for t in (1, 2)], "run_id string, t_us bigint, v bigint")
    return tables.run_documents({kind: d}, "run_id", "t_us")


def exported(spark, out):
    return sorted(((r.run_id or "", r.kind, r.t_us, r.payload) for r in tables.read_runs(spark, out, "run_id").collect()), key=str)


def wanted(runs, kind="gps"):
    return sorted(((r, kind, t, f'{{"v":{t * 2}}}') for r in runs for t in (1, 2)), key=str)


def test_run_export_skips_what_is_there(spark, tmp_path):
    out = str(tmp_path / "runs")
    assert tables.read_runs(spark, out, "run_id").count() == 0
    tables.export_runs(run_rows(spark, ["a"]), "run_id", out)
    tables.export_runs(run_rows(spark, ["a", "b", "01", "x/y z"]), "run_id", out)
    assert exported(spark, out) == wanted(["a", "b", "01", "x/y z"])
    tables.export_runs(run_rows(spark, ["a"], "radar"), "run_id", out)
    assert exported(spark, out) == sorted(wanted(["a", "b", "01", "x/y z"]) + wanted(["a"], "radar"), key=str)
    assert tables.export_runs(run_rows(spark, ["a", "b"]), "run_id", out) is None
    listed = tables.export_manifest(spark, out, "run_id").collect()
    assert len(listed) == 5 and all(r.files >= 1 and r.bytes > 0 for r in listed)


def test_broken_export_is_written_again(spark, tmp_path):
    out = str(tmp_path / "runs")
    tables.export_runs(run_rows(spark, ["a"]), "run_id", out)
    broken = run_rows(spark, ["b", "c"]).withColumn("payload", F.when(F.col("run_id") == "c", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        tables.export_runs(broken, "run_id", out)
    # a batch whose files are there but whose manifest was never written
    run_rows(spark, ["b"]).write.partitionBy("run_id", "kind").option("compression", "gzip").json(f"{out}/data/batch=dead")
    assert exported(spark, out) == wanted(["a"])
    tables.export_runs(run_rows(spark, ["a", "b", "c"]), "run_id", out)
    assert exported(spark, out) == wanted(["a", "b", "c"])


def test_export_of_kinds_without_time_and_of_nameless_runs(spark, tmp_path):
    out = str(tmp_path / "runs")
    planes = spark.createDataFrame([(r, p, 0.5 * p) for r in ("a", None) for p in range(50)], "run_id string, plane bigint, d double")
    docs = tables.run_documents({"planes": planes}, "run_id", "t_us").unionByName(run_rows(spark, [""]))
    tables.export_runs(docs, "run_id", out)
    assert tables.export_runs(docs, "run_id", out) is None
    got = exported(spark, out)
    assert len(got) == 102 and {g[2] for g in got if g[1] == "planes"} == {None}
    assert [g for g in got if g[1] == "gps"] == wanted([""])


def test_track_dump_drops_lost_boxes(spark):
    text = '{"track": 4, "boxes": [{"frame": 1, "xtl": 1, "ytl": 2, "xbr": 3, "ybr": 4, "lost": 0}, {"frame": 2, "xtl": 1, "ytl": 2, "xbr": 3, "ybr": 4, "lost": 1}]}'
    rows = annotations.parse_track_dump(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.frame, r.track_id, r.x2) for r in rows] == [(1, 4, 3.0)]


def test_catalogue_names(spark):
    d = spark.createDataFrame([("/x/route1/seg_one_b_gps.out",), ("/x/route1/seg_one_b_map.out",)], "file string")
    rows = logs.catalogue(d).collect()
    assert [(r.route, r.segment, r.split, r.run_id) for r in rows] == [("route1", "seg_one", "b", "seg_one_b")]


def test_images_are_sorted_by_columns_worked_out_before(spark):
    d = spark.createDataFrame([(f"s_{p}_{n:03d}.png",) for p in (2, 1) for n in (10, 9, 100)], "image string")
    got = box_ops.image_order(d, "image")
    assert [r.image for r in got.collect()] == [f"s_{p}_{n:03d}.png" for p in (1, 2) for n in (9, 10, 100)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in line for line in plan.splitlines() if "Sort [" in line)

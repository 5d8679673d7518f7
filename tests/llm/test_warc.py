import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from wayline.llm import warc
from wayline.llm.queries import QUERIES


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def written(spark, folder, rows, **kind):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    warc.write_archives(pages, str(folder), **kind)
    return warc.read_archives(spark, str(folder), with_payload=True)


ROWS = [
    (1, "http://a/", "<p>same</p>", "x"),
    (5, "http://b/", "<p>same</p>", "x"),
    (3, "http://c/\r\nX: y", "<p>same</p>", None),
    (2, None, None, None),
    (4, "http://d/", "", None),
    (6, "http://e/é", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\nübung 🙂\n", None),
    (7, "http://f/", "long " * 300000, None),
    (2**53 + 1, "http://g/", "big id", None),
    (None, "http://h/", "no id", None),
]


def test_round_trip(spark, tmp_path):
    records = written(spark, tmp_path / "w", ROWS).cache()
    rows = {r["page_id"]: r for r in warc.resolved_records(records).collect()}
    assert len(rows) == len(ROWS)
    for i, _, html, _ in ROWS:
        assert rows[i]["payload_bytes"] == len((html or "").encode()) and rows[i]["payload_digest"] == digest(html) and rows[i]["intact"]
        refers = {1: 5, 3: 5, 2: 4}.get(i)
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", refers) if refers else ("response", None))
    kept = {r["page_id"]: r["payload"] for r in records.where("record_type = 'response'").collect()}
    assert kept == {i: html or "" for i, _, html, _ in ROWS if i not in (1, 2, 3)}


def test_files_are_plain_warc(spark, tmp_path):
    written(spark, tmp_path / "w", ROWS, file_bytes=4096).count()
    names = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    heads = []
    for f in names:
        with gzip.open(tmp_path / "w" / f) as g:
            heads += [h for h, _ in warc.parse_records(g.read())]
    assert len(heads) == len(ROWS) and len({h["warc-record-id"] for h in heads}) == len(ROWS)
    responses = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert all(h["content-type"] == "application/http; msgtype=response" for h in heads)
    assert all(h["warc-refers-to"] in responses and h["content-length"] == "0" for h in heads if h["warc-type"] == "revisit")


def test_small_payloads_stay_responses(spark, tmp_path):
    records = warc.resolved_records(written(spark, tmp_path / "w", ROWS, least_bytes=5))
    assert {r["page_id"] for r in records.where("record_type = 'revisit'").collect()} == {1, 3}


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    twice = warc.resolved_records(written(spark, tmp_path / "a", [ROWS[0], ROWS[0], ROWS[1]])).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in twice) == [(1, "revisit"), (1, "revisit"), (5, "response")]
    assert warc.resolved_records(written(spark, tmp_path / "b", [])).count() == 0


def test_many_repeated_payloads(spark, tmp_path, monkeypatch):
    wide = warc.sized_join
    monkeypatch.setattr(warc, "sized_join", lambda big, small, on: wide(big, small, on, most=0, salts=4))
    rows = ROWS + [(100 + i, "u", f"<p>{i % 7}</p>", "x") for i in range(200)]
    got = {r["page_id"]: r["refers_to"] for r in warc.resolved_records(written(spark, tmp_path / "w", rows)).collect()}
    assert len(got) == len(rows)
    last = {f"<p>{i % 7}</p>": 100 + i for i in range(200)}
    assert all(got[i] == (None if last[html] == i else last[html]) for i, _, html, _ in rows if i is not None and 100 <= i < 300)


def test_payloads_are_not_shuffled(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, payload string, payload_digest string")
    plan = warc.resolve_revisits(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_base32(spark):
    texts = ["", "a", "übung" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == {t: digest(t) for t in texts}


def test_query(spark, small):
    got = {r["page_id"]: r for r in QUERIES["op7_warc"](spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    largest = {}
    for p in pages:
        largest[p["html"]] = max(p["page_id"], largest.get(p["html"], p["page_id"]))
    for p in pages:
        want = largest[p["html"]]
        r = got[p["page_id"]]
        assert r["payload_digest"] == digest(p["html"]) and r["intact"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == p["page_id"] else ("revisit", want))

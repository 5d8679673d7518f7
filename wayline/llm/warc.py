"""WARC archives of web pages with repeated payloads written once, as revisit records.

Archives are ordinary WARC/1.1 files written by Spark into a folder that all
machines share. A response holds an HTTP message, whose body is the payload.
Reading goes by the records' own lengths and checks digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.llm.common import cut_lineage, ensure_checkpoint_dir, sized_join

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORDS = (
    "page_id string, record_type string, record_id string, refers_to_id string, target string, "
    "payload_digest string, stored_bytes long, intact boolean, payload string"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: each 10 of the 40 hexadecimal digits are 8 base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column) -> Column:
    """``<urn:uuid:...>`` from a hash of what names the record, the same on every try of a task."""
    h = F.md5(key)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``payload_digest``, ``payload_bytes`` and ``original`` (the id of the page that keeps the payload).

    Of pages with equal payloads of at least ``least_bytes`` bytes the largest
    ``page_id`` is the original; smaller payloads are all their own. Pages that
    repeat an id and its payload all are originals. A null payload is empty; a
    page without id never is an original unless no page of its payload has one.
    Only headers (digest, length, id) are shuffled, summed up before. Payloads
    that occur once need no partner, so the others' originals, one row each, are
    counted and joined: up to 100,000 are broadcast and payloads stay where they
    are; beyond that both sides are salted, so that a payload which a third of
    all pages share is spread over many tasks.
    """
    own = pages.withColumns({"payload_digest": base32_sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    repeated = cut_lineage(heads.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = sized_join(own, repeated.withColumn("shared", F.lit(True)), ["payload_digest", "payload_bytes"])
    return joined.withColumn("original", F.when(F.col("shared"), F.col("original")).otherwise(F.col("page_id"))).drop("shared")


def _one_line(value: Column) -> Column:
    """A header's value: line breaks would end the header."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def as_records(resolved: DataFrame, date: str) -> DataFrame:
    """One column ``value`` with a WARC record per page, without the two line breaks that end it.

    Responses hold an HTTP message with the payload as its body; revisits hold
    none and name the response by its record id. Headers are made anew here.
    """
    revisit = ~F.col("page_id").eqNullSafe(F.col("original"))
    http = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")))
    http = F.concat(http, F.lit(END))
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.concat_ws("|", F.col("original").cast("string"), "payload_digest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    block = F.when(revisit, "").otherwise(F.concat(http, F.col("payload")))
    return resolved.select(F.concat(F.concat_ws("\r\n", *head), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, file_bytes: int = 1 << 25, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a deduplicated archive of ``pages`` into ``folder``, in gzipped files of about ``file_bytes`` bytes before that.

    The text sink ends each record with its two line breaks, so the files are
    plain WARC/1.1. The number of records of a file follows from their mean size.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload")), F.count("*")).first()
    each = max(1, file_bytes * total[1] // max(1, (total[0] or 0) + 500 * total[1]))
    records = as_records(resolve_revisits(rows, least_bytes), date)
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, each)).text(folder)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content block of each record of an archive, by their lengths."""
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        body = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + len(END)
        if data[at - len(END) : at] != END.encode():
            raise ValueError(f"record before byte {at} has a wrong length")
        yield head, body


def http_body(block: bytes) -> bytes:
    """What follows the headers of an HTTP message; an empty block has an empty body."""
    return block.partition(END.encode())[2]


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a folder; a file is read by one task at a time, whose size the writer bounds.

    ``intact`` says whether a response's payload has the digest its header names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, block in parse_records(gzip.decompress(data)):
                    body = http_body(block)
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    page = head["x-page-id"]
                    rows.append((
                        None if page == "none" else page, kind, head["warc-record-id"], head.get("warc-refers-to"), head["warc-target-uri"], digest, len(body),
                        kind == "revisit" or base64.b32encode(hashlib.sha1(body).digest()).decode() == digest,
                        body.decode("utf-8") if with_payload and kind == "response" else None,
                    ))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInPandas(run, RECORDS).withColumn("page_id", F.col("page_id").cast("bigint"))


def resolved_records(records: DataFrame) -> DataFrame:
    """Every record with the size and page of its payload; revisits get them from the response they refer to.

    Headers are shuffled by record id, one row per response: a response that many
    revisits name is a skewed key on the revisits' side only.
    """
    heads = cut_lineage(records.select("page_id", "record_type", "record_id", "refers_to_id", "payload_digest", "stored_bytes", "intact"))
    own = heads.where("record_type = 'response'")
    sources = own.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("stored_bytes").alias("payload_bytes"))
    back = heads.where("record_type = 'revisit'").join(sources, "refers_to_id", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    first = own.select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "intact")
    return first.unionByName(back.select(*names))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def _base32_sql(digest: str) -> str:
    """32 digits from the 40 hexadecimal ones: 8 from each 10."""
    digits = [
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr({digest}, {10 * part + 1}, 10))::BIGINT >> {35 - 5 * k}) % 32 + 1, 1)" for part in range(4) for k in range(8)
    ]
    return " || ".join(digits)


#: the query's result in DuckDB, for tables with one row per page
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT html, max(page_id) AS original FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, {_base32_sql("digest")} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to, TRUE AS intact
FROM p JOIN first USING (html)
"""

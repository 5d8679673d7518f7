"""Exact duplicates by content-defined chunks.

A text is cut where the bytes themselves say so, so equal stretches of different
texts give equal chunks. Chunks are deduplicated into a store, and their
identifiers are verified there: an identifier stands for one content only. A
text is then a recipe, the ordered list of its chunks' identifiers, and texts are
equal exactly when their recipes are. Contents move once, as distinct chunks;
everything after that moves recipes, about a fortieth of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from wayline.llm.common import cut_lineage, sized_join

#: bytes that decide whether a chunk ends behind them
WINDOW = 32
#: bytes of an identifier; wider ones are taken when a store shows two contents under one
ID_BYTES = 16
#: recipes of repeated texts of at most so many bytes together are broadcast
BROADCAST_BYTES = 4 << 20

#: a random-looking number for each byte value
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "big") for b in range(256)], np.uint32)


def normalise(text: str | None) -> bytes:
    """UTF-8 of ``text`` with each stretch of ASCII white space as one space; null is empty."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[:1].isspace() else b"") + b" ".join(words) + (b" " if data[-1:].isspace() else b"")


def _marks(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions behind whose ``WINDOW`` bytes a chunk may end, one in 2**``bits``; a rolling sum by doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def cut(data: bytes, least: int = 128, bits: int = 9, most: int = 8192, segment: int = 1 << 22) -> list[bytes]:
    """Chunks of ``least`` to ``most`` bytes whose ends follow from the content; only the last one may be shorter.

    The bytes are looked at ``segment`` by ``segment``, so a text of any length
    needs bounded memory beside itself.
    """
    if least < WINDOW:
        raise ValueError("a chunk has to be as long as the window at least")
    raw, n, last, out = np.frombuffer(data, np.uint8), len(data), 0, []
    for at in range(0, n, segment):
        begin = max(0, at - WINDOW)
        for mark in (_marks(raw[begin : at + segment], bits) + begin).tolist():
            while mark - last > most:
                out.append(data[last : last + most])
                last += most
            if mark - last >= least and mark > at:
                out.append(data[last:mark])
                last = mark
    while last < n:
        out.append(data[last : last + most])
        last += most
    return out


def identifier(chunk: bytes, size: int) -> bytes:
    """``size`` bytes of a chunk's hash; wider identifiers begin with the narrower ones."""
    return b"".join(xxhash.xxh3_128_digest(chunk, seed) for seed in range(-(-size // 16)))[:size]


def _recipe_column(text, id_bytes: int, cutting: dict):
    @F.pandas_udf("recipe array<binary>, text_sha256 string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            clean = [normalise(t) for t in s]
            yield pd.DataFrame({
                "recipe": [[identifier(c, id_bytes) for c in cut(t, **cutting)] for t in clean],
                "text_sha256": [hashlib.sha256(t).hexdigest() for t in clean],
            })

    return run(text)


def recipes(docs: DataFrame, ident: str = "doc_id", text: str = "text", id_bytes: int = ID_BYTES, **cutting) -> DataFrame:
    """``ident``, ``recipe`` (identifiers in order) and ``text_sha256`` of each normalised text, a row per input row."""
    return docs.select(F.col(ident).alias(ident), _recipe_column(F.col(text), id_bytes, cutting).alias("_r")).select(ident, "_r.*")


def chunk_store(docs: DataFrame, text: str = "text", id_bytes: int = ID_BYTES, frame_bytes: int = 1 << 22, **cutting) -> DataFrame:
    """``chunk_id``, ``chunk`` (bytes) and ``n`` (occurrences): the distinct chunks of all texts.

    Copies are merged before they are shuffled, so a chunk that most texts share
    is one row a task. Tasks pass on frames of about ``frame_bytes`` bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[bytes, int] = {}
            size = 0
            for t in batch["text"]:
                for chunk in cut(normalise(t), **cutting):
                    if chunk not in found:
                        found[chunk] = 0
                        size += len(chunk)
                    found[chunk] += 1
                    if size >= frame_bytes:
                        yield _frame(found)
                        found, size = {}, 0
            yield _frame(found)

    def _frame(found: dict[bytes, int]) -> pd.DataFrame:
        return pd.DataFrame({"chunk_id": [identifier(c, id_bytes) for c in found], "chunk": list(found), "n": list(found.values())})

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInPandas(run, "chunk_id binary, chunk binary, n long")
    return rows.groupBy("chunk_id", "chunk").agg(F.sum("n").alias("n"))


def ambiguous_ids(store: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content of a store."""
    return store.groupBy("chunk_id").agg(F.count("*").alias("contents")).where("contents > 1")


def verified_width(docs: DataFrame, text: str = "text", id_bytes: int = ID_BYTES, **cutting) -> int:
    """Bytes an identifier needs so that each one of all chunks of ``docs`` has one content: contents are compared, not trusted."""
    while not ambiguous_ids(chunk_store(docs, text, id_bytes, **cutting)).isEmpty():
        id_bytes += 8
    return id_bytes


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", id_bytes: int = ID_BYTES, **cutting) -> DataFrame:
    """One row per document: ``ident``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised forms are (:func:`normalise`); null and
    empty texts are equal to one another, white space alone is one space. Of
    equal texts the row with the smallest ``ident`` stays; rows without one come
    last, and of rows that repeat the smallest one any single row stays, so each
    group keeps exactly one. Other columns are not looked at. Equal recipes are
    counted with partial aggregation; only recipes of two and more rows are
    joined back, with salted keys where they are too many to broadcast.
    """
    id_bytes = verified_width(docs, text, id_bytes, **cutting)
    rows = recipes(docs, ident, text, id_bytes, **cutting).withColumnRenamed(ident, "_id")
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    groups = rows.groupBy("recipe").agg(F.min(first).alias("_first"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = cut_lineage(groups.select("recipe", F.col("_first._id").alias("_keep"), F.col("_first._row").alias("_stays"), "group_size"))
    held = groups.agg(F.sum(id_bytes * F.size("recipe") + 100)).first()[0] or 0
    joined = rows.join(F.broadcast(groups), "recipe", "left") if held <= BROADCAST_BYTES else sized_join(rows, groups, ["recipe"], most=0)
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("_id").alias(ident),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_stays"))).alias("kept"),
        "text_sha256",
    )


#: the query's result in DuckDB, for tables with one row per document
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (t)
"""

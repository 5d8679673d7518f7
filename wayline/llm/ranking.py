"""Ranked lexical search for many items at once, with the work that items share done once.

Items are sums over their terms, so two items with common terms have a common
partial sum in every document. Term sets that several items share are mined
first and become nodes of a graph: a leaf is a term, an inner node the sum of
two others, an item the sum of the few nodes that are left of it. Each task
works through its documents in blocks: a node's accumulator (one number per
document of the block) is made once, from those below it, for all items that
use it. Only each item's best documents of a task are passed on.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wayline.llm.common import ensure_checkpoint_dir

#: bytes of accumulators that a task holds at a time
BLOCK_BYTES = 32 << 20

#: letters and digits of ASCII in lower case and all bytes beyond ASCII stay, the rest separates terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text: maximal stretches of ASCII letters, digits and other characters beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split() if text else []


class SharedSums:
    """Sums of ``items`` (lists of leaf numbers, repeats included) as a graph of shared partial sums.

    ``pairs[k]`` are the two numbers that node ``leaves + k`` adds; ``items[i]``
    the numbers item ``i`` adds in the end. Leaves are put in order of how many
    items hold them, equal sets of items side by side; then the pair of
    neighbours that occurs most often over all items becomes a node, until no
    pair occurs twice. Time goes with the total length of the items touched.
    """

    def __init__(self, items: Iterable[Iterable[int]], leaves: int) -> None:
        raw = [list(x) for x in items]
        holders: defaultdict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(raw):
            for leaf in set(item):
                holders[leaf].append(i)
        self.leaves = leaves
        self.items = [sorted(x, key=lambda leaf: (-len(holders[leaf]), holders[leaf], leaf)) for x in raw]
        self.pairs: list[tuple[int, int]] = []
        users: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)
        total: Counter = Counter()

        def note(i: int, sign: int) -> set[tuple[int, int]]:
            found = Counter(self._neighbours(self.items[i]))
            for pair, n in found.items():
                total[pair] += sign * n
                users[pair][i] += sign * n
                if not users[pair][i]:
                    del users[pair][i]
            return set(found)

        for i in range(len(raw)):
            note(i, 1)
        heap = [(-n, p) for p, n in total.items() if n > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            if total[pair] != -n:  # outdated; an entry with the present count was pushed when it changed
                continue
            node = leaves + len(self.pairs)
            self.pairs.append(pair)
            changed: set[tuple[int, int]] = set()
            for i in list(users[pair]):
                changed |= note(i, -1)
                self.items[i] = self._replaced(self.items[i], pair, node)
                changed |= note(i, 1)
            for p in changed:
                if total[p] > 1:
                    heapq.heappush(heap, (-total[p], p))

    @staticmethod
    def _neighbours(seq: list[int]) -> Iterator[tuple[int, int]]:
        """Neighbouring pairs, a pair of equals counted without overlap."""
        skip = False
        for a, b in zip(seq, seq[1:], strict=False):
            skip = a == b and not skip
            if a != b or skip:
                yield a, b

    @staticmethod
    def _replaced(seq: list[int], pair: tuple[int, int], node: int) -> list[int]:
        out, k = [], 0
        while k < len(seq):
            if k + 1 < len(seq) and (seq[k], seq[k + 1]) == pair:
                out.append(node)
                k += 2
            else:
                out.append(seq[k])
                k += 1
        return out

    @property
    def additions(self) -> int:
        """Additions of whole accumulators that one block of documents takes."""
        return len(self.pairs) + sum(max(0, len(x) - 1) for x in self.items)

    def evaluate(self, leaf_rows: np.ndarray) -> np.ndarray:
        """Item sums from accumulators of the leaves (a row each, a column per document)."""
        acc = np.empty((self.leaves + len(self.pairs), leaf_rows.shape[1]), np.int64)
        acc[: self.leaves] = leaf_rows
        for k, (a, b) in enumerate(self.pairs, self.leaves):
            np.add(acc[a], acc[b], out=acc[k])
        out = np.zeros((len(self.items), leaf_rows.shape[1]), np.int64)
        for i, parts in enumerate(self.items):
            for p in parts:
                out[i] += acc[p]
        return out


def _forward_index(docs: DataFrame, ident: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (terms of the text) and the numbers and counts of the terms of ``vocabulary`` in it, as a written table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            sizes, numbers, counts = [], [], []
            for t in batch["text"]:
                words = terms_of(t)
                found = Counter([known[w] for w in words if w in known])
                sizes.append(len(words))
                numbers.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": np.array(sizes, np.int64), "terms": numbers, "tfs": counts})

    rows = docs.select(F.col(ident).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = f"{ensure_checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    rows.mapInPandas(run, "doc_id string, n long, terms array<int>, tfs array<long>").write.parquet(path)
    return spark.read.parquet(path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


class _Best:
    """The ``k`` best documents of each item met so far: highest score, then smallest id, rows without an id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.items = k, items
        self.floor = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no id, id

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        new = [item, scores[item, doc], no_id[doc], ids[doc]]
        item, score, none, ident = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((ident, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.items))
        keep = np.arange(len(item)) - first[item] < self.k
        order = order[keep]
        self.rows = [item[keep], score[order], none[order], ident[order]]
        full = np.bincount(self.rows[0], minlength=self.items) >= self.k
        last = np.searchsorted(self.rows[0], np.arange(self.items), side="right") - 1
        self.floor = np.where(full, self.rows[1][last] if len(last) and len(self.rows[1]) else 1, 1)


def _rank_block(index: DataFrame, items: list[tuple[object, Counter]], vocabulary: dict[bytes, int], stats: tuple[int, int], first: int, k: int) -> DataFrame:
    """Each task's best ``k`` documents of the ``items`` of a block, numbered from ``first``."""
    spark = index.sparkSession
    n_docs, n_terms = stats
    weight = np.zeros(len(vocabulary), np.int64)
    for row in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weight[row["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
    graph = SharedSums(([vocabulary[t] for t, n in terms.items() for _ in range(n)] for _, terms in items), len(vocabulary))
    shared = spark.sparkContext.broadcast((graph, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, w = shared.value
        best = _Best(len(sums.items), k)
        block = max(1, BLOCK_BYTES // (8 * max(1, 2 * sums.leaves + len(sums.pairs) + len(sums.items))))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, n, terms, tfs = (part.column(c) for c in ("doc_id", "n", "terms", "tfs"))
                size = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), size)
                number, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                m = 75 + (25 * n.to_numpy() * n_docs) // max(1, n_terms)
                leaves = np.zeros((sums.leaves, part.num_rows), np.int64)
                leaves[number, doc] = w[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
                best.add(sums.evaluate(leaves), none, ids.fill_null(0).to_numpy())
        item, score, none, ident = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item + first), pa.array(score), pa.array(ident, mask=none.astype(bool))], names=["item_no", "score", "doc_id"]
        )

    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_no long, score long, doc_id long")


def rank_items(items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", ident: str = "doc_id", text: str = "text", block_items: int = 2000) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Scores are sums over an item's terms, repeats included, of a weight from the
    number of documents with the term times a saturating share of its count, all
    in 64-bit integers but for the logarithm in the weight. Every row of
    ``items`` is an item of its own, so rows that repeat an id are ranked each;
    every row of ``docs`` is a document. Null and empty texts have no terms: such
    items have no rows, such documents are never found and not counted. Scores
    of 0 are left out. Equal scores go by ascending id, rows without one last.

    Items are taken ``block_items`` at a time, so the terms, weights and graph
    that tasks get are bounded whatever the size of ``items``; every block reads
    all documents once and writes their counts of the block's terms.
    """
    spark = docs.sparkSession
    rows = ((r[0], Counter(terms_of(r[1]))) for r in items.select(F.col(item_id), F.col(item_text)).toLocalIterator())
    kind = items.schema[item_id].dataType.simpleString()
    found, names, first = [], [], 0
    while block := list(islice(rows, block_items)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        index = _forward_index(docs, ident, text, vocabulary)
        stats = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found.append(_rank_block(index, block, vocabulary, (stats[0], stats[1]), first, k))
        names.append(_named(spark, [(first + i, x[0]) for i, x in enumerate(block)], kind))
        first += len(block)
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    by_item = W.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    parts = [b.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k).join(F.broadcast(n), "item_no") for b, n in zip(found, names, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "rank", "doc_id", "score")


def _named(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """Ids of a block's items by their numbers; at most ``block_items`` rows."""
    return spark.createDataFrame(rows, f"item_no long, item_id {kind}")


#: the query's result in DuckDB
RANK_SQL = r"""
WITH docs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
queries AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM queries GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM docs WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(c.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus c GROUP BY term),
parts AS (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c.docs) // c.terms))) AS part
          FROM tfs t JOIN sizes USING (doc_id) JOIN weights USING (term), corpus c),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

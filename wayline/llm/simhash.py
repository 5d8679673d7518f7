"""Near-duplicate texts by SimHash fingerprints and a self-join of a binary trie over them.

The trie's leaves are the distinct fingerprints. Pairs of nodes of one depth are
traversed together from the root; differing bits add up on the way and a pair
goes as soon as it has more than the allowed number. The upper part of the
traversal is a chain of small joins that stops where a pair of nodes has little
enough below it; the lower part runs inside tasks, a pair of nodes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.common import cut_lineage, free_name
from wayline.operators.clustering import connected_components

BITS = 64
#: levels of the trie that one join goes down
STEP = 4
#: leaf pairs below a pair of nodes up to which a task takes it over
WORK = 1 << 22
#: node pairs a task looks at together
TOGETHER = 1 << 20
#: edges that one task may join; 16 bytes each
AT_ONCE = 500_000
#: leaf pairs below a pair of nodes that are compared at once; more of them where the budget is wide
FEW = 6
SMALL = 4096


def shingle_hashes(words: list[bytes], size: int, at_once: int = 1 << 16) -> Iterator[np.ndarray]:
    """Big-endian bytes (n, 8) of the XXH64 (seed 42) of all runs of ``size`` words, in parts of bounded length."""
    import xxhash

    if len(words) < size:
        words, size = [b" ".join(words)], 1
    for at in range(0, len(words) - size + 1, at_once):
        part = words[at : at + at_once + size - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if size > 1 else part
        yield np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(42))), np.uint8).reshape(-1, 8)


def text_fingerprint(text: str | None, size: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    ones, n = np.zeros(BITS, np.int64), 0
    for part in shingle_hashes(words, size):
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, size: int = 3) -> Column:
    """SimHash of the whole text as a bigint; repeated shingles count as often as they occur."""

    @F.pandas_udf("long")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([text_fingerprint(t, size) for t in s], dtype="int64")

    return run(text)


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i`` and ``j`` in place; ``root`` points at the smallest member known."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _upper_half(leaves: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """Where the right child of each node begins; a node is a range of the sorted leaves with ``depth`` bits alike."""
    left = np.uint64(BITS - depth - 1)
    return np.searchsorted(leaves, ((leaves[low] >> left) | np.uint64(1)) << left)


def _walk(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, most: int, enough: int = FEW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in ``a``, j in ``b``) of the leaf pairs within ``most`` bits below two nodes, in parts.

    The nodes' prefixes of ``depth`` bits differ in ``used`` bits; their leaves
    ``a`` and ``b`` are sorted and distinct. Without ``b`` the node is joined with
    itself, and each pair comes once. ``enough`` leaf pairs or fewer are compared
    at once.
    """
    own = b is None
    b = a if own else b
    one = np.zeros(1, np.int64)
    stack = [(depth, one, one + len(a), one, one + len(b), one + used, np.array([own]))]
    while stack:
        depth, alo, ahi, blo, bhi, bits, same = stack.pop()
        if len(alo) > TOGETHER:
            half = len(alo) // 2
            for part in (slice(None, half), slice(half, None)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, bits, same))))
            continue
        pairs = (ahi - alo) * (bhi - blo)
        few = pairs <= enough
        if few.any():
            n, wide = pairs[few], (bhi - blo)[few]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(wide, n)
            i, j = np.repeat(alo[few], n) + at // wide, np.repeat(blo[few], n) + at % wide
            near = (np.bitwise_count(a[i] ^ b[j]) <= most) & ~(np.repeat(same[few], n) & (i >= j))
            yield i[near], j[near]
        rest = ~few
        if not rest.any():
            continue
        alo, ahi, blo, bhi, bits, same = (x[rest] for x in (alo, ahi, blo, bhi, bits, same))
        amid = np.clip(_upper_half(a, alo, depth), alo, ahi)
        bmid = np.clip(_upper_half(b, blo, depth), blo, bhi)
        below = [
            (alo, amid, blo, bmid, bits, same),
            (amid, ahi, bmid, bhi, bits, same),
            (alo, amid, bmid, bhi, bits + 1, np.zeros_like(same)),
            # a node paired with itself has its mixed children once only
            *([] if same.all() else [tuple(x[~same] for x in (amid, ahi, blo, bmid, bits + 1, same))]),
        ]
        merged = [np.concatenate(x) for x in zip(*below, strict=True)]
        # a side without leaves, or over the budget; a single leaf is no pair with itself
        ok = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= most) & ~(merged[5] & (merged[1] - merged[0] == 1))
        if ok.any():
            stack.append((depth + 1, *(x[ok] for x in merged)))


def trie_components(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, most: int) -> np.ndarray:
    """Components among the leaves below two nodes: for each leaf (those of ``a``, then of ``b``) the smallest position it is linked to."""
    shift = 0 if b is None else len(a)
    root = np.arange(len(a) + (0 if b is None else len(b)))
    for i, j in _walk(a, b, depth, used, most):
        _unite(root, i, j + shift)
    return root


def trie_pairs(leaves: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within ``most`` bits among a few sorted distinct leaves."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_walk(leaves, None, 0, 0, most, SMALL)]
    return np.concatenate([i for i, _ in parts]), np.concatenate([j for _, j in parts])


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("bigint")


def node_pairs(leaves: DataFrame, most: int, work: int = WORK) -> list[tuple[int, DataFrame]]:
    """Upper part of the traversal: for each depth the pairs of nodes that are left to tasks.

    ``leaves`` has one column ``fp`` of distinct fingerprints. A pair is left to
    a task when at most ``work`` leaf pairs lie below it; other pairs go down
    ``STEP`` levels by a join with both nodes' children.
    """
    total = leaves.count()
    top = leaves.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("used"), F.lit(total * total).cast("double").alias("size")
    )
    pairs = cut_lineage(top)  # written, as a join on a constant would become a product of all partitions
    found, depth = [], 0
    while total:
        last = depth + STEP >= BITS
        found.append((depth, pairs if last else pairs.where(F.col("size") <= work)))
        wide = pairs.where(F.col("size") > work)
        if last or wide.isEmpty():
            return found
        depth += STEP
        child = _prefix(F.col("fp"), depth)
        nodes = leaves.groupBy(child.alias("n")).agg(F.count("*").cast("double").alias("c"))
        nodes = cut_lineage(nodes.withColumn("p", F.shiftright("n", STEP)))
        left = nodes.select(F.col("p").alias("a"), F.col("n").alias("a2"), F.col("c").alias("ca"))
        right = nodes.select(F.col("p").alias("b"), F.col("n").alias("b2"), F.col("c").alias("cb"))
        pairs = (
            wide.join(left, "a")
            .join(right, "b")
            .withColumn("used", F.col("used") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << STEP) - 1))))
            .where((F.col("used") <= most) & (F.col("a2") <= F.col("b2")))
            .select(F.col("a2").alias("a"), F.col("b2").alias("b"), "used", (F.col("ca") * F.col("cb")).alias("size"))
        )
        pairs = cut_lineage(pairs)
    return found


def trie_links(leaves: DataFrame, most: int, work: int = WORK) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the distinct fingerprints ``fp`` within ``most`` bits of each other.

    Each task returns a spanning forest of its links, not all of them.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        depth, a, b = key
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        side = rows["side"].to_numpy()
        left, right = np.sort(fps[side == 0]), np.sort(fps[side == 1]) if a != b else None
        root = trie_components(left, right, int(depth), int(rows["used"].iloc[0]), most)
        names = (left if right is None else np.concatenate([left, right])).view(np.int64)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": names[linked], "b": names[root[linked]]})

    parts = []
    for depth, pairs in node_pairs(leaves, most, work):
        ends = F.array(F.struct(F.col("a").alias("n"), F.lit(0).alias("side")), F.struct(F.col("b").alias("n"), F.lit(1).alias("side")))
        ends = F.filter(ends, lambda e: (F.col("a") != F.col("b")) | (e["side"] == 0))
        sides = pairs.select("a", "b", "used", F.explode(ends).alias("e")).select("a", "b", "used", "e.n", "e.side")
        below = leaves.withColumn("n", _prefix(F.col("fp"), depth)).join(sides, "n")
        parts.append(below.select(F.lit(depth).alias("depth"), "a", "b", "used", "side", "fp"))
    if not parts:
        return leaves.sparkSession.createDataFrame([], "a long, b long")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("depth", "a", "b").applyInPandas(run, "a long, b long")


def link_components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node on an edge.

    The forests of all tasks together are mostly short. They are counted: up to
    ``at_once`` edges go through one task; more are contracted in rounds over
    all executors, with the same result.
    """
    edges = cut_lineage(edges)
    if edges.count() > at_once:
        return connected_components(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        both = pd.concat(parts)[["a", "b"]].to_numpy(np.int64)
        nodes, at = np.unique(both, return_inverse=True)
        at = at.reshape(-1, 2)
        root = np.arange(len(nodes))
        _unite(root, at[:, 0], at[:, 1])
        yield pd.DataFrame({"node": nodes, "root": nodes[root]})

    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def near_groups(prints: DataFrame, most: int = 2) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the group) and ``component_id`` (smallest id reachable) of each
    distinct fingerprint of checkpointed ``prints`` (``id``, ``fp``).

    Rows with the same fingerprint are one leaf, so copies never meet in pairs.
    """
    leaves = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = link_components(trie_links(leaves.select("fp"), most))
    named = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut_lineage(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 3, most: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) and ``component_id`` of each row.

    Null texts count as empty; texts without words have fingerprint zero and are
    linked like any other. Null ids never name a component unless all of it are null.
    """
    prints = cut_lineage(docs.select(F.col(ident).alias("id"), fingerprint(F.col(text), size).alias("fp")))
    named = prints.join(near_groups(prints, most), "fp", "left")
    return named.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 3, most: int = 2) -> DataFrame:
    """The row with the smallest id of each group of near duplicates, with all columns of ``docs``.

    Rows that repeat an id and its text are one document.
    """
    i, h, key, code = (free_name(docs, n) for n in ("_id", "_hash", "_i", "_h"))
    marked = docs.withColumns({i: F.col(ident), h: F.xxhash64(text)})
    prints = cut_lineage(marked.select(F.col(i).alias("id"), F.col(h).alias("hash"), fingerprint(F.col(text), size).alias("fp")))
    named = prints.join(near_groups(prints, most), "fp", "left").where(F.col("id").eqNullSafe(F.col("component_id")))
    # copies of the smallest id, and rows that all lack one, leave the choice to the hash
    one = named.groupBy("root").agg(F.min("component_id").alias(key), F.min("hash").alias(code))
    stays = one.select(key, code)
    kept = marked.join(stays, F.col(i).eqNullSafe(F.col(key)) & (F.col(h) == F.col(code)), "left_semi")
    return kept.dropDuplicates([i, h]).select(*docs.columns)

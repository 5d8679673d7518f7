"""Texts alike by their word shingles: SimHash candidates from tries in small forests, then an exact check.

At a similarity of 0.8 fingerprints differ in some ten bits, too many to prune a
trie over all texts. So texts are first put into forests by shared minima of
their shingles' hashes, and a binary trie is joined with itself in each forest.
The links that hold a forest together, nearest first, are checked exactly on the
shingles. Forests whose leaves are not all of one group by then are gone through
once more: every candidate pair in them between different groups is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.common import cut_lineage, free_name, sized_join, small_batches
from wayline.llm.simhash import link_components, shingle_hashes, trie_pairs

#: forests a text stands in; texts of similarity 0.8 share none with a chance of 0.2 to this power
FORESTS = 8
#: largest forest one task joins; larger ones are parted at first, then compared block by block
MOST = 512
#: minima that estimate the similarity of a candidate pair, to take the likeliest links first
SKETCH = 64
#: keys of 16 bytes that may be broadcast once they have been counted
BROADCAST_KEYS = 1_000_000
#: times that a forest is spanned at first, each time by links not taken before
SPANS = 3


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted; empty without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate([p.copy().view(">u8").reshape(-1) for p in shingle_hashes(words, size)]).astype(np.uint64))


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: Column, size: int, forests: int = FORESTS) -> Column:
    """Struct ``fp`` (SimHash of the set of shingles), ``mins`` and ``sketch``: least products of the hashes with fixed odd numbers, and ``size`` of the set.

    The first products are the forests' keys, the upper halves of others the sketch.
    """
    odd = _multipliers(forests + SKETCH)

    @F.pandas_udf("fp long, mins array<long>, sketch array<int>, size long")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            rows = []
            for t in s:
                h = shingle_set(t, size)
                if not len(h):
                    rows.append((0, np.zeros(forests, np.int64), np.zeros(SKETCH, np.int32), 0))
                    continue
                ones = sum(np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for at in range(0, len(h), 65536))
                fp = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)
                least = np.min([(h[at : at + 8192, None] * odd).min(0) for at in range(0, len(h), 8192)], axis=0)
                rows.append((fp, least[:forests].view(np.int64), (least[forests:] >> np.uint64(32)).astype(np.uint32).view(np.int32), len(h)))
            yield pd.DataFrame(rows, columns=["fp", "mins", "sketch", "size"])

    return run(text)


def shingles(text: Column, size: int) -> Column:
    """The set of shingles as an array of the upper halves of their hashes, which are enough within a pair of texts."""

    @F.pandas_udf("array<int>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([np.unique(shingle_set(t, size) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in s], dtype="object")

    return run(text)


def spanning_links(fps: np.ndarray, sketches: np.ndarray, most: int, spans: int = SPANS) -> list[tuple[int, int]]:
    """Links within ``most`` bits that connect all that such links connect, likeliest first by the sketches, ``spans`` times over."""
    order = np.argsort(fps, kind="stable")
    different, first = np.unique(fps[order], return_index=True)
    place = order[first]
    out = [(int(place[k]), a) for a, k in enumerate(np.searchsorted(different, fps)) if place[k] != a]
    i, j = (place[x] for x in trie_pairs(different, most))
    agree = np.concatenate([(sketches[i[at : at + 4096]] == sketches[j[at : at + 4096]]).sum(1) for at in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
    order = np.lexsort([np.bitwise_count(fps[i] ^ fps[j]), -agree])
    left = list(zip(i[order].tolist(), j[order].tolist(), strict=True))
    for _ in range(spans):
        root = list(range(len(fps)))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        after = []
        for a, b in left:
            x, y = find(a), find(b)
            if x == y:
                after.append((a, b))
                continue
            root[max(x, y)] = min(x, y)
            out.append((a, b))
        left = after
    return out


def _in_forests(leaves: DataFrame, forests: int) -> DataFrame:
    """A row for each forest ``k`` of a leaf, with the forest's ``key``."""
    rows = leaves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(forests - 1))))
    return rows.withColumn("key", F.xxhash64("k", F.element_at("mins", F.col("k") + 1)))


def candidate_links(leaves: DataFrame, most: int, forests: int = FORESTS, largest: int = MOST) -> DataFrame:
    """Links ``a``, ``b`` between leaves (``leaf``, ``fp``, ``mins``, ``sketch``) that share a forest and differ in at most ``most`` bits.

    These are the likely links, not all. A forest of more than ``largest`` leaves
    is parted by the next minimum, and again; leaves that agree in all minima and
    are still too many are linked to the smallest of them. What this leaves open
    is for :func:`open_links`.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["leaf"].to_numpy(np.int64)
        order = np.argsort(ids)
        links = spanning_links(rows["fp"].to_numpy(np.int64)[order].view(np.uint64), np.stack(rows["sketch"].to_list())[order], most)
        at = ids[order]
        return pd.DataFrame({"a": [at[i] for i, _ in links], "b": [at[j] for _, j in links]}, dtype="int64")

    k = F.col("k")
    sketches = leaves.select("leaf", "sketch")
    rows = _in_forests(leaves.select("leaf", "fp", "mins"), forests)
    parts = []
    for depth in range(1, forests + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("leaf").alias("least")).where("n > 1")
        rows = cut_lineage(rows.join(sizes, "key"))
        parts.append(rows.where(F.col("n") <= largest).join(sketches, "leaf").select("key", "leaf", "fp", "sketch").groupBy("key").applyInPandas(run, "a long, b long"))
        rest = rows.where(F.col("n") > largest)
        if rest.isEmpty():
            break
        if depth == forests:
            parts.append(rest.where("leaf <> least").select(F.col("least").alias("a"), F.col("leaf").alias("b")))
        following = F.element_at("mins", (k + depth) % forests + 1)
        rows = rest.select("leaf", "fp", "mins", "k", F.xxhash64("key", following).alias("key"))
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(rows: pd.DataFrame, most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of ``rows`` between different roots, within ``most`` bits and of sizes that allow ``similarity``; and their bits.

    With two blocks in ``rows`` the pairs go from one to the other, with one they lie inside.
    """
    fps, root, size, block = (rows[c].to_numpy(np.int64) for c in ("fp", "root", "size", "block"))
    own = (block == block[0]).all()
    left = np.flatnonzero(block == block[0])
    right = left if own else np.flatnonzero(block != block[0])
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(left), MOST):
        i, j = left[at : at + MOST, None], right[None, :]
        ok = (np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64)) <= most) & (root[i] != root[j])
        ok &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        x, y = np.nonzero(ok & (i < j) if own else ok)
        parts.append((left[at + x], right[y]))
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    return i, j, np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64))


def _blocks(rows: DataFrame, largest: int) -> DataFrame:
    """Rows of forests as members of pairs ``i``, ``j`` of blocks of about ``largest`` leaves; a block's pair with itself stands for the pairs inside.

    A group of over ``largest`` leaves of a forest has blocks of its own, which
    are not paired with each other, so what is one group already is never compared.
    """
    small = rows.where(F.col("n") <= largest).withColumns({"own": F.lit(None).cast("bigint"), "block": F.lit(0).cast("bigint")})
    big = rows.where(F.col("n") > largest)
    counts = cut_lineage(big.groupBy("key", "root").agg(F.count("*").alias("c")).withColumn("alone", F.col("c") > largest))
    rest = cut_lineage(counts.groupBy("key").agg(F.sum(F.when(~F.col("alone"), F.col("c")).otherwise(0)).alias("rest")))
    big = sized_join(sized_join(big, cut_lineage(counts.where("alone").select("key", "root", "c")), ["key", "root"]), rest, ["key"])
    slots = F.ceil(F.coalesce("c", "rest") / largest)
    big = big.withColumn("own", F.when(F.col("c").isNotNull(), F.col("root")))
    big = big.withColumn("block", F.xxhash64(F.coalesce("own", F.lit(0)), F.col("c").isNull(), F.pmod(F.xxhash64("leaf"), slots)))
    columns = ["key", "leaf", "fp", "size", "root", "own", "block"]
    rows = cut_lineage(small.select(columns).unionByName(big.select(columns)))
    blocks = cut_lineage(rows.groupBy("key", "block").agg(F.first("own").alias("own")))
    other = blocks.select("key", F.col("block").alias("j"), F.col("own").alias("other"))
    one = F.coalesce(F.col("own") == F.col("other"), F.lit(False))
    pairs = blocks.withColumnRenamed("block", "i").join(other, "key").where((F.col("i") <= F.col("j")) & ~one)
    ends = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return rows.join(ends, ["key", "block"]).select("key", "i", "j", "block", "leaf", "fp", "size", "root")


def open_links(leaves: DataFrame, sets_of, most: int, similarity: float, forests: int = FORESTS, largest: int = MOST) -> DataFrame:
    """Checked links ``a``, ``b`` that connect all that candidates between different ``root`` connect.

    ``leaves`` has ``leaf``, ``fp``, ``mins``, ``size`` and ``root``; ``sets_of``
    gives ``leaf`` and ``set`` for a frame of leaves. A candidate shares a forest,
    whatever the size of the forest, and differs in at most ``most`` bits. Each is
    checked unless checked links connect its ends already.
    """

    def asked(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _apart(rows, most, similarity)
        return rows.iloc[np.unique(np.concatenate([i, j]))]

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, bits = _apart(rows, most, similarity)
        order = np.argsort(bits, kind="stable")
        _, group = np.unique(rows["root"].to_numpy(np.int64), return_inverse=True)
        root, sets, names = list(range(len(rows))), rows["set"].to_list(), rows["leaf"].to_numpy(np.int64)
        out = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = find(group[a]), find(group[b])
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                root[max(x, y)] = min(x, y)
                out.append((names[a], names[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = _in_forests(leaves, forests).select("key", "leaf", "fp", "size", "root")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("last"))
    sizes = cut_lineage(sizes.where("least < last").select("key", "n"))
    rows = cut_lineage(sized_join(rows, sizes, ["key"], "inner"))
    members = _blocks(rows, largest)
    found = cut_lineage(members.groupBy("key", "i", "j").applyInPandas(asked, members.schema))
    sets = cut_lineage(sets_of(found.select("leaf").distinct()))
    return found.join(sets, "leaf").groupBy("key", "i", "j").applyInPandas(check, "a long, b long").distinct()


def similar_groups(docs: DataFrame, ident: str, text: str, size: int = 5, similarity: float = 0.8, most: int = 24) -> DataFrame:
    """``id``, ``hash`` of the text and ``root`` (a leaf that names the group) of each row.

    ``most`` is the number of differing bits up to which a pair is a candidate:
    ten are expected at a similarity of 0.8, more come by chance in short texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    prints = cut_lineage(rows.select("id", "hash", signature(F.col("text"), size).alias("s")).select("id", "hash", F.xxhash64("s.fp", "s.mins", "s.sketch").alias("leaf"), "s.*"))
    leaves = cut_lineage(prints.groupBy("leaf").agg(*[F.first(c).alias(c) for c in ("fp", "mins", "sketch", "size")], F.min("hash").alias("hash")))
    links = cut_lineage(candidate_links(leaves.select("leaf", "fp", "mins", "sketch"), most))

    def sets_of(asked: DataFrame) -> DataFrame:
        # one text of each leaf, with its shingles
        asked = cut_lineage(asked.join(leaves.select("leaf", "hash"), "leaf"))
        texts = rows.join(_sized(asked.select("hash").distinct()), "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text"))
        return asked.join(texts, "hash").select("leaf", shingles(F.col("text"), size).alias("set"))

    sets = cut_lineage(sets_of(links.select(F.explode(F.array("a", "b")).alias("leaf")).distinct()))
    both = links.join(sets.select(F.col("leaf").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("leaf").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= similarity * (F.size("x") + F.size("y") - common)
    checked = cut_lineage(both.where(alike).select("a", "b"))
    roots = cut_lineage(link_components(checked))
    joined = leaves.select("leaf", "fp", "mins", "size").join(roots.withColumnRenamed("node", "leaf"), "leaf", "left").withColumn("root", F.coalesce("root", "leaf"))
    further = cut_lineage(open_links(joined, sets_of, most, similarity))
    roots = link_components(checked.unionByName(further))
    return prints.select("id", "hash", "leaf").join(roots.withColumnRenamed("node", "leaf"), "leaf", "left").select("id", "hash", F.coalesce("root", "leaf").alias("root"))


def _sized(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` with a broadcast hint if there are few enough of them."""
    return F.broadcast(keys) if keys.count() <= most else keys


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """The row with the smallest id of each group of similar texts, with all columns of ``docs``.

    Null texts count as empty; all texts without words are one group. Rows that
    repeat an id and its text are one document. Rows without id only stay if no
    row of their group has one.
    """
    i, h, key, code = (free_name(docs, n) for n in ("_id", "_hash", "_i", "_h"))
    named = cut_lineage(similar_groups(docs, ident, text, **kind))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    first = named.join(least, "root").where(F.col("id").eqNullSafe(F.col("least")))
    stays = cut_lineage(first.groupBy("root").agg(F.min("id").alias(key), F.min("hash").alias(code)).select(key, code))
    marked = docs.withColumns({i: F.col(ident), h: F.xxhash64(text)})
    same = F.col(i).eqNullSafe(F.col(key)) & (F.col(h) == F.col(code))
    pairs = named.select(F.col("id").alias(key), F.col("hash").alias(code))
    gone = pairs.join(stays.select(F.col(key).alias("_s"), F.col(code).alias("_t")), F.col(key).eqNullSafe(F.col("_s")) & (F.col(code) == F.col("_t")), "left_anti")
    gone = cut_lineage(gone.distinct())
    n_gone = gone.count()
    if n_gone <= BROADCAST_KEYS and named.count() == stays.count() + n_gone:
        # no row is repeated and few go: whole texts need no shuffle
        return marked.join(F.broadcast(gone), same, "left_anti").select(*docs.columns)
    return marked.join(stays, same, "left_semi").dropDuplicates([i, h]).select(*docs.columns)

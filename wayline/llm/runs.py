"""Periodic runs of words inside a text, from maximal pairs.

A run is a stretch of words with a period that no neighbouring word prolongs. It
shows up as a maximal pair: two occurrences of one substring, a period apart,
with different words before them and different words behind. Substrings with the
same longest common prefix are the nodes of the interval tree of the suffix
array; going up that tree, the start positions below a node are merged, and each
pair from different children with different left words is a maximal pair of the
node's length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.common import WORDS
from wayline.llm.quality import suffix_array, union

RESULT = "n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _near_repeats(array: np.ndarray, common: np.ndarray, base: int, factor: int) -> np.ndarray:
    """Entries of the suffix array that can belong to a run at all.

    Both starts of a run's pair agree in ``base`` words and in ``factor`` times
    their distance. So an entry is left out if its nearest other occurrence of
    its first ``base`` words is farther than its longest match allows.
    """
    longest = np.maximum(common, np.r_[common[1:], 0])
    entries = np.flatnonzero(longest >= base)
    at, group = array[entries], np.cumsum(common < base)[entries]
    order = np.lexsort((at, group))
    gap = np.diff(at[order])
    gap[np.diff(group[order]) != 0] = len(array) + 1
    far = np.array([len(array) + 1])
    near = np.minimum(np.r_[far, gap], np.r_[gap, far])
    return np.sort(entries[order][factor * near <= longest[entries[order]]])


def maximal_pairs(array: np.ndarray, common: np.ndarray, left: np.ndarray, base: int, factor: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs ``(first, distance, length)`` with ``length >= max(factor * distance, least - distance)``.

    ``left`` gives the class of the word before each position (its own class at a
    text's begin). The interval tree is walked bottom-up; a node keeps its start
    positions in text order and the smaller child is merged into the larger one,
    so a position moves a logarithmic number of times. For each position that
    moves, the nearest ones of the other child are compared by class. Nearest
    ones are enough: an occurrence between the two starts of a run would give the
    run a smaller period. Pairs whose distance is a multiple of the period may
    be among the results; they have the same stretch.
    """
    entries = _near_repeats(array, common, base, factor)
    if not len(entries):
        return
    # longest common prefixes between entries that are neighbours now
    between = np.r_[0, np.minimum.reduceat(common[: entries[-1] + 1], entries[:-1] + 1)] if len(entries) > 1 else np.zeros(1, np.int64)
    starts, classes = array[entries].tolist(), left.tolist()
    found: list[tuple[int, int, int]] = []

    def merge(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        reach = length // factor
        for p in b:
            k = bisect_left(a, p)
            if k and p - a[k - 1] <= reach and classes[a[k - 1]] != classes[p] and length + p - a[k - 1] >= least:
                found.append((a[k - 1], p - a[k - 1], length))
            if k < len(a) and a[k] - p <= reach and classes[a[k]] != classes[p] and length + a[k] - p >= least:
                found.append((p, a[k] - p, length))
        if len(b) == 1:
            insort(a, b[0])
        else:
            a.extend(b)
            a.sort()
        return a

    stack: list[tuple[int, list[int]]] = []
    for k, depth in enumerate([*between[1:].tolist(), 0]):
        node = [starts[k]]
        while stack and stack[-1][0] > depth:
            length, other = stack.pop()
            node = merge(other, node, length)
        if depth >= base:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, merge(stack[-1][1], node, depth))
            else:
                stack.append((depth, node))
        yield from found
        found.clear()


def text_runs(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each list of words, by start, then period.

    A run is as long as ``least`` words and ``times`` periods at least, its period
    is the smallest one, and it cannot be prolonged.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    sizes = np.array([len(x) for x in texts], np.int64)
    n, out = int(sizes.sum()), [[] for _ in texts]
    if not n:
        return out
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((numbers[w] for x in texts for w in x), np.int64, n)
    text_of, stops = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    begins = stops - sizes
    left = np.r_[0, words[:-1]]
    left[begins[sizes > 0]] = -1
    array, common = suffix_array(words, text_of, np.repeat(stops, sizes))
    factor = times - 1
    base = min(max(least - d, factor * d) for d in range(1, least + 1))
    smallest: dict[tuple[int, int], int] = {}
    for first, distance, length in maximal_pairs(array, common, left, base, factor, least):
        key = (first, length + distance)
        smallest[key] = min(distance, smallest.get(key, distance))
    for (first, length), period in smallest.items():
        k = text_of[first]
        out[k].append((first - int(begins[k]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    spans = np.array([(s + q, n - q) for s, n, q in runs], np.int64)
    gone = union(spans[:, 0], spans[:, 1], len(words))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(text: Column, least: int = 6, times: int = 4, batch_chars: int = 4_000_000) -> Column:
    """Struct ``n_words``, ``starts``, ``lengths``, ``periods`` (of all runs, by start, then period) and ``collapsed`` of each whole text.

    Words are split at ASCII white space. ``collapsed`` are the words that stay,
    joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Texts are worked on together until ``batch_chars`` characters
    are reached, which bounds memory; a longer single text goes alone and whole.
    """

    @F.pandas_udf(RESULT)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for s in series:
            rows, held, size = [], [], 0
            for k, t in enumerate(s, 1):
                held.append((t or "").encode("utf-8", "replace").split())
                size += len(t or "")
                if size >= batch_chars or k == len(s):
                    for words, runs in zip(held, text_runs(held, least, times), strict=True):
                        a, b, c = zip(*runs, strict=True) if runs else ((), (), ())
                        rows.append((len(words), list(a), list(b), list(c), b" ".join(collapse(words, runs)).decode("utf-8")))
                    held, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return run(text)


def find_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """``ident`` and the fields of :func:`periodic_runs`, a row per input row; repeated rows stay repeated."""
    return docs.select(F.col(ident), periodic_runs(F.col(text), **kind).alias("_runs")).select(ident, "_runs.*")


def with_loops(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``text``, where one text in ten repeats itself from some word on.

    The texts are those whose id has a crc32 divisible by ten; from word ``a`` on
    they go round in ``p`` words, both from the crc32. Rows without an id or
    without words stay as they are.
    """
    h = F.crc32(F.col("_id").cast("string").cast("binary"))
    clean = F.regexp_replace("_text", rf"\A{WORDS}|{WORDS}\z", "")
    chosen = F.coalesce((h % 10 == 0) & (F.length(clean) > 0), F.lit(False))
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("_words", F.when(chosen, F.split(clean, WORDS)))
    n, g = F.size("_words").cast("bigint"), F.floor(h / 10)
    rows = rows.withColumns({"_n": n, "_a": g % n}).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))

    def word(i: Column) -> Column:
        return F.get("_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))

    looped = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), word), " ")
    return rows.select(F.col("_id").alias(ident), F.when(F.col("_words").isNotNull(), looped).otherwise(F.col("_text")).alias("text"))


def run_digests(found: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The strongest run of each row of :func:`find_runs` and digests of all its runs and of its collapsed text.

    The strongest run has the greatest length in periods, compared exactly; ties
    go to the smallest start, then period. Without runs its columns are null.
    """
    rows = found.withColumn("_all", F.arrays_zip("starts", "lengths", "periods"))

    def stronger(a: Column, b: Column) -> Column:
        return F.when(b["lengths"] * a["periods"] > a["lengths"] * b["periods"], b).otherwise(a)

    lines = F.transform("_all", lambda r: F.concat(r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","), r["periods"].cast("string"), F.lit("\n")))
    best = F.aggregate("_all", F.get("_all", F.lit(0)), stronger)
    return rows.withColumn("_best", best).select(
        ident,
        F.size("_all").cast("bigint").alias("n_runs"),
        F.col("_best.starts").alias("start"),
        F.col("_best.lengths").alias("length"),
        F.col("_best.periods").alias("period"),
        F.floor(1000 * F.col("_best.lengths") / F.col("_best.periods")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

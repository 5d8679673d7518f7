"""Quality rules on repetition inside a text, from a suffix array over its words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayline.llm.common import free_name, small_batches

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
    + [T.StructField("covered", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def suffix_array(words: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of several texts at once, and the longest common prefix of each entry with the one before.

    ``words`` are word numbers, ``text_of`` the text of each position and
    ``ends`` where that text ends. Suffixes of different texts never share a
    prefix. Prefix doubling: groups of suffixes equal in their first ``h`` words
    are sorted again by the group ``h`` words on; groups of one are left alone.
    Equal group numbers of all rounds then give the common prefixes by halving.
    """
    n = len(words)
    key = text_of * (int(words.max(initial=0)) + 1) + words
    array = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = key[array]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank[array] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, h = [rank.copy()], 1
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))  # entries of groups of two and more
    while len(slots):
        at = array[slots]
        after = np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        at, ordered = at[order], key[order]
        array[slots] = at
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
        rounds.append(rank.copy())
    common = np.zeros(n, np.int64)
    pairs = np.flatnonzero(rounds[0][array[1:]] == rounds[0][array[:-1]]) + 1
    x, y, got = array[pairs], array[pairs - 1], np.zeros(len(pairs), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        a, b = x + got, y + got
        inside = (a < ends[x]) & (b < ends[y])
        same = inside & (rounds[k][np.minimum(a, n - 1)] == rounds[k][np.minimum(b, n - 1)])
        got[same] += 1 << k
    common[pairs] = got
    return array, common


def repeats(words: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length in words of the longest substring from there that its text holds elsewhere too.

    A suffix lies in the interval of its larger neighbouring common prefix; the
    maximal repeated substring of that interval starts at the suffix.
    """
    array, common = suffix_array(words, text_of, ends)
    longest = np.empty(len(words), np.int64)
    longest[array] = np.maximum(common, np.r_[common[1:], 0])
    return longest


def union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def _measure(texts: list[str], min_words: int) -> dict[str, np.ndarray]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at the six ASCII spaces only
    sizes = np.array([len(w) for w in split], np.int64)
    out = {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.zeros(len(texts), np.int64),
    }
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    n = int(sizes.sum())
    text_of = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, n)
    longest = repeats(words, text_of, ends) if n else np.zeros(0, np.int64)

    def covered(least: int) -> np.ndarray:
        at = np.flatnonzero(longest >= least)
        return np.bincount(text_of[union(at, longest[at], n)], minlength=len(texts))

    out["n_repeat_words"] = covered(8)  # spans of 8 and more words are the union of their 8-word windows
    out["covered_words"] = covered(min_words)
    out["longest_repeat"] = np.zeros(len(texts), np.int64)
    np.maximum.at(out["longest_repeat"], text_of, longest)
    return out


def quality(text: Column, min_words: int = 4, most_covered: float = 0.5, most_repeated: int = 200, batch_chars: int = 4_000_000) -> Column:
    """Struct of word counts, repetition and the verdict ``kept`` for each whole text.

    ``covered_words`` is the number of words in the union of all maximal repeated
    substrings of at least ``min_words`` words. A text is rejected when it fails
    the base rule (fewer than 20 words, or over 30 in 100 words inside repeated
    8-word windows), when ``covered_words`` is more than ``most_covered`` of it,
    or when its longest repeated substring has over ``most_repeated`` words.

    Null and empty texts have no words and fail the base rule. Texts are measured
    together until ``batch_chars`` characters are reached, which bounds memory; a
    longer single text is measured alone and whole.
    """

    @F.pandas_udf(RESULT)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            parts, held, size = [], [], 0
            for t in s:
                held.append(t or "")
                size += len(held[-1])
                if size >= batch_chars:
                    parts.append(_measure(held, min_words))
                    held, size = [], 0
            if held or not parts:
                parts.append(_measure(held, min_words))
            m = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})
            m["covered"] = m["covered_words"] / m["n_words"].clip(lower=1)
            m["base_failed"] = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            m["kept"] = ~(m["base_failed"] | (m["covered"] > most_covered) | (m["longest_repeat"] > most_repeated))
            yield m[RESULT.fieldNames()]

    return run(text)


def quality_report(docs: DataFrame, ident: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """``ident`` and the fields of :func:`quality`, a row per input row (repeated rows stay repeated)."""
    q = "_quality"
    return docs.select(F.col(ident), quality(F.col(text), **rules).alias(q)).select(ident, f"{q}.*")


def keep_good(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` whose text passes the rules, with all their columns."""
    small_batches(docs.sparkSession)
    q = free_name(docs, "_quality")
    return docs.withColumn(q, quality(F.col(text), **rules)).where(F.col(f"{q}.kept")).drop(q)

"""Packing of tokenised documents into sequences of bounded length.

Pieces are dealt into random groups of a bounded number of tokens; in each group
they go, longest first, into the first sequence with room (first-fit
decreasing). A tournament tree over the sequences' free room finds that sequence
in logarithmic time.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayline.llm.common import cut_lineage, small_batches
from wayline.llm.tokencount import byte_letters, tokenizer_path

LENGTH = 4096
#: words whose ids a Python worker remembers
REMEMBERED = 500_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Token ids of a text's words as little-endian 32-bit bytes, from a tokenizer that never joins across white space.

    Words of Latin letters, digits and ASCII signs take a short way: they are
    lower-cased, cut like the tokenizer cuts them, and each part goes to the
    tokenizer's model alone. All other words go through the whole tokenizer.
    """

    plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def part(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def __missing__(self, word: str) -> bytes:
        if self.plain.fullmatch(word) and "<|" not in word:
            got = b"".join([self.part(p) for p in self.parts.findall(word.lower())])
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """Ids of a whole text. Only spaces and line ends cut words; other white space stays for the tokenizer."""
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ") if w])


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    return WordIds(tokenizer_path(name))


def pieces(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Token pieces of at most ``length`` ids of every document: its ids, then ``end_id``, cut from the start on.

    Null texts are empty: their only id is ``end_id``. Repeated rows give
    repeated pieces. ``ids_crc32`` is over little-endian unsigned 32-bit ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer)
        for b in batches:
            rows = []
            for doc, t in zip(b["d"], b["t"], strict=True):
                data = (words.ids(t) if t else b"") + end
                n = len(data) // 4
                for at in range(0, n, length):
                    cut = data[4 * at : 4 * (at + length)]
                    rows.append((doc, at, len(cut) // 4, zlib.crc32(cut), n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # pandas turns whole numbers next to nulls into doubles, which lose digits: ids cross as strings
    cut = docs.select(F.col(ident).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(run, f"doc_id string, {PIECES}")
    return cut.withColumn("doc_id", F.col("doc_id").cast("bigint"))


class Tournament:
    """Free room of the sequences in a complete binary tree whose inner nodes hold the larger child."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.size, self.used = capacity, 1, 0
        self.tree = [0, capacity]

    def put(self, need: int) -> tuple[int, int]:
        """First sequence with ``need`` room, and how much of it was taken before."""
        if self.tree[1] < need:  # all opened leaves are too full: twice as many, the old tree to the left
            self._grow()
        node = 1
        while node < self.size:
            node *= 2
            if self.tree[node] < need:
                node += 1
        bin_no, free = node - self.size, self.tree[node]
        self.used = max(self.used, bin_no + 1)
        self.tree[node] = free - need
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])
        return bin_no, self.capacity - free

    def _grow(self) -> None:
        leaves = self.tree[self.size :] + [self.capacity] * self.size
        self.size *= 2
        self.tree = [0] * self.size + leaves
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ties in length keep their order."""
    room = Tournament(capacity)
    where = np.empty((len(lengths), 2), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        where[i] = room.put(int(lengths[i]))
    return where[:, 0], where[:, 1]


def pack(cut: DataFrame, length: int = LENGTH, group_tokens: int = 8_000_000, seed: int = 11) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` ids each, at most ``length``).

    The number of groups follows from the sum of tokens, so a group stays near
    ``group_tokens`` tokens whatever the input. Rows are dealt by a hash of their
    place in the written pieces, not by a key, so repeated documents spread out.
    """
    cut = cut_lineage(cut.withColumn("_row", F.monotonically_increasing_id()))
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        sequence, offset = first_fit_decreasing(group["length"].to_numpy(), length)
        return group.assign(sequence_id=(group["_group"].to_numpy() << 32) + sequence, offset=offset)[names]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("_group").applyInPandas(run, f"doc_id string, {PIECES}, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def pack_documents(docs: DataFrame, length: int = LENGTH, **kind) -> DataFrame:
    """Tokenise, cut and pack whole documents; see :func:`pieces` and :func:`pack`."""
    small_batches(docs.sparkSession)
    return pack(pieces(docs, length=length, **kind), length)

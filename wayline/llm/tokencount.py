"""Greedy word-piece lengths by an automaton that reads each character once.

The vocabulary is kept as a trie. Each node has a failure link and the number of
pieces that are popped on the way there, both worked out beforehand (the linear
longest-match method of Song et al., 2021), so a word's pieces are counted
without building them and without reading any character twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: longer words are counted anew each time
LONGEST_REMEMBERED = 200
#: words whose lengths a Python worker remembers
REMEMBERED = 400_000


class Automaton:
    """Counts the pieces of the greedy longest match of a word over ``vocabulary``.

    A word that no sequence of longest matches covers counts as one unknown
    piece. ``end`` is put behind each word, so pieces that end a word can differ
    from those inside.
    """

    def __init__(self, vocabulary: Iterable[str], end: str = "") -> None:
        self.end = end
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for word in vocabulary:
            node = 0
            for ch in word:
                to = self.next[node].get(ch)
                if to is None:
                    to = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                node = to
            if node:
                piece[node] = True
        #: failure link (-1: none) and the pieces popped by following it
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for ch, to in self.next[node].items():
                queue.append(to)
                if piece[to]:
                    self.fail[to], self.popped[to] = 0, 1
                    continue
                back, popped = self.fail[node], self.popped[node]
                while back >= 0 and ch not in self.next[back]:
                    popped += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[to], self.popped[to] = self.next[back][ch], popped

    def pieces(self, word: str) -> int:
        """Number of pieces of ``word``; 0 stands for a word that cannot be cut into pieces."""
        node = count = 0
        following, fail, popped = self.next, self.fail, self.popped
        for ch in word + self.end:
            to = following[node].get(ch)
            while to is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = following[node].get(ch)
            node = to
        while node:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return count


def greedy_pieces(word: str, vocabulary: set[str], end: str = "") -> list[str] | None:
    """The same pieces the plain way, for tests: the longest match, then on behind it; None where none fits."""
    out, rest = [], word + end
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return None
        out.append(rest[:size])
        rest = rest[size:]
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by their published rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def load_automaton(path: str, end: str) -> Automaton:
    """Automaton of the vocabulary of a tokenizer file; built once a Python worker."""
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f)["model"]["vocab"], end)


class _Lengths(dict):
    """(pieces, unknown) of the words met so far; keeps the first ``REMEMBERED``, which hold the common ones."""

    def __init__(self, automaton: Automaton, most_chars: int | None) -> None:
        self.automaton, self.most_chars, self.letters = automaton, most_chars, byte_letters()

    def __missing__(self, word: str) -> tuple[int, int]:
        count = 0
        if self.most_chars is None or len(word) <= self.most_chars:
            raw = word.lower()
            count = self.automaton.pieces(raw if raw.isascii() else "".join([self.letters[b] for b in raw.encode("utf-8", "replace")]))
        out = (count, 0) if count else (1, 1)
        if len(self) < REMEMBERED and len(word) <= LONGEST_REMEMBERED:
            self[word] = out
        return out


@lru_cache(maxsize=4)
def _lengths(path: str, end: str, most_chars: int | None) -> _Lengths:
    return _Lengths(load_automaton(path, end), most_chars)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(text: Column, vocabulary: str = "word_bpe_49k.json", end: str = "</w>", most_chars: int | None = None) -> Column:
    """Struct ``n_words``, ``n_tokens``, ``n_unknown`` and ``longest_word`` (in pieces) of each whole text.

    Words are split at ASCII white space and lower-cased; a word that the
    vocabulary cannot cover is one unknown piece, and so is one of more than
    ``most_chars`` characters, if that is given. Null and empty texts have no words. ``vocabulary`` names a
    tokenizer file on the workers.
    """

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long, longest_word long")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _lengths(tokenizer_path(vocabulary), end, most_chars)
        for s in series:
            rows = []
            for t in s:
                words = [w.decode("utf-8", "replace") for w in t.encode("utf-8", "replace").split()] if t and not t.isascii() else (t or "").translate(_ASCII_SPACES).split(" ")
                found = [known[w] for w in words if w]
                sizes = [a for a, _ in found]
                rows.append((len(found), sum(sizes), sum([b for _, b in found]), max(sizes, default=0)))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown", "longest_word"])

    return run(text)


_ASCII_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def count_tokens(docs: DataFrame, ident: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """``ident`` and the fields of :func:`token_counts`; a row per input row."""
    return docs.select(F.col(ident), token_counts(F.col(text), **kind).alias("_t")).select(ident, "_t.*")

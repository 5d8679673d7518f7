import hashlib
import random
import zlib

import pytest

from wayline.llm import runs


def brute_runs(words, least=6, times=4):
    """Runs by trying every period and every stretch that keeps it."""
    n, smallest = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                smallest.setdefault((i, length), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted(((s, n_, q) for (s, n_), q in smallest.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_text(rng):
    kind, n = rng.randrange(4), rng.randrange(60)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abc") for _ in range(3)] * (n // 3) + [rng.choice("abc") for _ in range(5)]
    if kind == 2:  # loops between single words, with many left and right words
        return [w for i in range(n // 4) for w in [f"l{i % 5}"] + ["x"] * rng.randrange(8) + ["y", "z"] * rng.randrange(5)]
    block = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
    return [rng.choice("ab") for _ in range(4)] + block * rng.randrange(8) + block[: rng.randrange(9)] + [rng.choice("ab") for _ in range(4)]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3), (5, 2), (12, 4)])
def test_runs_match_all_periods(least, times):
    rng = random.Random(least * times)
    texts = [random_text(rng) for _ in range(400)] + [[], ["a"], ["a"] * 300, ["a", "b"] * 200, (["a"] * 9 + ["b"]) * 30]
    got = runs.text_runs([[w.encode() for w in t] for t in texts], least, times)
    for t, found in zip(texts, got, strict=True):
        assert found == brute_runs(t, least, times), t
        assert runs.collapse(t, found) == brute_collapse(t, found)


def test_long_texts_and_many_left_words():
    text = [w for i in range(4000) for w in (f"a{i}", "x", "x", "x", "x", "x", "x", f"b{i}")]
    (found,) = runs.text_runs([[w.encode() for w in text]])
    assert found == [(8 * i + 1, 6, 1) for i in range(4000)]
    assert runs.text_runs([[b"long"] * 50_000]) == [[(0, 50_000, 1)]]


def expected(doc_id, text):
    """The contract's row, the plain way."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in found)
    kept = b" ".join(brute_collapse(words, found))
    return (
        doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_query_rows_match_brute_force(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(random_text(rng)), "en", "s") for i in range(150)]
    rows += [(200, None, None, None), (201, "", "en", "s"), (202, " \n\x0b\t", "en", "s"), (None, "x " * 9, "en", "s"), (203, "é\x1cx é\x1cx " * 5, "en", "s")]
    rows += [rows[3], (204, "  " + "a b\n" * 40 + " ", "en", "s"), (205, "a b c " * 3000, "en", "s")]
    docs = documents(rows)
    out = runs.run_digests(runs.find_runs(runs.with_loops(docs)))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert runs.find_runs(documents([])).count() == 0


def test_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in runs.run_digests(runs.find_runs(runs.with_loops(docs))).collect()}
    for r in docs.where("length(text) < 3000").collect():
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in got.values()) >= 10

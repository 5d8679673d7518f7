import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wayline.llm import ranking

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def brute(items, docs, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c, n in found:
            m = 75 + (25 * n * n_docs) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(rng, n, most):
    return " ".join(rng.choice(["the", "of", "And", "and", "x1", "É", "é", "z-z", "q_r", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(most))) if n else None


@pytest.fixture
def fixture(spark, documents):
    rng = random.Random(4)
    docs = [(i, rows_of(rng, i % 9, 80), "en", "s") for i in range(300)] + [(None, "the x1 w3", None, None), (7, "the of w5", "en", "s"), (999, "long w1 " * 3000, "en", "s")]
    docs += [(1000 + i, "same words of w7 and w8", "en", "s") for i in range(60)]
    items = [(i, rows_of(rng, 1, 30)) for i in range(25)] + [(30, None), (31, ""), (32, "?!"), (33, "nowhere"), (34, "w7 w7 W8 w7"), (34, "w7 w7 W8 w7")]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), documents(docs)


@pytest.mark.parametrize("block", [2000, 7])
def test_ranks_match_brute_force(fixture, block):
    items, docs, item_rows, doc_rows = fixture
    got = ranking.rank_items(item_rows, doc_rows, block_items=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(items, [d[:2] for d in docs])


def test_small_blocks_of_documents(fixture, monkeypatch):
    items, docs, item_rows, doc_rows = fixture
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 5000)
    got = ranking.rank_items(item_rows, doc_rows.repartition(3), k=5).collect()
    assert sorted(map(tuple, got), key=str) == brute(items, [d[:2] for d in docs], 5)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the")], "item_id long, text string")
    some = documents([(1, "the", "en", "s")])
    assert ranking.rank_items(none, some).collect() == []
    assert ranking.rank_items(one, documents([])).collect() == []
    assert ranking.rank_items(one, documents([(1, None, None, None)])).collect() == []
    assert [tuple(r)[:3] for r in ranking.rank_items(one, some).collect()] == [(1, 1, 1)]


def test_shared_sums_are_the_plain_sums():
    rng = random.Random(9)
    common = [rng.sample(range(60), 8) for _ in range(4)]
    items = [rng.choice(common) + [rng.randrange(60) for _ in range(rng.randrange(12))] for _ in range(80)] + [[], [5], [5] * 7]
    graph = ranking.SharedSums(items, 60)
    rows = np.array([[rng.randrange(1000) for _ in range(11)] for _ in range(60)])
    want = np.array([rows[x].sum(axis=0) if x else np.zeros(11, np.int64) for x in items])
    assert (graph.evaluate(rows) == want).all()
    assert graph.additions < 0.6 * sum(max(0, len(x) - 1) for x in items)

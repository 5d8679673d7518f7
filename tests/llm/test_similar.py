import random

import numpy as np
import pytest

from wayline.llm import similar


def plain_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_groups(texts, least=0.8):
    """Smallest position that each text is linked to, over all pairs."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= least * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def varied(rng, base, n):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("largest", [512, 16])
def test_groups_match_all_pairs(spark, documents, monkeypatch, largest):
    rng = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 200, 400]))]
        texts += [varied(rng, base, rng.randrange(0, 1 + len(base) // 60)) for _ in range(25 if g == 0 else rng.randrange(1, 5))]
    texts += ["", None, " \n", "a b", "A  b", "a b c", texts[0].upper()]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(similar, "candidate_links", lambda leaves, most, f=similar.candidate_links: f(leaves, most, largest=largest))
    kept = sorted(r["doc_id"] for r in similar.keep_one(documents(rows)).collect())
    want = sorted(set(plain_groups(texts)))
    if largest == 512:
        assert kept == want
    else:  # parted forests may miss links of the lowest similarity
        assert set(want) <= set(kept) and len(kept) <= len(want) + 6


def test_edges(spark, documents):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(5, a, "en", "s"), (3, a, "en", "s"), (3, a, "en", "s"), (9, "other words here", "en", "s"), (None, "c d e f", "en", "s"), (None, "c d e f", "en", "s"), (8, None, "en", "s")]
    docs = documents(rows)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("3", a), ("9", "other words here"), ("None", "c d e f"), ("8", "")])
    assert similar.keep_one(documents([])).count() == 0


def test_spans_connect_what_links_connect():
    rng = np.random.default_rng(1)
    for _ in range(20):
        fps = rng.integers(0, 2**63, 30, dtype=np.uint64)[rng.integers(0, 30, 60)] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
        links = similar.spanning_links(fps, rng.integers(0, 4, (60, similar.SKETCH)), 3)
        root = np.arange(60)
        from wayline.llm.simhash import _unite

        _unite(root, np.array([i for i, _ in links], int), np.array([j for _, j in links], int))
        plain = np.arange(60)
        for i in range(60):
            j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
            _unite(plain, np.full(len(j), i), j)
        assert (root == plain).all()


def group_at(rng, n, words, share):
    """Texts of one base, each with a share of its words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [varied(rng, base, round(words * share)) for _ in range(n)]


def kept_ids(documents, texts):
    return sorted(r["doc_id"] for r in similar.keep_one(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect())


def test_large_forests_lose_no_pair(spark, documents, monkeypatch):
    """Forests far over the largest size, at similarities about 0.8, next to one group that fills blocks of its own."""
    texts = group_at(random.Random(6), 90, 300, 0.0125) + group_at(random.Random(7), 60, 300, 0.004)
    for name in ("candidate_links", "open_links"):
        if hasattr(similar, name):
            monkeypatch.setattr(similar, name, lambda *a, f=getattr(similar, name), **b: f(*a, **b, largest=16))
    assert kept_ids(documents, texts) == sorted(set(plain_groups(texts)))


def test_small_forests_lose_no_pair(spark, documents):
    """Texts about the least similarity, where many of the first links fail the check."""
    texts = group_at(random.Random(8), 150, 500, 0.0138)
    assert kept_ids(documents, texts) == sorted(set(plain_groups(texts)))

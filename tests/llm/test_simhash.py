import numpy as np
import pytest
import xxhash

from wayline.llm import simhash


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=2):
    root = np.arange(len(prints))
    u = np.array(prints, np.uint64)
    for i in range(len(u)):
        j = np.flatnonzero(np.bitwise_count(u ^ u[i]) <= most)
        simhash._unite(root, np.full(len(j), i), j)
    return root


def clustered(rng, n, centres, flips):
    u = rng.integers(0, 2**63, size=centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        u = u ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(u)


def test_trie_finds_the_components():
    rng = np.random.default_rng(3)
    for k in range(40):
        u = clustered(rng, int(rng.integers(1, 200)), 1 + k % 7, k % 5)
        assert (simhash.trie_components(u, None, 0, 0, 2) == plain_components(u)).all()


@pytest.mark.parametrize("work", [1, 64, 1 << 22])
def test_distributed_trie_finds_the_components(spark, work):
    rng = np.random.default_rng(work)
    u = clustered(rng, 400, 12, 4)
    leaves = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    edges = simhash.trie_links(leaves, 2, work).collect()
    place = {int(x): i for i, x in enumerate(u.view(np.int64))}
    root = np.arange(len(u))
    if edges:
        simhash._unite(root, np.array([place[r["a"]] for r in edges]), np.array([place[r["b"]] for r in edges]))
    assert (root == plain_components(u)).all()


def test_near_duplicates_against_plain(spark, documents, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "TWO  words"), (1005, "É bien sûr"), (1006, "é bien sûr"), (1000, None), (1007, "w " * 200000)]
    got = simhash.near_duplicates(documents([(i, t, "en", "s") for i, t in texts])).collect()
    prints = [plain_fingerprint(t) for _, t in texts]
    root = plain_components(prints)
    smallest = {}
    for (i, _), r in zip(texts, root, strict=True):
        smallest[r] = min(i, smallest.get(r, i))
    want = sorted((i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(texts, prints, root, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_document_of_each_group_stays(spark, documents):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a, "en", "s"), (3, a, "en", "s"), (3, a, "en", "s"), (9, b, "en", "s"), (None, "c d e f", "en", "s"), (None, "c d e f", "en", "s"), (8, None, "en", "s")]
    docs = documents(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("3", a), ("9", b), ("None", "c d e f"), ("8", "")])
    assert simhash.keep_one(documents([])).count() == 0


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_of_few_and_many_edges(spark, at_once):
    pairs = [(1, 2), (3, 2), (-7, 3), (10, 11), (11, 12), (20, 21)]
    got = {r["node"]: r["root"] for r in simhash.link_components(spark.createDataFrame(pairs, "a long, b long"), at_once).collect()}
    assert got == {1: -7, 2: -7, 3: -7, -7: -7, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    assert simhash.link_components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0

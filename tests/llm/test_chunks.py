import random

import pytest

from wayline.llm import chunks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_normalised_texts():
    cases = {None: b"", "": b"", " \n\t": b" ", "a": b"a", "\x0b a \r\n b\x1cc ": b" a b\x1cc ", "é x": "é x".encode()}
    for text, want in cases.items():
        assert chunks.normalise(text) == want


def test_cuts_follow_the_content():
    rng = random.Random(1)
    data = words(rng, 5000).encode()
    whole = chunks.cut(data)
    assert b"".join(whole) == data and all(128 <= len(c) <= 8192 for c in whole[:-1])
    assert chunks.cut(data, segment=1000) == whole == chunks.cut(data, segment=777)
    edited = data[:9000] + b"something new" + data[9000:]
    assert len(set(whole) - set(chunks.cut(edited))) <= 4
    assert chunks.cut(b"") == [] and chunks.cut(b"x") == [b"x"]
    assert [len(c) for c in chunks.cut(b"a" * 20_000, most=8192)] in ([8192, 8192, 3616], [128] * 156 + [32])


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(chunks.normalise(t), []).append(i)
    out = []
    for i, t in rows:
        group = groups[chunks.normalise(t)]
        out.append((i, min((x for x in group if x is not None), default=None), len(group)))
    return sorted(out, key=str)


@pytest.fixture
def rows():
    rng = random.Random(2)
    long = words(rng, 4000)
    texts = [long, long.replace(" ", "\n"), long + " ", long[:-1], "same", "same", "same ", " same", None, "", " ", "\n\t", "é" * 3000, "é" * 3000]
    texts += ["copy of many"] * 300 + [words(rng, 50) for _ in range(30)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(i, t, "en", "s") for i, t in zip(order, texts, strict=True)]
    return out + [(None, "same", "en", "s"), (None, "alone", None, None), (min(i for i, t, *_ in out if t == "same"), "same", "en", "s")]


def test_groups_match_brute_force(spark, documents, rows):
    got = chunks.exact_groups(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute([r[:2] for r in rows])
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert chunks.exact_groups(documents([])).count() == 0


def test_groups_without_broadcast(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(chunks, "BROADCAST_BYTES", -1)
    got = chunks.exact_groups(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute([r[:2] for r in rows])


def test_identifiers_are_verified(spark, documents, rows):
    docs = documents(rows)
    assert not chunks.ambiguous_ids(chunks.chunk_store(docs, id_bytes=1)).isEmpty()
    wide = chunks.verified_width(docs, id_bytes=1)
    assert wide > 1 and chunks.ambiguous_ids(chunks.chunk_store(docs, id_bytes=wide)).isEmpty()
    got = chunks.exact_groups(docs, id_bytes=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute([r[:2] for r in rows])


def test_store_and_recipes_give_the_texts_back(spark, documents, rows):
    docs = documents(rows)
    store = {bytes(r["chunk_id"]): bytes(r["chunk"]) for r in chunks.chunk_store(docs).collect()}
    back = sorted((b"".join(store[bytes(c)] for c in r["recipe"]) for r in chunks.recipes(docs).collect()))
    assert back == sorted(chunks.normalise(t) for _, t, *_ in rows)

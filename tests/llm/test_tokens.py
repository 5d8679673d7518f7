import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from wayline.llm import packing, tokencount


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(400):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))}
        automaton = tokencount.Automaton(vocabulary)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            pieces = tokencount.greedy_pieces(word, vocabulary)
            assert automaton.pieces(word) == (0 if pieces is None else len(pieces))


def test_counts_of_documents(spark, documents):
    texts = [None, "", " \n ", "the and thing", "Grüße naïve", "x" * 500, "中文 \x85 🙂"]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs).collect()}
    short = tokencount.count_tokens(docs, most_chars=200).where("doc_id = 5").first()
    assert (short["n_tokens"], short["n_unknown"]) == (1, 1)
    path = tokencount.tokenizer_path("word_bpe_49k.json")
    vocabulary = set(Tokenizer.from_file(path).get_vocab())
    letters = tokencount.byte_letters()
    for i, t in enumerate(texts):
        sizes = []
        for w in (t or "").encode().split():
            pieces = tokencount.greedy_pieces("".join(letters[b] for b in w.decode().lower().encode()), vocabulary, "</w>")
            sizes.append(1 if pieces is None else len(pieces))
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["longest_word"]) == (len(sizes), sum(sizes), max(sizes, default=0))
    assert got[5]["n_unknown"] == 0
    assert tokencount.count_tokens(documents([])).count() == 0


def test_query_cuts_words_of_any_length(spark, documents, tmp_path):
    from wayline.llm import queries

    texts = ["x" * 500, "我们今天去学校。" * 300, "aGVsbG8gd29ybGQh" * 100 + " the", "the"]
    documents([(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_token_counts(spark, str(tmp_path)).collect()}
    vocabulary = set(Tokenizer.from_file(tokencount.tokenizer_path("word_bpe_49k.json")).get_vocab())
    letters = tokencount.byte_letters()
    for i, t in enumerate(texts):
        pieces = [tokencount.greedy_pieces("".join(letters[b] for b in w.lower().encode()), vocabulary, "</w>") for w in t.split()]
        sizes = [1 if p is None else len(p) for p in pieces]
        assert (got[i]["n_tokens"], got[i]["longest_word"], got[i]["n_unknown"]) == (sum(sizes), max(sizes), pieces.count(None))
    assert got[1]["n_tokens"] > 1000


def test_word_ids_equal_the_whole_tokenizer():
    words = packing.word_ids("word_bpe_49k.json")
    rng = random.Random(2)
    letters = "aÀß'’s1²½ª \n\t <|>_Σσ́ñÿŸİ.tdmlve\x1c\x85"
    texts = ["", "I'M don't 's '' <|endoftext|>x", "ΑΣ ΟΔΟΣ 中文 🙂 ÷×a １２"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert words.ids(t) == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_first_fit_decreasing_matches_a_plain_loop():
    rng = random.Random(3)
    for _ in range(50):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(0, 60))], np.int64)
        sequence, offset = packing.first_fit_decreasing(lengths, 20)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            at = next((k for k, free in enumerate(room) if free >= lengths[i]), len(room))
            if at == len(room):
                room.append(20)
            assert (sequence[i], offset[i]) == (at, 20 - room[at])
            room[at] -= int(lengths[i])


def test_packing_holds_every_id_once(spark, documents):
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, "hello world", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, long, "en", "s"), (1, "hello world", "en", "s"), (None, "no id", "en", "s")]
    rows += [(2**53 + 1 + 2 * i, f"text number {i} " * (i % 40), "en", "s") for i in range(200)]
    got = packing.pack_documents(documents(rows)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    want = []
    for doc, t, _, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(str(doc), s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    used = sum(r["length"] for r in got)
    assert len(by) <= used / 4096 + 1.5
    assert packing.pack_documents(documents([])).count() == 0


def test_small_groups_give_distinct_sequences(spark, documents):
    docs = documents([(i, "some words " * (i % 30), "en", "s") for i in range(100)])
    got = packing.pack(packing.pieces(docs, length=64), length=64, group_tokens=500).collect()
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 64 and sum(used.values()) == sum(r["length"] for r in got)
    assert len({s >> 32 for s in used}) > 1

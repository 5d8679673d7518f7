import random

import numpy as np
import pytest

from wayline.llm import quality


def brute(text, least):
    """(longest repeat, covered words) by comparing all pairs of positions."""
    words = text.encode().split()
    n = len(words)
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= least:
            covered |= set(range(i, i + best))
    return longest, len(covered)


@pytest.mark.parametrize("least", [1, 2, 4, 8])
def test_repeats_match_all_pairs(least):
    rng = random.Random(least)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randrange(40))) for k in range(60)]
    texts += ["", "a", " ".join("x" * 30), " ".join("ab" * 20)]
    m = quality._measure(texts, least)
    for i, t in enumerate(texts):
        assert (m["longest_repeat"][i], m["covered_words"][i]) == brute(t, least)


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    words = np.array([rng.randrange(3) for _ in range(300)])
    array, common = quality.suffix_array(words, np.zeros(300, np.int64), np.full(300, 300))
    suffixes = [words[i:].tolist() for i in array]
    assert suffixes == sorted(suffixes)
    for a, b, k in zip(suffixes, suffixes[1:], common[1:], strict=False):
        assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])


def windows(text):
    words = text.split()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_contract_columns(spark, documents):
    line = "one two three four five six seven eight nine ten"
    texts = [None, "", "  \n\t ", line + "\n" + line, " ".join(f"w{i}" for i in range(25)), "é# * $ %&|<>x\x0b\x1cy", ("a b c d e f g h " * 3).strip(), "long " * 3000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(4, texts[4], None, None), (None, texts[4], "en", "s")]
    got = quality.quality_report(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        r = by[i]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["n_repeat_words"] == windows((t or "").replace(" ", "_").replace("\x1c", "_"))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert by[3]["n_dup_lines"] == 1 and by[2]["n_dup_lines"] == 0
    assert by[4]["kept"] and not by[7]["kept"]


def test_keep_good_keeps_columns_and_rows(spark, documents):
    good = " ".join(f"w{i}" for i in range(25))
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (2, "short", "en", "s"), (3, None, None, None)]
    kept = quality.keep_good(documents(rows))
    assert kept.columns == documents(rows).columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert quality.keep_good(documents([])).count() == 0

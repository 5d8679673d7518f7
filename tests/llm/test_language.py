import zlib

import numpy as np
import pytest

from wayline.llm import language
from wayline.llm.queries import QUERIES


def test_gradients_match_differences():
    net = language.fit(["abc def", "xyz"] * 3, ["a", "b"] * 3, steps=1, lanes=4, hidden=3)
    for name in ("W", "U", "b", "V", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = np.stack([language.blocks_of(b"abc")[0], language.blocks_of(b"xyzq w")[0]]).T
    y = np.array([0, 1])
    _, grads = net.gradients(x, y)
    for name, at in (("W", (0, 2, 97)), ("W", (1, 8, 98)), ("U", (0, 4, 1)), ("U", (1, 8, 2)), ("b", (1, 1, 0)), ("V", (1, 3)), ("c", (1, 0))):
        weights = getattr(net, name)
        weights[at] += 1e-4
        up = net.gradients(x, y)[0]
        weights[at] -= 2e-4
        down = net.gradients(x, y)[0]
        weights[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-7)


def plain_states(net, data, way):
    """States of one direction, a byte at a time, from the equations."""
    n = net.U.shape[2]
    h, out = np.zeros(n), []
    for byte in data if way == 0 else data[::-1]:
        a, u = net.W[way, :, byte].astype(float), net.U[way].astype(float)
        z, r = (1 / (1 + np.exp(-(a[i * n : (i + 1) * n] + u[i * n : (i + 1) * n] @ h))) for i in (0, 1))
        new = np.tanh(a[2 * n :] + r * (u[2 * n :] @ h + net.b[way, :, 0]))
        h = (1 - z) * new + z * h
        out.append(h)
    return np.array(out if way == 0 else out[::-1])


def plain_probabilities(net, data):
    """The network run once over the whole text."""
    p = np.hstack([plain_states(net, data, 0), plain_states(net, data, 1)]) @ net.V.T.astype(float) + net.c[:, 0]
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


EN = "the cat and the dog went over the hill to see what there was "
DE = "der Hund und die Katze gingen über den Hügel um zu sehen was war "


def test_windows_agree_with_whole_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = language.fit_languages(docs, steps=150, lanes=128)
    given = [r["text"] for r in docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 and length(text) < 20000").orderBy("doc_id").limit(20).collect()]
    for text in [EN, DE[:5], (EN * 4 + DE * 5) * 6, DE * 4 + "x", *given]:
        data = text.encode()
        want = plain_probabilities(net, data)
        if len(data) <= language.INNER:  # one window: the same run
            assert np.allclose(language._pooled(net, [data])[0][0], want.mean(0), atol=1e-4)
        assert np.allclose(language._pooled(net, [data])[0][0], want.mean(0), atol=0.02)
        labels = language.position_labels(net, text)
        assert len(labels) == len(data)
        assert sum(a == net.languages[g] for a, g in zip(labels, want.argmax(1), strict=True)) >= 0.98 * len(data)


def test_windows_cover_texts_once():
    for n in (0, 1, 5, 11, 12, 13, 60, 61):
        data = bytes(range(n))
        rows = [r for part in language.windows_of(data, inner=6, run_up=2, lanes=2) for r in part]
        assert bytes(b for r in rows for b in r[2:8] if b != language.PAD) == data
        for k, r in enumerate(rows):
            assert list(r) == [data[i] if 0 <= i < n else language.PAD for i in range(6 * k - 2, 6 * k + 8)]


def test_sample_spreads_over_texts_and_labels(spark, documents):
    long = "".join(chr(0x4E00 + i) for i in range(5000))
    rows = [(1, long, "zh", "s"), (2, "short", "zh", "s"), (None, "left out", "zh", "s")] + [(100 + i, f"text {i}", f"l{i:03}", "s") for i in range(100)]
    kept = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = language.labelled_sample(documents(rows), "text", "lang", "doc_id", 150, 60).collect()
    assert {r["g"] for r in got} == {r[2] for r in kept}
    assert "left out" not in {r["t"] for r in got}
    pieces = [r["t"] for r in sorted(got) if len(r["t"]) == language.BLOCK]
    assert len(pieces) == 60 and pieces[0] == long[:64] and pieces[-1] == long[-64:]
    few = language.labelled_sample(documents([(i, f"text {i}", "en", "s") for i in range(400)]), "text", "lang", "doc_id", 20, 60)
    assert few.count() == 20


def test_lanes_do_not_matter():
    net = language.fit(["hello world and more", "der die das und"] * 4, ["en", "de"] * 4, steps=5, lanes=8)
    texts = [b"hello", b"x" * 1000, b"", "grüße ".encode() * 300]
    together, _ = language._pooled(net, texts)
    for t, row in zip(texts, together, strict=True):
        alone, _ = language._pooled(net, [t])
        assert np.allclose(alone[0], row, atol=1e-5)
    labels = language.position_labels(net, "grüße")
    assert len(labels) == 7 and set(labels) <= {"en", "de"}


def test_edges(spark, documents):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !?", "en", "s"), (4, "hello there", None, "s"), (4, "hello there", None, "s"), (None, "und die der", "de", "s")]
    docs = documents(rows)
    net = language.fit(["hello there and the"] * 3 + ["und der die das"] * 3, ["en"] * 3 + ["de"] * 3, steps=40, lanes=32)
    got = language.predict_languages(docs, net).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3))
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and 0 < by[4]["score"] <= 1
    assert {r["lang_pred"] for r in language.predict_languages(docs, None).collect()} == {"und"}
    assert language.keep_known(docs, net, least=0.3).columns == docs.columns
    assert language.fit_languages(documents([])) is None
    assert language.predict_languages(documents([]), None).count() == 0


def test_held_out_accuracy(spark, small):
    got = QUERIES["op2_languages"](spark, small).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)

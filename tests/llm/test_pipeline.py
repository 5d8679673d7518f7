"""The pipeline against a plain version of each stage on the rows that the stage before it kept."""

import corpus_pipeline
from wayline.llm import language, quality
from tests.llm.test_native import poisson
from tests.llm.test_similar import plain_groups

import hashlib
import math


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], small).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert kept[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in d.collect()} for d in kept]
    # quality
    texts = [r["text"] for r in rows[0].values()]
    m = quality._measure(texts, 4)
    want = set()
    for j, i in enumerate(rows[0]):
        n, rep = m["n_words"][j], m["n_repeat_words"][j]
        if n >= 20 and 100 * rep <= 30 * n and m["covered_words"][j] <= 0.5 * n and m["longest_repeat"][j] <= 200:
            want.add(i)
    assert set(rows[1]) == want
    # language: clean documents all stay
    net = language.fit_languages(kept[1])
    said = {r["doc_id"]: r for r in language.predict_languages(kept[1], net).collect()}
    assert set(rows[2]) == {i for i, r in said.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert len(rows[2]) >= 0.99 * len(rows[1])
    # near copies
    ids = sorted(rows[2])
    root = plain_groups([rows[2][i]["text"] for i in ids])
    assert set(rows[3]) == {ids[r] for r in set(root)}
    assert len({r["text"] for r in rows[3].values()}) == len(rows[3])
    # mixing
    sizes = {}
    for r in rows[3].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"]) + 1
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    copies = {}
    for i, r in rows[3].items():
        rate = round(weights[r["source"]] / sum(weights.values()) * sum(sizes.values()) / sizes[r["source"]], 6)
        n = poisson(int(hashlib.md5(f"mix|{i}|1".encode()).hexdigest()[:13], 16) / 16**13, rate)
        if n:
            copies[i] = n
    assert {r["doc_id"]: r["count"] for r in kept[4].groupBy("doc_id").count().collect()} == copies
    # packing: every copy once
    got = {}
    for r in kept[5].collect():
        if r["start"] == 0:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == copies


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and {"sequence_id", "offset", "ids_crc32"} <= set(out.columns)


def test_stages_on_an_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_hand_few_texts_at_a_time_to_python(spark):
    """Whole texts go to Python workers in small batches; a lower number that the user sets stays."""
    from wayline.llm import common, language, packing, quality, similar

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, f"word{i} " * 30, "en") for i in range(4)], "doc_id long, text string, lang string")
    stages = [lambda: quality.keep_good(docs), lambda: language.keep_known(docs, None), lambda: similar.keep_one(docs), lambda: packing.pack_documents(docs)]
    try:
        for stage in stages:
            spark.conf.unset(name)
            stage()
            assert int(spark.conf.get(name)) == common.BATCH_TEXTS
            spark.conf.set(name, "7")
            stage()
            assert spark.conf.get(name) == "7"
    finally:
        spark.conf.unset(name)

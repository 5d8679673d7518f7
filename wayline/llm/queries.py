"""Queries of the operators of this folder on the given tables, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm import chunks, language, licences, merkle, mixing, packing, quality, ranking, runs, simhash, tokencount, urls, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register ``fn`` under its name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document and the paragraph that shows it."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


@query
def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained on those whose crc32 is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.fit_languages(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return language.predict_languages(docs, net).withColumn("held_out", held_out)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document under target shares that go with the square root of a source's size."""
    return mixing.mixed_copies(table(spark, sf_dir, "documents"))


ORACLES["op3_mixing"] = mixing.MIX_SQL


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: three-word shingles, at most two differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


ORACLES["op5_fingerprints"] = merkle.MERKLE_SQL


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to deduplicated archives and read back."""
    folder = warc.new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolved_records(warc.read_archives(spark, folder))


ORACLES["op7_warc"] = warc.WARC_SQL


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


ORACLES["op8_urls"] = urls.URLS_SQL


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document, words of any length among them."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, repetition and verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document and the document that stays."""
    return chunks.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op11_exact"] = chunks.EXACT_SQL


@query
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranking.rank_items(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLES["op12_ranking"] = ranking.RANK_SQL


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten of which is made to repeat itself."""
    return runs.run_digests(runs.find_runs(runs.with_loops(table(spark, sf_dir, "documents"))))

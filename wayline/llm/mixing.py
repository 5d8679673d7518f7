"""Mixing sources to target weights by Poisson replication, with built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.common import cut_lineage, free_name, sized_join

#: a rate above this is drawn as the sum of several Poisson counts, so that exp(-rate) stays exact
MOST_RATE = 32.0


def uniform(*parts: Column) -> Column:
    """Evenly spread number in [0, 1) from the md5 of the parts: its first 13 hexadecimal digits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(16**13)


def source_rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None, alpha: float) -> DataFrame:
    """``_key``, ``rate`` and ``cdf`` of each source: its mean number of copies, and the distribution of a draw.

    A source's size is its characters plus one for each row. Its target share is
    ``weights[source]`` (sources not named have none), or its size to the power
    ``alpha`` where no weights are given; the sum of sizes stays the same on average.
    """
    sizes = docs.groupBy(_key(F.col(source)).alias("_key")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1).alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("_key") == "=" + name, F.lit(float(w))).otherwise(weight)
    sizes = cut_lineage(sizes.withColumn("_weight", weight))
    total = sizes.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    rated = sizes.crossJoin(F.broadcast(total))  # one row of sums
    rate = F.coalesce(F.round(F.col("_weight") / F.col("_weights") * F.col("_all") / F.col("_size"), 6), F.lit(0.0))
    rated = rated.withColumn("rate", rate).withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int"))
    each = F.col("rate") / F.col("_draws")
    reach = F.ceil(each + 12 * F.sqrt(each) + 24).cast("int")
    first = F.exp(-each)
    steps = F.aggregate(
        F.sequence(F.lit(1), reach),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda s, k: F.struct(
            (s["p"] * each / k).alias("p"), (s["c"] + s["p"] * each / k).alias("c"), F.concat(s["cdf"], F.array(s["c"] + s["p"] * each / k)).alias("cdf")
        ),
        lambda s: s["cdf"],
    )
    return cut_lineage(rated.select("_key", "rate", "_draws", steps.alias("cdf")))


def _key(source: Column) -> Column:
    """Sources as join keys: rows without a source are a source of their own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def replicate(
    docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text",
    weights: Mapping[str, float] | None = None, alpha: float = 0.5, seed: str = "mix",
) -> DataFrame:
    """Rows of ``docs`` as often as drawn, with struct ``_mix`` (rate, n_copies, copy_no, shuffle_key), not in order yet.

    A row's count inverts the Poisson distribution with its source's rate at a
    number hashed from ``seed`` and its id, so it depends on no partitioning and
    comes out the same on every try. Rows that repeat an id get equal counts;
    null ids hash like the word null. Rows drawn zero times go.
    """
    taken = free_name(docs, "_key")
    keyed = docs.withColumn(taken, _key(F.col(source)))
    rates = source_rates(docs, source, text, weights, alpha).select(F.col("_key").alias(taken), F.struct("rate", "_draws", "cdf").alias(free_name(docs, "_rates")))
    joined = sized_join(keyed, rates, [taken])
    r = F.col(free_name(docs, "_rates"))
    name = F.coalesce(F.col(ident).cast("string"), F.lit("null"))

    def drawn(part: Column) -> Column:
        u = uniform(F.lit(seed), name, part.cast("string"))
        return F.size(F.filter(r["cdf"], lambda c: c <= u))

    more = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), r["_draws"])), F.lit(0), lambda n, part: n + F.when(part <= r["_draws"], drawn(part)).otherwise(0))
    count = drawn(F.lit(1)) + F.when(r["_draws"] > 1, more).otherwise(0)
    n, k, mixed = free_name(docs, "_n"), free_name(docs, "_copy"), free_name(docs, "_mix")
    counted = joined.withColumn(n, F.when(r["rate"] > 0, count).otherwise(0)).where(F.col(n) > 0)
    copies = counted.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.md5(F.concat_ws("|", F.lit(seed + "-order"), name, F.col(k).cast("string")))
    mix = F.struct(r["rate"].alias("rate"), F.col(n).alias("n_copies"), F.col(k).alias("copy_no"), key.alias("shuffle_key"))
    return copies.select(*docs.columns, mix.alias(mixed))


def mixed_copies(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", **kind) -> DataFrame:
    """Id, source, rate, number of copies, copy and shuffle key of every copy, in the order of the shuffle."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    out = replicate(rows, "doc_id", "source", "text", **kind).select("doc_id", "source", "_mix.*")
    return out.orderBy("shuffle_key", "doc_id", "copy_no")


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", **kind) -> DataFrame:
    """The copies of whole rows in the order of the global shuffle, with the columns of ``docs``."""
    name = free_name(docs, "_mix")
    return replicate(docs, ident, source, text, **kind).orderBy(f"{name}.shuffle_key", ident).select(*docs.columns)


#: the query's result in DuckDB; the draws for rates above 32 are summed like in the operator
MIX_SQL = """
WITH sizes AS (SELECT source, SUM(COALESCE(length(text), 0) + 1) AS size FROM documents GROUP BY source),
sums AS (SELECT SUM(size) AS total, SUM(pow(size::DOUBLE, 0.5e0)) AS weights FROM sizes),
rated AS (SELECT source, round(pow(size::DOUBLE, 0.5e0) / weights * total::DOUBLE / size::DOUBLE, 6) AS rate FROM sizes, sums),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 32e0)) AS INTEGER) AS draws FROM rated),
cdf AS (
  SELECT source, rate, draws, k, SUM(exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, range(0, 240) AS t(k) WHERE rate > 0),
hashed AS (
  SELECT d.doc_id, d.source, p.rate, CAST(('0x' || substr(md5('mix|' || d.doc_id || '|' || part), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496e0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.draws + 1) AS t(part)),
counted AS (
  SELECT h.doc_id, h.source, h.rate, CAST(count(*) AS INTEGER) AS n_copies
  FROM hashed h JOIN cdf b ON h.source IS NOT DISTINCT FROM b.source AND b.c <= h.u GROUP BY h.doc_id, h.source, h.rate)
SELECT doc_id, source, rate, n_copies, CAST(k AS INTEGER) AS copy_no, md5('mix-order|' || doc_id || '|' || k) AS shuffle_key
FROM counted, range(1, n_copies + 1) AS t(k)
"""

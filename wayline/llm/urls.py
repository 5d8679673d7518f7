"""URL filter from two character language models, with built-in functions only.

URLs that fit a host and path rule are the training material: those allowed and
those blocked. For each class a variable-order Markov model over characters is
smoothed by interpolation with its shorter contexts (Witten and Bell). URLs
without a rule go by the difference of both log-likelihoods per character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.llm.common import cut_lineage, sized_join

#: rules of the query: verdict, host and path together
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: scores are summed as whole numbers of this size, so the order of the terms does not matter
UNIT = 1e-9
START, END = "\x02", "\x03"
LETTERS = 256


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits (the first of equally long ones); null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(texts: DataFrame, order: int) -> DataFrame:
    """Every text character with the ``order`` characters before it as ``gram``; ``t`` and other columns stay."""
    padded = F.concat(F.lit(START * order), "t", F.lit(END))
    at = F.sequence(F.lit(1), F.length("t") + 1)
    return texts.withColumn("_s", padded).withColumn("gram", F.explode(F.transform(at, lambda i: F.substring("_s", i, F.lit(order + 1))))).drop("_s")


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """``gram``, ``llr`` (whole units of ``UNIT``): log-likelihood ratio of the last character, for every gram in ``counts``.

    ``counts`` has a row per gram with its number in accepted (``a``) and
    rejected (``r``) URLs, zero in both for grams met in other URLs only. From
    no context up, a class's probability is (n + followers * shorter) / (all + followers),
    where followers is the number of different characters seen after the
    context; a context never seen leaves the shorter one's probability.
    """
    table = counts.select("gram", *[F.lit(1.0 / LETTERS).alias(f"p{c}") for c in "ar"])
    for size in range(1, order + 2):
        tail = F.expr(f"right(gram, {size})")
        seen = counts.groupBy(tail.alias("g")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        seen = seen.withColumn("ctx", F.expr(f"left(g, {size - 1})"))
        of = seen.groupBy("ctx").agg(
            *[F.sum(f"n{c}").alias(f"all{c}") for c in "ar"], *[F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).alias(f"kinds{c}") for c in "ar"]
        )
        level = cut_lineage(seen.join(of, "ctx").drop("ctx"))
        table = sized_join(table.withColumn("g", tail), level, ["g"])
        for c in "ar":
            p = (F.col(f"n{c}") + F.col(f"kinds{c}") * F.col(f"p{c}")) / (F.col(f"all{c}") + F.col(f"kinds{c}"))
            table = table.withColumn(f"p{c}", F.when(F.col(f"all{c}") > 0, p).otherwise(F.col(f"p{c}")))
        table = table.select("gram", "pa", "pr")
    return table.select("gram", F.round(F.log(F.col("pa") / F.col("pr")) / UNIT).cast("bigint").alias("llr"))


def text_scores(texts: DataFrame, order: int) -> DataFrame:
    """``t``, ``label``, ``fold`` and ``score`` (per character) of distinct checkpointed texts; models leave out fold 2.

    All of it grows with the number of different texts and different grams.
    """
    of = grams(texts.where("t <> ''"), order)
    learn = (F.col("fold") != 2) & F.col("label").isNotNull()
    counts = of.groupBy("gram").agg(
        F.sum(F.when(learn & (F.col("label") == "allow"), 1).otherwise(0)).alias("a"), F.sum(F.when(learn & (F.col("label") == "block"), 1).otherwise(0)).alias("r")
    )
    table = cut_lineage(gram_scores(cut_lineage(counts), order))
    sums = sized_join(of, table, ["gram"]).groupBy("t").agg((F.sum("llr") * UNIT / F.count("*")).alias("score"))
    return texts.join(sums, "t", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))


def calibrated_threshold(scored: DataFrame, step: float = 0.05, reach: int = 200) -> float:
    """The multiple of ``step`` with the smallest mean error of both classes on the held-out fold (2) of labelled texts.

    At most ``2 * reach + 1`` steps and one row of each are looked at; the one
    nearest zero wins ties. Zero if a class has no held-out texts.
    """
    bin_no = F.greatest(F.lit(-reach), F.least(F.lit(reach), F.floor(F.col("score") / step))).cast("int")
    rows = scored.where("fold = 2 AND label IS NOT NULL").groupBy(bin_no.alias("k")).agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("r")
    ).collect()
    every = [sum(r[c] for r in rows) for c in "ar"]
    if not all(every):
        return 0.0

    def error(k: int) -> float:
        return sum(r["a"] for r in rows if r["k"] < k) / every[0] + sum(r["r"] for r in rows if r["k"] >= k) / every[1]

    return min(range(-reach, reach + 1), key=lambda k: (round(error(k), 9), abs(k), k)) * step


def judge_urls(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules: Sequence[tuple[str, str]] = RULES, order: int = 3) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``threshold`` of every row.

    The rule's verdict, else allow if the score reaches the threshold. The models
    read whole URLs, query string and fragment too, whether they hold a host or
    not; null and empty ones score 0. Fold is crc32 of the URL modulo 4. Without rules for both classes every score is near 0 and
    the threshold 0. Repeated rows stay repeated.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    texts = rows.groupBy("t").agg(F.max("_rule.verdict").alias("label"), F.max(F.crc32(F.col("t").cast("binary")) % 4).alias("fold"))
    # each text becomes as many rows as it has characters, so their tasks are not merged by size
    texts = cut_lineage(texts.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t"))
    scored = cut_lineage(text_scores(texts, order))
    bound = calibrated_threshold(scored)
    judged = rows.join(scored.select("t", "score"), "t")
    method = F.when(F.col("score") >= bound, "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "score", F.lit(bound).alias("threshold")
    )


def _levels_sql(order: int) -> str:
    """Probabilities of both classes level by level in SQL, like :func:`gram_scores`."""
    out = ["p0 AS (SELECT gram, 1e0 / 256 AS pa, 1e0 / 256 AS pr FROM counts)"]
    for k in range(1, order + 2):
        out.append(f"seen{k} AS (SELECT right(gram, {k}) AS g, left(right(gram, {k}), {k - 1}) AS ctx, SUM(a) AS na, SUM(r) AS nr FROM counts GROUP BY ALL)")
        out.append(f"of{k} AS (SELECT ctx, SUM(na) AS alla, SUM(nr) AS allr, SUM((na > 0)::INT) AS ka, SUM((nr > 0)::INT) AS kr FROM seen{k} GROUP BY ctx)")
        p = [f"CASE WHEN all{c} > 0 THEN (n{c} + k{c} * p{c}) / (all{c} + k{c})::DOUBLE ELSE p{c} END AS p{c}" for c in "ar"]
        out.append(f"p{k} AS (SELECT gram, {', '.join(p)} FROM p{k - 1} JOIN seen{k} ON g = right(gram, {k}) JOIN of{k} USING (ctx))")
    return ",\n".join(out)


URLS_SQL = f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS t, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (
  SELECT page_id, t, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, verdict) AS (VALUES {', '.join(f"('{r}', '{v}')" for v, r in RULES)}),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS label
  FROM (SELECT DISTINCT host, path FROM rows), rules
  WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY host, path),
ruled AS (SELECT r.*, f.rule, f.label FROM rows r LEFT JOIN fits f ON r.host = f.host AND r.path = f.path),
bytes AS (SELECT t, max(label) AS label FROM ruled GROUP BY t),
crc_table AS (
  WITH RECURSIVE steps(n, k, c) AS (
    SELECT n, 0, n FROM range(0, 256) AS r(n)
    UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8)
  SELECT n, c FROM steps WHERE k = 8),
hexed AS (SELECT t, label, hex(encode(t)) AS h FROM bytes),
crc AS (
  WITH RECURSIVE walk(t, h, i, c) AS (
    SELECT t, h, 0, 4294967295::BIGINT FROM hexed
    UNION ALL SELECT w.t, w.h, w.i + 1, xor(w.c >> 8, x.c)
    FROM walk w JOIN crc_table x ON x.n = xor(w.c & 255, ('0x' || substr(w.h, 2 * w.i + 1, 2))::BIGINT) WHERE 2 * w.i < length(w.h))
  SELECT t, xor(c, 4294967295) AS crc FROM walk WHERE 2 * i = length(h)),
texts AS (SELECT b.t, b.label, c.crc % 4 AS fold FROM bytes b JOIN crc c USING (t)),
grams AS (SELECT t, label, fold, substr(repeat(chr(2), 3) || t || chr(3), i::INT, 4) AS gram FROM texts, range(1, length(t) + 2) AS r(i) WHERE t <> ''),
counts AS (
  SELECT gram, SUM((coalesce(label, '') = 'allow' AND fold <> 2)::INT) AS a, SUM((coalesce(label, '') = 'block' AND fold <> 2)::INT) AS r FROM grams GROUP BY gram),
{_levels_sql(3)},
sums AS (SELECT t, SUM(CAST(round(ln(pa / pr) / 1e-9) AS BIGINT)) * 1e-9 / count(*) AS score FROM grams JOIN p4 USING (gram) GROUP BY t),
scored AS (SELECT x.*, round(coalesce(s.score, 0e0), 6) AS score FROM texts x LEFT JOIN sums s USING (t)),
held AS (SELECT label, floor(score / 0.05e0) AS k FROM scored WHERE fold = 2 AND label IS NOT NULL),
tried AS (
  SELECT s.k, round(SUM((label = 'allow' AND h.k < s.k)::INT) / SUM((label = 'allow')::INT)::DOUBLE
    + SUM((label = 'block' AND h.k >= s.k)::INT) / SUM((label = 'block')::INT)::DOUBLE, 9) AS error
  FROM range(-200, 201) AS s(k), held h GROUP BY s.k),
best AS (SELECT coalesce((SELECT k FROM tried WHERE error IS NOT NULL AND NOT isnan(error) ORDER BY error, abs(k), k LIMIT 1), 0) * 0.05e0 AS threshold)
SELECT page_id, host, path, rule, coalesce(r.label, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score, threshold
FROM ruled r JOIN scored s USING (t), best
"""

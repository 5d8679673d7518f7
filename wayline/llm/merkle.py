"""Document fingerprints as Merkle trees over sections, paragraphs and sentences, with built-in functions only.

A text's lines are its paragraphs. A paragraph is cut behind sentence ends into
leaves; a longer stretch without one is cut further behind words that end in one
of some letters, and where there are none, into pieces. A section ends at a blank line and
behind paragraphs whose last leaf hash says so, by content and not by count, so
that an insertion moves no later border. Whole leaf digests are hashed to
paragraphs, these to sections and these to the root, so equal roots are equal
texts. The fingerprint shows the root's hash and then the begins of the leaf
hashes with marks at the ends of paragraphs and sections: where roots differ the
branches tell which sections and leaves do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.llm.common import cut_lineage

#: hexadecimal digits of a leaf hash in the fingerprint
LEAF = 12
#: a leaf ends behind a line break, or behind the blank after a sentence end
LEAF_END = r"(?<=\n)|(?<=[.!?][ ])"
#: marks in the fingerprint
SENTENCE, PARAGRAPH, SECTION = ".", ",", ";"


#: a leaf of more characters is cut further: behind words that end in one of some letters, and every ``PIECE`` characters at the latest
LONG, PIECE, LETTERS = 100, 64, "cfgkmpvz"


def fingerprint(text: Column) -> Column:
    """``root:tree`` of a whole text; null is empty. The tree holds, for each leaf in order, its hash's begin and its end mark.

    Inner hashes go over the whole hashes below: a paragraph's over its leaves,
    a section's over its paragraphs, the root's over all sections.
    """
    natural = F.split(F.coalesce(text, F.lit("")), LEAF_END)
    pieces = f"(?s)(?<=[{LETTERS}][ ])|(?<=\\G.{{{PIECE}}})"
    leaves = F.flatten(F.transform(natural, lambda x: F.when(F.length(x) > LONG, F.split(x, pieces)).otherwise(F.array(x))))

    def named(leaf: Column) -> Column:
        h = F.sha2(leaf, 256)
        paragraph = leaf.endswith("\n")
        # a blank line, or a digit of 0 or 1 (one in eight), closes the section
        digit = F.substring(h, LEAF, 1)
        section = paragraph & ((leaf == "\n") | (digit == "0") | (digit == "1"))
        return F.concat(h, F.when(section, SECTION).when(paragraph, PARAGRAPH).otherwise(SENTENCE))

    def assembled(hashes: Column) -> Column:
        tree = F.array_join(F.transform(hashes, lambda h: F.concat(F.substring(h, 1, LEAF), F.substring(h, 65, 1))), "")
        parts = F.split(F.array_join(hashes, ""), SECTION)
        sections = F.transform(parts, lambda s: F.sha2(F.array_join(F.transform(F.split(s, PARAGRAPH), lambda p: F.sha2(p, 256)), ""), 256))
        return F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), tree)

    # the leaves are hashed once, though both parts of the fingerprint need them
    return F.get(F.transform(F.array(F.transform(F.filter(leaves, lambda x: x != ""), named)), assembled), F.lit(0))


def root(print_: Column) -> Column:
    """The root's hash; texts are equal when their roots are."""
    return F.substring(print_, 1, 64)


def sections(print_: Column) -> Column:
    """The sections' parts of the tree, in order."""
    return F.split(F.substring(print_, 66, 1 << 30), SECTION)


def leaves(print_: Column) -> Column:
    """Leaf hashes in order, without marks."""
    return F.filter(F.split(F.substring(print_, 66, 1 << 30), "[.,;]"), lambda x: x != "")


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of ``a`` that ``b`` does not have anywhere: the differing branches to go down."""
    other = sections(b)
    numbered = F.transform(sections(a), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    missing = F.array_except(sections(a), other)
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(
        F.transform(F.filter(numbered, lambda x: F.array_contains(missing, x["s"])), lambda x: x["i"])
    )


def changed_leaves(a: Column, b: Column) -> Column:
    """Leaf hashes of ``a`` that ``b`` does not have, in order."""
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(F.array_except(leaves(a), leaves(b)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: 1 for equal roots, else the share of common leaves (Dice, different leaves).

    Different texts stay below 1 even if they have the same leaves in another
    order or number.
    """
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    n = F.size(x) + F.size(y)
    share = 2.0 * F.size(F.array_intersect(x, y)) / n
    return F.when(root(a) == root(b), 1.0).when(n == 0, 0.0).otherwise(F.least(share, F.lit(1 - 1e-6)))


def next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rn``, ``n``, ``next_id``, ``next_rn``: each row's successor in descending order of ids; the last goes to the first.

    ``docs`` has ``doc_id``, ``rn`` (number among rows of one id) and ``n``. Ids
    are sorted globally, without texts; numbered rows of a sorted partition are
    neighbours, and only the first rows of the partitions meet in one place: as
    many as there are partitions. Rows without id come last.
    """
    placed = docs.orderBy(F.desc_nulls_last("doc_id"), "rn").withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("part", F.shiftright("at", 33)))
    target = F.struct(F.col("doc_id").alias("next_id"), F.col("rn").alias("next_rn"))
    inside = placed.withColumn("next", F.lead(target).over(Window.partitionBy("part").orderBy("at")))
    firsts = placed.groupBy("part").agg(F.min_by(target, "at").alias("own"))
    order = Window.orderBy("part")  # one row a partition
    follow = F.coalesce(F.lead("own").over(order), F.first("own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.select("part", follow.alias("after"))
    return inside.join(F.broadcast(ends), "part").select("doc_id", "rn", "n", F.coalesce("next", "after").alias("next")).select("doc_id", "rn", "n", "next.*")


def _never_null(ident: str) -> Column:
    return F.coalesce(F.col(ident).cast("string"), F.lit("none"))


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document; see the contract.

    Null texts are empty. Rows that repeat an id follow each other in the order
    of length and hash of their texts. A single document is its own successor.
    Texts are shuffled once by id, and the part that an edit needs a second time.
    """
    whole = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = whole.withColumns({"n": F.length("text").cast("bigint"), "h": F.xxhash64("text")})
    ids = whole.select("doc_id", "n", "h").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h")))
    follow = cut_lineage(next_documents(ids.select("doc_id", "rn", "n")))
    # one shuffle by a key without nulls serves the numbering and both joins: a row's number is compared outside the keys
    number = F.row_number().over(Window.partitionBy("key").orderBy("n", "h"))
    texts = whole.select(_never_null("doc_id").alias("key"), "text", "n", "h").withColumn("rn", number)
    need = follow.select(_never_null("next_id").alias("from_key"), "next_rn", _never_null("doc_id").alias("to_key"), F.col("rn").alias("to_rn"), F.floor(F.col("n") / 2).alias("need"))
    given = texts.join(need, (F.col("key") == F.col("from_key")) & (F.col("rn") - F.col("next_rn") == 0))
    given = given.select("to_key", "to_rn", F.expr("left(text, cast(need AS INT))").alias("tail"), fingerprint(F.col("text")).alias("next_print"))
    both = texts.join(given, (F.col("key") == F.col("to_key")) & (F.col("rn") - F.col("to_rn") == 0)).withColumn("fingerprint", fingerprint(F.col("text")))
    edited = F.concat(F.expr("left(text, cast(n - floor(n / 2) AS INT))"), F.col("tail"))
    out = both.withColumn("_edited", edited).select(
        F.expr("try_cast(key AS BIGINT)").alias("doc_id"), F.col("n").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("_edited")).alias("edited_fingerprint"), "next_print"
    )
    return out.withColumns(
        {
            "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
            "near_next": likeness(F.col("fingerprint"), F.col("next_print")),
            "changed_sections": F.size(changed_sections(F.col("fingerprint"), F.col("edited_fingerprint"))),
            "changed_leaves": F.size(changed_leaves(F.col("fingerprint"), F.col("edited_fingerprint"))),
        }
    ).drop("next_print")


def _print_sql(text: str, key: str, name: str) -> str:
    """CTEs that end in ``name(key, p)``: the fingerprint in SQL by cutting at marked leaf ends."""
    pieces = f"flatten(list_transform(string_split(regexp_replace(leaf, '([{LETTERS}] )', '\\1' || chr(2), 'g'), chr(2)), lambda r: regexp_extract_all(r, '(?s).{{1,{PIECE}}}')))"
    return f"""
{name}_natural AS (
  SELECT {key}, u.i, u.leaf FROM (SELECT {key}, string_split(regexp_replace({text}, '(\\n|[.!?] )', '\\1' || chr(2), 'g'), chr(2)) AS xs FROM {name}_in) s,
    LATERAL (SELECT unnest(xs) AS leaf, generate_subscripts(xs, 1) AS i) u WHERE u.leaf <> ''),
{name}_leaf AS (
  SELECT {key}, i, u.j, u.leaf FROM (SELECT {key}, i, CASE WHEN length(leaf) > {LONG} THEN {pieces} ELSE [leaf] END AS xs FROM {name}_natural) s,
    LATERAL (SELECT unnest(xs) AS leaf, generate_subscripts(xs, 1) AS j) u WHERE u.leaf <> ''),
{name}_hash AS (SELECT {key}, i, j, leaf, sha256(leaf) AS h FROM {name}_leaf),
{name}_mark AS (
  SELECT {key}, i, j, h, CASE WHEN ends_with(leaf, chr(10)) AND (leaf = chr(10) OR substr(h, {LEAF}, 1) IN ('0', '1')) THEN ';' WHEN ends_with(leaf, chr(10)) THEN ',' ELSE '.' END AS m
  FROM {name}_hash),
{name}_tree AS (SELECT {key}, string_agg(substr(h, 1, {LEAF}) || m, '' ORDER BY i, j) AS tree, string_agg(h || m, '' ORDER BY i, j) AS whole FROM {name}_mark GROUP BY {key}),
{name}_full AS (SELECT s.{key}, coalesce(t.tree, '') AS tree, coalesce(t.whole, '') AS whole FROM {name}_in s LEFT JOIN {name}_tree t USING ({key})),
{name}_section AS (
  SELECT {key}, u.i, sha256(array_to_string(list_transform(string_split(u.part, ','), lambda p: sha256(p)), '')) AS h FROM (SELECT {key}, string_split(whole, ';') AS xs FROM {name}_full) s,
    LATERAL (SELECT unnest(xs) AS part, generate_subscripts(xs, 1) AS i) u),
{name} AS (SELECT {key}, sha256(string_agg(h, '' ORDER BY i)) || ':' || any_value(tree) AS p FROM {name}_section JOIN {name}_full USING ({key}) GROUP BY {key})"""


def _near_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split(translate(substr({p}, 66), ',;', '..'), '.'), lambda v: v <> ''))" for p in (a, b))
    return (
        f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1e0 WHEN len({x}) + len({y}) = 0 THEN 0e0 "
        f"ELSE least(2e0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})), 1 - 1e-6) END"
    )


def _missing_sql(a: str, b: str, cut: str) -> str:
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 0 ELSE {cut} END"


#: for tables with one row per id
MERKLE_SQL = f"""
WITH own_in AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ring AS (
  SELECT doc_id, text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM own_in
  WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
new_in AS (SELECT r.doc_id, left(r.text, length(r.text) - length(r.text) // 2) || left(x.text, length(r.text) // 2) AS text FROM ring r JOIN own_in x ON x.doc_id = r.next_id),
{_print_sql("text", "doc_id", "own")},
{_print_sql("text", "doc_id", "new")},
joined AS (
  SELECT r.doc_id, length(r.text) AS n_chars, sha256(i.text) AS edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint, c.p AS next_print
  FROM ring r JOIN new_in i USING (doc_id) JOIN own a USING (doc_id) JOIN new b USING (doc_id) JOIN own c ON c.doc_id = r.next_id)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_near_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_near_sql("fingerprint", "next_print")} AS near_next,
  CAST({_missing_sql("fingerprint", "edited_fingerprint", "len(list_filter(string_split(substr(fingerprint, 66), ';'), lambda v: NOT list_contains(string_split(substr(edited_fingerprint, 66), ';'), v)))")} AS INTEGER) AS changed_sections,
  CAST({_missing_sql("fingerprint", "edited_fingerprint", "len(list_filter(list_distinct(list_filter(string_split(translate(substr(fingerprint, 66), ',;', '..'), '.'), lambda v: v <> '')), lambda v: NOT list_contains(string_split(translate(substr(edited_fingerprint, 66), ',;', '..'), '.'), v)))")} AS INTEGER) AS changed_leaves
FROM joined
"""

import pytest

CLASHING = ["fingerprint", "_i", "_h", "_s", "_t", "_id", "_hash", "_row", "_salt", "_key", "_n", "_mix", "_quality", "id", "hash", "root", "fp", "leaf", "recipe", "keep_id", "score", "rank", "item_id"]


@pytest.fixture
def documents(spark):
    """Rows with nulls, ties, repeated rows, empty texts and extra columns that clash with names used inside."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, g, s in rows], schema)

    return build

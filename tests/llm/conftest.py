import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) or (doc_id, text, lang, source) -> a documents table."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 9973} tail{i}" for i in range(120_000))
    rows = [(1, "alpha beta gamma delta " * 20), (1, "alpha beta gamma delta " * 20), (2, None), (None, "orphan text of no id"), (None, None),
            (3, ""), (4, " \t\n "), (5, long), (6, long), (7, "One line.\nOne line.\n\n$$$ ### x"), (8, "é" * 50, None, None), (9, "x", "fr", "src2"),
            (10, "\x00  odd\x1cspace \U0001f600 <|im_end|> <|endoftext|>"), (1, "another text with the same id")]
    df = make_docs(rows)
    for c in ("text_hash", "least", "root", "fp", "anchor", "epoch", "domain", "n_tokens", "label", "y", "weight", "key", "start", "at", "h", "score", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], DOCS)

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
NASTY = [
    "", None, " ", "one", "a b  c\t\n d", "x" * 5000, "é ü ß — “q” 日本 語 z w", "<|im_end|> \\ <\\| |", "\n\n\n",
    "same words here " * 40, "same words here " * 40, "word " * 30000, "a\x1cb \x85 c", "😀 emoji 😀", "tail ",
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, odd columns."""
    rows = [(i, t, "en", "s%d" % (i % 3), 7) for i, t in enumerate(NASTY)]
    rows += [(50, "text of unknown language", None, None, None), (51, None, None, "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr(
        "*", "1 AS size", "'x' AS code", "'y' AS taken", "0 AS n", "0 AS rank")


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet'").fetchall()

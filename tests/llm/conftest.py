from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "labels")


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts(duck) -> dict:
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns whose names operators might use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "   \t\n ", "en", "a", 6), (4, "one", "en", "b", 3),
        (5, "one two three four", "en", "b", 18), (6, "ONE two Three four", "en", "b", 18), (7, long, "en", "c", len(long)),
        (8, long + " tail", "en", "c", len(long) + 5), (9, passage, "en", "a", len(passage)), (9, passage, "en", "a", len(passage)),
        (None, passage, "en", "a", len(passage)), (10, "Intro. " + passage + " Mr. John Smith, john.smith@mail.example.com, +1 (368) 555-0098.", "en", None, 1),
        (11, "call 1-368? Frau Anna Maria Berg wrote: password=abcdef123 and 10.20.30.40; Mr Smith agreed", "de", "d", 1),
        (12, "ünïcödé ✓ 漢字 text with nbsp", "en", "a", 1), (-5, "negative id", "en", "a", 11),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, columns)
    from pyspark.sql import functions as F
    extra = ("mix", "of_source", "copy", "n_entities", "text_hash", "new_parts", "kept_id", "repeated", "nth", "expected_grade", "p_grade_1",
             "p_grade_2", "target", "size", "key", "halo", "bucket", "chunk", "sig", "MIX")
    return df.select("*", *[F.lit(f"extra {i}").alias(f"{c}" if c != "MIX" else "MIX_") for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)

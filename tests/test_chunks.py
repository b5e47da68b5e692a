"""Chunks and page packs of odd documents against their SQL."""

import duckdb
import pytest

from gradeloom import catalog
from tests.oracle import compare

catalog.load()

LINE = "an even line of text " * 3
TEXTS = {
    "chunk_docs": [None, "", " \n\r", "short", " kept　", "\u000bkept", "x" * 1500 + "\n" * 6000 + "y" * 3000, ("z" * 199 + " ") * 60,
                   "\n".join(f" {LINE * 5}　" for _ in range(30)), "a\r\nb" * 2000],
    "pack_pages": [None, "", " ", "\n".join(LINE for _ in range(1100)), "\n".join(f"{LINE * 5} " for _ in range(60)),
                   "\n".join(f"[[PAGE {i}]] {i}. {LINE * 4}" for i in range(80)), "w" * 9000 + "\n" + "\n" * 1050, "a\r\nb" * 300]}


@pytest.mark.parametrize("name", TEXTS)
def test_odd_documents_equal_their_sql(spark, tmp_path, name):
    """No text, blank text and pieces, white space beyond ASCII, page marks inside a line, pages of four digits."""
    spark.createDataFrame(list(enumerate(TEXTS[name])), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, note = compare(catalog.QUERIES[name], catalog.CHECKS[name], spark, str(tmp_path), con)
    assert ok, note


def test_the_operator_keeps_the_rules_of_the_product(spark):
    """The operators keep the product's rules by default: all kinds of white space, no gap for a blank piece."""
    from pyspark.sql import functions as F

    from gradeloom.operators import chunks
    rows = spark.createDataFrame([(" kept　",), ("",), ("x" * 1500 + "\n" * 6000 + "y" * 3000,)], "t string")
    kept, blank, gap = (r.c for r in rows.select(chunks.overlapping_chunks(F.col("t"), 2000, 200).alias("c")).collect())
    assert kept == ["kept"] and blank == [""] and all(gap)

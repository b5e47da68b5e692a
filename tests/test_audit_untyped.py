"""Audit of papers without a blueprint whose questions have several labels, against the check SQL."""

import os

import duckdb

from gradeloom import catalog
from tests.oracle import compare, duck

catalog.load()
SF = "/root/testdata/sf0.001"


def test_untyped_questions_with_several_labels(spark, tmp_path):
    for file in os.listdir(SF):
        if file != "part.parquet":
            os.symlink(f"{SF}/{file}", f"{tmp_path}/{file}")
    # Brand#3: all BA; Brand#7: C and BA; Brand#11: one without answer; Brand#2: types known.
    duckdb.sql(f"""COPY (SELECT (b * 970 + i)::BIGINT AS p_partkey, 'a part' AS p_name, 'Brand#' || b AS p_brand, 'SMALL' AS p_type,
      (CASE WHEN b = 11 AND i = 5 THEN 6 WHEN b = 3 OR i % 2 = 0 THEN 1 ELSE 2 END)::INTEGER AS p_size, 1.0::DOUBLE AS p_retailprice
      FROM (SELECT unnest([2, 3, 7, 11]) AS b), (SELECT unnest(range(97)) AS i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    ok, note = compare(catalog.QUERIES["audit_papers"], catalog.CHECKS["audit_papers"], spark, str(tmp_path), duck(str(tmp_path)))
    assert ok, note

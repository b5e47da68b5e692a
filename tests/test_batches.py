"""Texts reach Python in batches bounded by bytes."""

import pandas as pd
from gradeloom.session import tune
from pyspark.sql import functions as F


def test_long_texts_do_not_share_one_batch(spark):
    @F.pandas_udf("long")
    def held(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    rows = tune(spark).range(0, 40, 1, 1).select(F.repeat(F.lit("x"), F.lit(1_000_000)).alias("t"))
    sizes = [r.n for r in rows.select(held("t").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) <= 6_000_000

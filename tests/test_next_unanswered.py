"""Free places of long, mostly full bitmaps."""

from gradeloom.operators import learn
from pyspark.sql import functions as F


def test_first_free_places_of_full_and_open_bitmaps(spark):
    size = 40_000  # a second bucket
    places = spark.range(size).select(F.lit("b").alias("bank"), F.col("id").alias("question"), F.col("id").alias("place"))
    left = {1: [], 2: [0], 3: [9, 31_000, 39_999], 4: [255, 256, 263, 264, 32_767, 32_768, 39_998], 5: list(range(size))}
    rows = spark.range(size).select("id", F.explode(F.array(*[F.lit(u) for u in (1, 2, 3, 4)])).alias("user"))
    open_ = spark.createDataFrame([(u, q) for u in (2, 3, 4) for q in left[u]], "user int, id bigint")
    done = rows.join(F.broadcast(open_), ["user", "id"], "left_anti").select("user", F.col("id").alias("question"))
    bits = learn.answered_bitmaps(done, places, "user", "bank", "question")
    enrolled = spark.createDataFrame([(u, "b") for u in left], "user int, bank string")
    for k in (1, 5):
        out = learn.next_unanswered(enrolled, places, bits, "user", "bank", "question", k)
        got = {}
        for r in out.collect():
            got.setdefault(r.user, []).append(r.question)
        assert {u: sorted(q) for u, q in got.items()} == {u: q[:k] for u, q in left.items() if q}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(transform(" in plan and "size(transform(" not in plan and "sequence(0, (cast(ceil" not in plan

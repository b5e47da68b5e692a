"""Prose of an import is parsed in as many tasks as it has rows for, not row groups."""

from gradeloom import catalog

catalog.load()


def test_prose_is_dealt_by_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    tasks = spark.conf.get("spark.gradeloom.text.partitions", None)
    spark.conf.unset("spark.gradeloom.text.partitions")
    try:
        plan = catalog.QUERIES["import_report"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        if tasks:
            spark.conf.set("spark.gradeloom.text.partitions", tasks)
    assert f"RoundRobinPartitioning({max(-(-rows // 500), spark.sparkContext.defaultParallelism)}), REPARTITION_BY_NUM" in plan

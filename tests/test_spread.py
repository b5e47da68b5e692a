"""Costly rows of small files are dealt to many tasks."""

from gradeloom.catalog import Tables, english as papers

SF = "/root/testdata/sf0.001"


def test_papers_spread_over_tasks(spark):
    t = Tables(spark, SF)
    assert t.spread("part", 25).rdd.getNumPartitions() == 8 and t.spread("part", 25).count() == t.part.count()
    for made in (papers.postgraduate_papers(t), papers.college_papers(t)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

"""A walk over all pages gives what asking for one page after another gives, without a job for each."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from ledgermill.plans import catalog as Cat


def documents(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") % 7).alias("uploaded_at")).repartition(5)


def test_walk_gives_the_pages(spark):
    docs, after, pages = documents(spark, 83), None, []
    while rows := Cat.page(docs, 20, after=after).collect():
        pages += [(r["id"], len(pages) // 20) for r in rows]
        after = (rows[-1]["uploaded_at"], rows[-1]["id"])
    assert len(pages) == 83
    assert sorted((r["id"], r["page"]) for r in Cat.walk(docs, 20).collect()) == sorted(pages)


def test_walk_of_nothing_and_of_documents_without_a_time(spark):
    docs = documents(spark, 3)
    assert Cat.walk(docs.where("id > 5")).count() == 0
    late = reduce(DataFrame.unionByName, [docs, docs.select((F.col("id") + 10).cast("string").alias("id"), F.lit(None).cast("timestamp").alias("uploaded_at"))])
    assert {r["id"]: r["page"] for r in Cat.walk(late, 3).collect()} == {"0": 0, "1": 0, "2": 0, "10": 1, "11": 1, "12": 1}
    with pytest.raises(ValueError):
        Cat.walk(docs, 101)


def test_the_query_takes_as_many_jobs_for_many_pages(spark, tmp_path):
    import __spark_entry__ as entry

    taken = []
    for n in (100, 1500):
        spark.range(1, n + 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/{n}/supplier.parquet")
        spark.sparkContext.setJobGroup(f"walk-{n}", "")
        found = entry.queries()["documents_walk"](spark, f"{tmp_path}/{n}")
        assert found.agg(F.max("page")).first()[0] == (n - 1) // 100 and found.count() == n
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{n}")))
    assert taken[1] <= taken[0] + 3

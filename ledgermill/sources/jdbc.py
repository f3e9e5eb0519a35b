"""Tables in a database over JDBC: read in parallel ranges, written in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table or query of a database.  With ``key``, a number or date column, ``partitions`` tasks read a range of
    it each; the ends are asked of the database, which answers with one row.  Without, one task reads all, which
    suits small tables only.  Filters and column choices reach the database either way."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key is None:
        return reader.load()
    ends = reader.load().agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return reader.load()
    ranged = reader.option("partitionColumn", key).option("numPartitions", partitions)
    return ranged.option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, **options: str) -> None:
    """Rows into a database's table, over at most ``connections`` connections at once.  A task that is run again
    writes its rows again: give the table a primary key, or write to a staging table first."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", connections).option("batchsize", "5000").options(**options).mode(mode).save()

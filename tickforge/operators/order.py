"""Dense numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, bucket: Column, order: list[str], name: str = "idx") -> DataFrame:
    """name: the place from 0 of each row by (bucket, order), where bucket doesn't fall as the order goes on. Rows are numbered
    within their bucket; the running sum goes over one row for each bucket, whose number the caller bounds."""
    df = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return df.withColumn("_at", at).join(offsets, "_bucket").withColumn(name, (F.col("_from") + F.col("_at")).cast("long")).drop("_bucket", "_from", "_at")


def by_entry(log: DataFrame) -> DataFrame:
    """idx of trades by (entry_pos, symbol), in buckets of 4096 positions."""
    return dense_index(log, F.floor(F.col("entry_pos") / 4096), ["entry_pos", "symbol"])

"""Positions in a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import durable


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of distinct keys.

    Rows are range-partitioned once and numbered within their partition; the
    partitions' counts, one row each, give where every partition begins.
    """
    rows = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "placed")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.withColumn("__within", within).join(base, "__part").withColumn(name, F.col("__base") + F.col("__within")).drop("__part", "__within", "__base")

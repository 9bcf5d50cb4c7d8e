"""Numbers by order over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.session import cut


def ranked(df: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """df with out: 0, 1, 2, ... within each group by order, which should be total.

    Rows are range-partitioned by (group, order), so a group of any size spreads over
    many tasks; a row's number is its place in its partition plus the rows of earlier
    partitions. The table is written once, as the range borders have to stay the same.
    """
    keys = [F.col(group), *order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part"), group).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", F.col(group).alias("_group"), "_first", "_before")
    joined = placed.withColumn("_part", part).join(starts, ["_part"], "left").where(F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(out, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_group", "_first", "_before")

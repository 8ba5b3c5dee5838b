"""Exact quantiles of groups of any size (AGG-04, AGG-22, AGG-23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions


def exact(df: DataFrame, groups: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """``groups`` and a column per share: the quantile with linear interpolation; null values do not count.

    Equal values are counted before the shuffle; the counts are range-partitioned by group
    and value and cumulated within each range, and the counts of earlier ranges are
    added. No task holds a group."""
    groups = list(groups)
    counted = df.select(*groups, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranges = cut_lineage(counted.repartitionByRange(partitions(df.sparkSession), *groups, "_v").withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.groupBy(*groups, "_range").agg(F.sum("_n").alias("_m"))
    starts = starts.withColumns({"_start": F.coalesce(F.sum("_m").over(earlier), F.lit(0)), "_all": F.sum("_m").over(Window.partitionBy(*groups))}).drop("_m")
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    upto = F.sum("_n").over(Window.partitionBy("_range", *groups).orderBy("_v"))
    placed = ranges.withColumn("_own", upto).alias("r").join(starts.alias("s"), [F.col("r._range") == F.col("s._range"), *same])
    placed = placed.select(*[F.col(f"r.{g}").alias(g) for g in groups], "_v", "_all", (F.col("_start") + F.col("_own")).alias("_upto"))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    ends = {}
    for name, share in shares.items():
        place = (F.col("_all") - 1) * share
        ends |= {f"_{name}0": at(F.floor(place)), f"_{name}1": at(F.ceil(place)), f"_{name}f": F.max(place - F.floor(place))}
    found = placed.groupBy(*groups).agg(*[c.alias(n) for n, c in ends.items()])
    between = lambda n: (F.col(f"_{n}0") + (F.col(f"_{n}1") - F.col(f"_{n}0")) * F.col(f"_{n}f")).alias(n)
    return found.select(*groups, *[between(n) for n in shares])

"""Seeded samples and splits that do not depend on the partitioning (SMP-01..SMP-09)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions

#: Fixed value: rows above which an O(n^2) metric is taken on a sample (SMP-08).
METRIC_ROWS = 5_000
#: Sample size up to which rows are simply ordered.
ORDERED = 20_000
#: Fixed value: added to the seed for the held-out reference sample (SMP-07).
REFERENCE_OFFSET = 1_234


def sample_key(seed: int, *keys: str) -> Column:
    """A text whose order shuffles the rows; DuckDB computes the same."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_key_sql(seed: int, *keys: str) -> str:
    return "md5(" + " || ':' || ".join([*[f"CAST({k} AS VARCHAR)" for k in keys], f"'{seed}'"]) + ")"


def exact_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """SMP-01..SMP-03: exactly min(n, rows) rows, those with the smallest sample keys.

    Two bounds on the key, each safe by ten standard deviations, settle nearly every
    row; only the rows between them, of the order of sqrt(n), are ordered to find the
    last key. No task ever holds the sample. Up to ``ORDERED`` rows the rows below the
    upper bound are ordered instead. Keys that many rows share can leave fewer than n
    rows below it; then all rows are ordered."""
    total = df.count()
    if n >= total:
        return df
    spare = 10 * math.sqrt(n) + 50
    key = sample_key(seed, *keys)
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    low, high = (int(max(0.0, min(1.0, x / total)) * (1 << 32)) for x in (n - spare, n + spare))
    near = df.where(lead <= high)
    if n > ORDERED:
        place = F.struct(key.alias("_key"), *keys)
        settled, listed = near.agg(F.count_if(lead < low), F.count(F.lit(1))).first()
        if settled < n <= listed:
            between = near.where(lead >= low).select(place.alias("p")).orderBy("p").limit(n - settled)
            last = between.agg(F.max("p").alias("p"))
            chosen = df.crossJoin(F.broadcast(last.withColumnRenamed("p", "_last"))).where(place <= F.col("_last")).drop("_last")  # one row
            if chosen.count() == n:  # else rows share all keys
                return chosen
        near = df
    elif near.count() < n:
        near = df
    return near.orderBy(key, *keys).limit(n)


def modulo_split(key: Column, train_share: float, seed: int) -> Column:
    """SMP-05: validation where key mod d = seed mod d with d = max(2, round(1 / (1 - share)))."""
    d = split_divisor(train_share)
    return F.when(F.pmod(key, F.lit(d)) == seed % d, "val").otherwise("train")


def split_divisor(train_share: float) -> int:
    return max(2, round(1 / (1 - train_share)))


def with_rank(df: DataFrame, name: str, seed: int, *keys: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row by sample key.

    Ranks are counted by the leading digits of the key, then within them, so no task sees all rows."""
    keyed = df.withColumn("_key", sample_key(seed, *keys)).withColumn("_slot", F.substring("_key", 1, 3))
    slots = keyed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 slots
    slots = slots.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_slot").orderBy("_key", *keys))
    return keyed.withColumn("_own", own).join(F.broadcast(slots), "_slot").withColumn(name, F.col("_before") + F.col("_own")).drop("_key", "_slot", "_before", "_own")


def ranked_split(df: DataFrame, train_share: float, seed: int, *keys: str) -> DataFrame:
    """SMP-04: the first max(1, min(n - 1, int(n * share))) rows by sample key train."""
    total = df.count()
    train = max(1, min(total - 1, int(total * train_share)))
    return with_rank(df, "_rank", seed, *keys).withColumn("split", F.when(F.col("_rank") <= train, "train").otherwise("val")).drop("_rank")


def fraction_ladder(df: DataFrame, fractions: Sequence[float], cap: int, seed: int, *keys: str) -> DataFrame:
    """SMP-09, SMP-11: nested samples of int(cap * fraction) rows, largest first, fractions once each."""
    ladder = sorted({f for f in fractions}, reverse=True)
    wide = exact_sample(df, int(cap * ladder[0]), seed, *keys) if ladder else df.limit(0)
    steps = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(int(cap * f)).alias("sample_rows")) for f in ladder])
    ranked = with_rank(wide, "_place", seed, *keys)
    return ranked.withColumn("_step", F.explode(steps)).where(F.col("_place") <= F.col("_step.sample_rows")).select(*df.columns, "_step.*")


def epoch_order(df: DataFrame, epoch: int, seed: int, buffer: Column, *keys: str) -> DataFrame:
    """SMP-06: the place of each row within its buffer, shuffled anew each epoch."""
    key = sample_key(seed + epoch, *keys)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(buffer).orderBy(key, *keys)))


def dense_index(df: DataFrame, *keys: str) -> DataFrame:
    """WIN-03: ``row_number`` 0 .. n - 1 in key order, for input of any size.

    Rows are range-partitioned by key and ranked within each range; the counts of
    earlier ranges are added. No task sees more than a range."""
    count = partitions(df.sparkSession)
    ranges = cut_lineage(df.repartitionByRange(count, *keys).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranges.withColumn("_own", own).join(starts.drop("_n"), "_range").withColumn("dense_index", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")

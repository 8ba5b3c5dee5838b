"""Aggregating sweeps over sizes, seeds, epochs and thresholds (AGG-19..24, WIN-04..08, FN-07..09, TOP-08)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value (WIN-07, FN-08).
CLOSE = 0.05


def usable(c: str) -> Column:
    """FLT-12: the value unless it is null or NaN."""
    return F.when(~F.isnan(c), F.col(c))


def group_stats(df: DataFrame, groups: Sequence[str], metric: str) -> DataFrame:
    """AGG-19: mean, population deviation, CV % (null below two values or for a mean of 0), quartiles."""
    v = usable(metric)
    mean, deviation, n = F.avg(v), F.stddev_pop(v), F.count(v)
    quartile = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(*groups).agg(n.alias("n"), mean.alias("mean"), deviation.alias("std"), quartile.alias("_q"))
    cv = F.when((F.col("n") >= 2) & (F.abs("mean") > 1e-12), 100 * F.col("std") / F.col("mean"))
    return stats.select(*groups, "n", "mean", "std", cv.alias("cv_percent"), *[F.col("_q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))])


def spread(df: DataFrame, groups: Sequence[str], metric: str) -> DataFrame:
    """AGG-21."""
    v = usable(metric)
    return df.groupBy(*groups).agg(F.min(v).alias("least"), F.max(v).alias("most"), (F.max(v) - F.min(v)).alias("spread"), F.count(v).alias("n"))


def reference_row(df: DataFrame, size: str, columns: Sequence[str], tie: str) -> DataFrame:
    """AGG-24: the row of the largest size; ties by the smaller ``tie``."""
    return df.select(size, tie, *columns).orderBy(F.col(size).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(1)


def verdict(value: Column, baseline: Column, larger_is_better: bool) -> Column:
    """FN-08: within 0.05 similar, else better or worse by direction."""
    delta = value - baseline if larger_is_better else baseline - value
    return F.when(delta.isNull() | F.isnan(delta), F.lit(None)).when(F.abs(delta) <= CLOSE, "similar").when(delta > 0, "BETTER").otherwise("WORSE")


def percent_label(fraction: Column) -> Column:
    """FN-09: an exact label, so 2.5 % and 2 % differ."""
    return F.concat(F.regexp_replace(F.format_string("%.4f", fraction * 100), r"\.?0+$", ""), F.lit("pct"))


def elbow(df: DataFrame, size: str, metric: str) -> DataFrame:
    """WIN-07: the smallest size whose metric is within 0.05 of that of the largest."""
    rows = df.where(usable(metric).isNotNull() & F.col(size).isNotNull()).groupBy(size).agg(F.avg(metric).alias("v"))
    reference = rows.agg(F.max_by("v", size).alias("reference"))
    return rows.crossJoin(reference).agg(F.min(F.when(F.abs(F.col("v") - F.col("reference")) <= CLOSE, F.col(size))).alias("elbow"), F.max("reference").alias("reference"))


def params_of_path(path: Column) -> dict[str, Column]:
    """SRC-10: rows, epochs, seed and threshold from a run's directory."""
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit("999999999999")).cast("bigint")
    return {"path_rows": number(r"rows_(\d+)"), "path_epochs": number(r"epochs_(\d+)"), "path_seed": number(r"(?:data)?seed_?(\d+)")}


def best_epochs(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """WIN-05: epochs that improve on all earlier ones; ties keep the earlier."""
    earlier = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("best_before", F.min(loss).over(earlier)).withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def best_epoch(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    return history.groupBy(run).agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"))


def stagnation(history: DataFrame, run: str, epoch: str, loss: str, units: str, min_delta: float) -> DataFrame:
    """WIN-06: length of the run of epochs that gain at most ``min_delta`` on the best so far
    while the active units stay the same."""
    order = Window.partitionBy(run).orderBy(epoch)
    best = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.try_divide(best - F.col(loss), F.abs(best))
    flat = F.coalesce((gain <= min_delta) & (F.col(units) == F.lag(units).over(order)), F.lit(False))
    marked = history.withColumn("_flat", flat).withColumn("_island", F.sum(F.when(F.col("_flat"), 0).otherwise(1)).over(order))
    count = F.sum(F.when(F.col("_flat"), 1).otherwise(0)).over(Window.partitionBy(run, "_island").orderBy(epoch))
    return marked.withColumn("stagnant", count).drop("_flat", "_island")


def epoch_changes(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """WIN-04: each epoch against the one before."""
    before = F.lag(loss).over(Window.partitionBy(run).orderBy(epoch))
    return history.withColumn("previous", before).withColumn("change", F.try_divide(F.col(loss) - before, before))


def last_of_history(df: DataFrame, history: str) -> DataFrame:
    """SRC-13: the last entry of an array of epochs; none for an empty one."""
    return df.withColumn("last", F.try_element_at(F.col(history), F.lit(-1)))


def grid(spark: SparkSession, parameters: Mapping[str, tuple[str, Sequence]]) -> DataFrame:
    """API-12: ``task`` and one column per parameter (type, values), the last one fastest."""
    tasks = spark.range(prod(len(values) for _, values in parameters.values())).withColumnRenamed("id", "task")
    left, columns = F.col("task"), []
    for name, (kind, values) in reversed(parameters.items()):
        columns.append(F.array(*[F.lit(v) for v in values])[(left % len(values)).cast("int")].cast(kind).alias(name))
        left = F.floor(left / len(values))
    return tasks.select("task", *reversed(columns))


def worst_columns(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """TOP-06: mean squared error of each (true, rebuilt) pair, worst first."""
    gap = lambda t, p: (F.col(p) - F.col(t)).cast("double")
    cells = [F.struct(F.lit(n).alias("feature"), F.round(F.avg(gap(*p) * gap(*p)), 6).alias("error")) for n, p in pairs.items()]
    long = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.col("error").desc_nulls_last(), "feature")))  # one row per column

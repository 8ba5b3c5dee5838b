"""Ranked deduplication and its verification (WIN-01, WIN-02, AGG-07, AGG-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ("chrom", "pos", "ref_base", "alt_base")
RANKING = ("snvq", "qual", "mapq", "dp", "raw_vaf")


#: What stands for "not available" in the integer qualities.
UNAVAILABLE = {"mapq": lambda c: c == 255, "dp": lambda c: c < 0}


def usable(df: DataFrame, column: str) -> Column:
    """``column`` with null for what cannot rank: NaN, and the marks of ``UNAVAILABLE``."""
    c = F.col(column)
    if dict(df.dtypes)[column] in ("float", "double"):
        return F.when(~F.isnan(c), c)
    return F.when(~UNAVAILABLE[column](c), c) if column in UNAVAILABLE else c


def best_per_locus(df: DataFrame, identity: Sequence[str] = LOCUS, ranking: Sequence[str] = RANKING, output: Sequence[str] | None = None) -> DataFrame:
    """WIN-01: the first row of each identity by ``ranking`` descending, unusable values
    (null, NaN, mapq 255, negative dp) last and null in the output, ties by every output
    column ascending. Ranking columns need not be in the output.

    WIN-02: without all identity columns nothing is removed. The order is taken
    in each task before the shuffle (window group limit), so a hot locus sends one
    row per task."""
    output = list(output or df.columns)
    df = df.withColumns({c: usable(df, c) for c in ranking if c in df.columns})
    if not set(identity) <= set(df.columns):
        return df.select(*output)
    order = [F.col(c).desc_nulls_last() for c in ranking if c in df.columns] + [F.col(c).asc_nulls_last() for c in output]
    first = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    return df.withColumn("_rn", first).where(F.col("_rn") == 1).select(*output)


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-07: rows and distinct key tuples; tuples with nulls count like any other."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"))


def group_maximum_mismatches(source: DataFrame, kept: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """AGG-08, JOIN-03, FLT-08: kept rows whose value is not the greatest usable one of their group."""
    mine = kept.select(*keys, F.col(value).alias("_kept"))
    top = source.join(mine, list(keys)).groupBy(*keys, "_kept").agg(F.max(usable(source, value)).alias("_top"))
    return top.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.col("_kept").eqNullSafe(F.col("_top"))).alias("n_mismatches"))

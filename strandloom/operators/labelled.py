"""Statistics, spectra and summaries of labelled records (AGG-04..06, AGG-11..13, JOIN-04..07, TOP-03..07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contexts import labels, sbs96_labels
from . import quantiles

CONTEXT = ("ref_base", "alt_base", "x_prev1", "x_next1")


def cluster_predicate(label: Column, only: Sequence[int] = (), without_noise: bool = False) -> Column:
    """FLT-03: an explicit list overrides the exclusion of noise (-1); a null label never passes."""
    if only:
        return label.isNotNull() & label.isin(*only)
    return label.isNotNull() & (label >= 0) if without_noise else label.isNotNull()


def cluster_stats(df: DataFrame) -> DataFrame:
    """AGG-04: size, mean and median probability per label from 0, largest first."""
    p = F.when(~F.isnan("cluster_probability"), F.col("cluster_probability").cast("double"))
    rows = df.where("cluster_label >= 0")
    stats = rows.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("cluster_size"), F.avg(p).alias("mean_probability"))
    stats = stats.join(quantiles.exact(rows, ["cluster_label"], p, {"median_probability": 0.5}), "cluster_label", "left")
    return stats.orderBy(F.desc("cluster_size"), "cluster_label")


def noise_count(df: DataFrame) -> DataFrame:
    """AGG-06, AGG-25."""
    return df.agg(F.count_if(F.col("cluster_label") == -1).alias("n_noise"), F.count_distinct(F.when(F.col("cluster_label") >= 0, F.col("cluster_label"))).alias("n_labels"))


def context_counts(df: DataFrame) -> DataFrame:
    """AGG-05."""
    return df.where("cluster_label >= 0").groupBy("cluster_label", *CONTEXT).agg(F.count(F.lit(1)).alias("n"))


def annotated(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """JOIN-04, FN-03, AGG-28: labels, cluster size and share of it."""
    named = counts.withColumns(labels(*[F.col(c) for c in CONTEXT]))
    sized = named.join(stats.select("cluster_label", "cluster_size"), "cluster_label", "left")
    return sized.withColumn("fraction", F.col("n") / F.col("cluster_size"))


def spectrum(counts: DataFrame) -> DataFrame:
    """AGG-11: rows per cluster and canonical context."""
    named = counts.withColumns({"sbs96": labels(*[F.col(c) for c in CONTEXT])["sbs96"]})
    return named.where(F.col("sbs96").isNotNull()).groupBy("cluster_label", "sbs96").agg(F.sum("n").alias("n"))


def dense_matrix(spectra: DataFrame) -> DataFrame:
    """AGG-12, in long form for any number of clusters: each cluster of ``spectra`` with all canonical contexts in matrix order, 0 for nothing."""
    counts = spectra.groupBy("cluster_label").agg(F.map_from_entries(F.collect_list(F.struct("sbs96", "n"))).alias("m"))  # 96 entries at most
    cells = counts.select("cluster_label", "m", F.posexplode(F.array(*[F.lit(x) for x in sbs96_labels()])).alias("place", "sbs96"))
    return cells.select("cluster_label", "place", "sbs96", F.coalesce(F.col("m")[F.col("sbs96")], F.lit(0)).alias("n"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """TOP-03: the first n rows of each group, numbered."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def similarities(spectra: DataFrame, signatures: DataFrame) -> DataFrame:
    """TOP-04: the cosine of each cluster's spectrum with ``signatures`` (``sbs96``, ``n``: one row per context), most similar first."""
    weights = signatures.groupBy("sbs96").agg(F.sum(F.col("n").cast("double")).alias("_w"))
    length = weights.agg(F.sum(F.col("_w") * F.col("_w")).alias("_length"))  # one row
    n = F.col("n").cast("double")
    sums = spectra.join(F.broadcast(weights), "sbs96", "left").groupBy("cluster_label").agg(F.sum(n * F.coalesce("_w", F.lit(0.0))).alias("_both"), F.sum(n * n).alias("_own"))
    cosine = F.coalesce(F.try_divide("_both", F.sqrt(F.col("_own") * F.col("_length"))), F.lit(0.0)).alias("similarity")
    return sums.crossJoin(F.broadcast(length)).select("cluster_label", cosine).orderBy(F.desc("similarity"), "cluster_label")


def dominant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-13: the column with the greatest value and its share of the row total; the
    first column wins ties, a total of 0 gives a share of 0."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0)).alias("v"), F.lit(-i).alias("o"), F.lit(c).alias("name")) for i, c in enumerate(columns)]))
    total = sum(F.coalesce(F.col(c), F.lit(0)) for c in columns)
    return df.withColumn("dominant", best["name"]).withColumn("dominant_fraction", F.coalesce(F.try_divide(best["v"].cast("double"), total), F.lit(0.0)))


def cluster_number(c: Column) -> Column:
    """FN-05: ``cluster_7`` to 7."""
    return F.regexp_replace(c, "^cluster_", "").cast("bigint")


def overlay(predicted: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-07: labels given when the model was fitted stand above predicted ones."""
    own = fitted.select(*keys, F.col("cluster_label").alias("_label"), F.col("cluster_probability").alias("_probability"), F.lit(True).alias("from_fit"))
    joined = predicted.join(own, list(keys), "left")
    fit = F.coalesce("from_fit", F.lit(False))
    return joined.select(
        *[c for c in predicted.columns if c not in ("cluster_label", "cluster_probability")],
        F.when(fit, F.col("_label")).otherwise(F.col("cluster_label")).alias("cluster_label"),
        F.when(fit, F.col("_probability")).otherwise(F.col("cluster_probability")).alias("cluster_probability"), fit.alias("from_fit"),
    )


def join_keys(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """JOIN-02: row_index if both have it, else the locus, else an error."""
    for keys in (["row_index"], ["chrom", "pos", "ref_base", "alt_base"]):
        if set(keys) <= set(left) and set(keys) <= set(right):
            return keys
    raise ValueError("neither row_index nor a full locus is on both sides")

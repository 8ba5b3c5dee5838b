"""Quality histograms per mutation context (AGG-09, AGG-10, JOIN-06)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import CHANGES
from ..functions.contexts import FLANKS, bin_number, canonical, valid

BASE_COLUMNS = ("ref_base", "alt_base", "x_prev1", "x_next1")


@dataclass(frozen=True)
class Window:
    """A closed range of quality in equal bins (FLT-05)."""

    low: float = 0.0
    high: float = 100.0
    bins: int = 20


def canonicalised(df: DataFrame, quality: str = "snvq") -> DataFrame:
    """Valid rows with ``change``, ``context`` and ``quality``."""
    bases = [F.col(c) for c in BASE_COLUMNS]
    c = canonical(*bases)
    return df.where(valid(*bases)).select(
        F.concat(c["ref"], F.lit(">"), c["alt"]).alias("change"), F.concat(c["before"], c["after"]).alias("context"), F.col(quality).cast("double").alias("quality")
    )


def _inside(window: Window) -> Column:
    return F.col("change").isin(*CHANGES) & F.col("quality").between(window.low, window.high)


def histogram(df: DataFrame, window: Window = Window()) -> DataFrame:
    rows = canonicalised(df).where(_inside(window))
    number = bin_number(F.col("quality"), window.low, window.high, window.bins)
    return rows.groupBy("change", "context", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def funnel(df: DataFrame, window: Window = Window()) -> DataFrame:
    """AGG-10: what each step leaves, in one pass."""
    bases = [F.col(c) for c in BASE_COLUMNS]
    c = canonical(*bases)
    change = F.concat(c["ref"], F.lit(">"), c["alt"])
    good, quality = F.coalesce(valid(*bases), F.lit(False)), F.col("snvq").cast("double")
    canonical_ = good & F.coalesce(change.isin(*CHANGES), F.lit(False))
    inside = canonical_ & F.coalesce(quality.between(window.low, window.high), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_filtered"), F.count_if(good).alias("n_valid"), F.count_if(canonical_).alias("n_canonical"),
        F.count_if(inside).alias("n_window"), F.min(F.when(inside, quality)).alias("least"), F.max(F.when(inside, quality)).alias("most"),
    )


def dense(spark, counts: DataFrame, window: Window = Window()) -> DataFrame:
    """JOIN-06: every change, context and bin, 0 where there is no count."""
    grid = spark.range(len(CHANGES) * len(FLANKS) * window.bins)
    cell = F.col("id")
    changes = F.array(*[F.lit(c) for c in CHANGES])
    flanks = F.array(*[F.lit(p + n) for p, n in FLANKS])
    grid = grid.select(
        changes[F.floor(cell / (len(FLANKS) * window.bins)).cast("int")].alias("change"),
        flanks[(F.floor(cell / window.bins) % len(FLANKS)).cast("int")].alias("context"), (cell % window.bins).cast("int").alias("bin"),
    )
    return grid.join(counts, ["change", "context", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

"""Problem 6: percentiles of very large numeric columns, mergeable.

Method: values are counted in signed logarithmic buckets. With the bucket width
gamma = (1 + error) / (1 - error), the value standing for a bucket differs from
each value in it by at most ``error`` times that value. Sketches of partitions,
days or other sets are merged by adding the counts of equal buckets, so any
combination is exact on the bucket level.

Error bound: the percentile q returned for n values is within the relative ``error``
(times 1 + 1e-6, for rounding in doubles) of the value at position floor(q * (n - 1)) of the
sorted values. This holds for all normal doubles, of both signs; those closer to 0 than
``TINY`` (subnormal ones) count as 0. ``error`` is from ``LEAST_ERROR`` up. The number of
buckets per group is bounded by the range of doubles (about 71,000 per sign at 1 %),
whatever the row count.

Defined cases: null and NaN are counted apart as ``n_missing`` and enter no
percentile; infinities keep buckets of their own at both ends and come out as
infinities; a group without values has null percentiles; null group values form
a group of their own; an empty table gives no groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The smallest normal double and the greatest.
TINY = 2.2250738585072014e-308
_GREATEST = 1.7976931348623157e308
#: Buckets narrower than this are not told apart by logarithms in doubles.
LEAST_ERROR = 1e-6


def gamma(error: float) -> float:
    if not LEAST_ERROR <= error < 1:
        raise ValueError(f"error must lie between {LEAST_ERROR} and 1")
    return (1 + error) / (1 - error)


def _scale(error: float) -> tuple[float, int, int]:
    """The logarithm of a bucket's width, the shift that makes the numbers of positive
    values positive, and the number above all others, that of infinity."""
    width = math.log(gamma(error))
    shift = 2 - math.floor(math.log(TINY) / width)
    return width, shift, shift + math.ceil(math.log(_GREATEST) / width) + 2


def bucket(value: Column, error: float) -> Column:
    """Signed bucket number; its order is the order of the values. Null for null and NaN."""
    width, shift, ends = _scale(error)
    v = value.cast("double")
    size = F.abs(v)
    index = F.ceil(F.log(size) / width) + shift
    index = F.when(size == float("inf"), F.lit(ends)).when(size < TINY, F.lit(0)).otherwise(index)
    return F.when(v.isNull() | F.isnan(v), F.lit(None)).otherwise(F.when(v < 0, -index).otherwise(index)).cast("bigint")


def bucket_sql(value: str, error: float) -> str:
    width, shift, ends = _scale(error)
    index = f"CASE WHEN abs({value}) = 'inf'::DOUBLE THEN {ends} WHEN abs({value}) < {TINY!r} THEN 0 ELSE ceil(ln(abs({value})) / {width!r}) + {shift} END"
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL ELSE CAST(CASE WHEN {value} < 0 THEN -({index}) ELSE ({index}) END AS BIGINT) END"


def bucket_value(number: Column, error: float) -> Column:
    """The value that differs from each of the bucket by at most ``error`` of it; never beyond the doubles."""
    width, shift, ends = _scale(error)
    size = F.least(F.exp((F.abs(number) - shift) * width + math.log1p(-error)), F.lit(_GREATEST))
    size = F.when(number == 0, 0.0).when(F.abs(number) == ends, float("inf")).otherwise(size)
    return F.when(number.isNotNull(), F.when(number < 0, -size).otherwise(size))


def bucket_value_sql(number: str, error: float) -> str:
    width, shift, ends = _scale(error)
    return (
        f"CASE WHEN {number} IS NULL THEN NULL WHEN {number} = 0 THEN 0.0 WHEN abs({number}) = {ends} THEN sign({number}) * 'inf'::DOUBLE "
        f"ELSE sign({number}) * least(exp((abs({number}) - {shift}) * {width!r} + {math.log1p(-error)!r}), {_GREATEST!r}) END"
    )


def sketch(df: DataFrame, groups: Sequence[str], value: str, error: float = 0.01) -> DataFrame:
    """``groups``, ``bucket`` (null: missing values) and ``n``. Counted before the
    shuffle, so a group with a third of all rows sends its buckets only."""
    return df.groupBy(*groups, bucket(F.col(value), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add the counts of equal buckets of all sketches that share ``groups``."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], shares: Sequence[float], error: float = 0.01) -> DataFrame:
    """``groups``, ``n``, ``n_missing`` and a column ``p<percent>`` for each share."""
    own = Window.partitionBy(*groups)
    seen = F.when(F.col("bucket").isNotNull(), F.col("n"))
    cumulated = merge(sketches, groups).select(
        *groups, "bucket", "n", F.sum(seen).over(own).alias("_all"), F.sum(seen).over(own.orderBy(F.col("bucket").asc_nulls_first())).alias("_upto")
    )
    found = [F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * s), F.col("bucket"))).alias(f"_b{i}") for i, s in enumerate(shares)]
    total = F.coalesce(F.sum(seen), F.lit(0)).alias("n")
    missing = F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("n_missing")
    names = [f"p{round(100 * s, 2):g}".replace(".", "_") for s in shares]
    return cumulated.groupBy(*groups).agg(total, missing, *found).select(
        *groups, "n", "n_missing", *[bucket_value(F.col(f"_b{i}"), error).alias(c) for i, c in enumerate(names)]
    )

"""Problem 2: a sample whose categories have given shares.

Method, per request: (1) rake weights by iterative proportional fitting across
several margins - each base field on its own and the full context - never above
the rows there are; (2) sample with weighted exponential keys: a row with uniform
u and weight w has the key -ln(u) / w, the smallest keys are drawn; (3) repair
minimums: categories below their need get their next-best rows, and the rows with
the worst keys beyond any need give way; (4) report what still falls short.

``u`` belongs to the row, not to the request, so within a category every request
takes a prefix of one common order. A row beyond the longest prefix any request
wants is dropped by a bound before anything is shuffled or ranked (the bound
fails with a chance below 1e-12), and each row meets only the requests for its
own sample and category. Where rows must be ordered - the first of a category, the first
of a request - a lower bound takes most of them unordered, and only those near the end are ranked. Each request's sample is a correct weighted sample;
requests for the same sample overlap as far as they can.

The need of a category is the greater of ``share * size`` (rounded) and its
minimum. Defined cases: a null share, size or minimum counts as 0; null bases and
unknown samples match no row, so a need there falls short in full; repeated target
rows count once (the greatest values); targets without a request id are left out;
if needs sum to more than the size, the sample grows to their sum; empty tables
give an empty sample and a report of unmet needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .fixed_sample import bounds
from .hashing import SPAN, random_key

_FAILURE = 1e-12
_SWEEPS = 40
#: Target rows (about 150 bytes each) up to which they are sent to every task; more are joined by shuffle.
_BROADCAST = 100_000


def rake(available: np.ndarray, target: np.ndarray, fields: Sequence[np.ndarray], sweeps: int = _SWEEPS) -> np.ndarray:
    """Expected rows per category that fit the margins of ``target`` as well as ``available`` allows.

    ``fields`` number the categories' values per margin. Each sweep scales the full
    table, then every margin, to its target sums, with ``available`` as the ceiling.
    """
    fitted = available.astype(float)
    margins = [np.arange(len(target)), *fields]
    for _ in range(sweeps):
        before = fitted.copy()
        for code in margins:
            width = int(code.max()) + 1 if len(code) else 0
            want, have = np.bincount(code, target, width), np.bincount(code, fitted, width)
            scale = np.divide(want, have, out=np.zeros(width), where=have > 0)
            fitted = np.minimum(fitted * scale[code], available)
        if np.allclose(before, fitted, rtol=1e-9, atol=1e-12):
            break
    return fitted


def _limit_for(rows: float, available: np.ndarray, weight: np.ndarray) -> float:
    """The key below which ``rows`` rows are expected; infinite if there are not so many."""
    reachable = available[weight > 0].sum()
    if rows >= reachable:
        return math.inf
    low, high = 0.0, 1.0
    expected = lambda t: (available * -np.expm1(-t * weight)).sum()
    while expected(high) < rows:
        high *= 2
        if high > 1e300:
            return math.inf
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < rows else (low, middle)
    return high


def _plan(pdf: pd.DataFrame, categories: list[str]) -> pd.DataFrame:
    size = int(pdf["size"].max())
    available = pdf["available"].to_numpy(float)
    target = pdf["share"].to_numpy(float) * size
    need = np.maximum(np.floor(target + 0.5), pdf["least"].to_numpy(float)).astype("int64")
    fields = [pd.factorize(pdf[c].fillna("\0"))[0] for c in categories]
    fitted = rake(available, target, fields)
    weight = np.divide(fitted, available, out=np.zeros(len(pdf)), where=available > 0)
    fill = max(0, size - int(np.minimum(need, available).sum()))
    # A spare of ten standard deviations: the draw surely reaches its size.
    top = _limit_for(size + 10 * math.sqrt(size) + 50, available, weight) if fill else 0.0
    with np.errstate(invalid="ignore"):
        drawn = np.where(weight > 0, top * weight, 0.0)
    must, surely = np.zeros(len(pdf)), np.zeros(len(pdf))
    for i, (n, k) in enumerate(zip(available, need)):
        if k > 0 and n > 0:
            accept, reject = (0.0, 1.0) if k >= n else bounds(int(k), int(n), _FAILURE)
            must[i] = math.inf if reject >= 1 else -math.log1p(-reject)
            surely[i] = -math.log1p(-accept)
    beyond = lambda t: np.maximum(available * -np.expm1(-t * weight) - need, 0).sum()
    fill_surely = _root(beyond, fill - 10 * math.sqrt(fill) - 50) if fill else 0.0
    return pdf.assign(need=need, weight=weight, fill=fill, limit=np.maximum(must, drawn), fill_limit=drawn, surely=surely, fill_surely=fill_surely)


def _root(rising, wanted: float) -> float:
    """A number at which ``rising`` is at most ``wanted``; 0 where it never is."""
    if wanted <= 0:
        return 0.0
    low, high = 0.0, 1.0
    while rising(high) < wanted and high < 1e300:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if rising(middle) <= wanted else (low, middle)
    return low


def _first(df: DataFrame, keys: Sequence[str], value: Column, surely: Column, wanted: Column, record: str) -> DataFrame:
    """``df`` with ``_first``: whether a row is among the first ``wanted`` of its ``keys`` by ``value``, then ``record``.

    Rows below ``surely`` are taken without an order, if there are not more of them than wanted; only the rest
    is ranked. Rows that are taken are spread by a salt, so no task sees all rows of a key."""
    marked = df.withColumn("_below", F.coalesce(value < surely, F.lit(False)))
    counts = marked.groupBy(*keys).agg(F.count_if("_below").alias("_taken"))
    marked = marked.join(counts, list(keys)).withColumn("_below", F.col("_below") & (F.col("_taken") <= wanted))
    salt = F.when(F.col("_below"), F.pmod(F.xxhash64(record), F.lit(1 << 16))).otherwise(-1)
    place = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(value.asc_nulls_last(), record))
    left = wanted - F.when(F.col("_taken") <= wanted, F.col("_taken")).otherwise(0)
    return marked.withColumn("_first", F.col("_below") | (place <= left)).drop("_below", "_taken")


def proportional_sample(
    rows: DataFrame, targets: DataFrame, request: str, sample: str, record: str, categories: Sequence[str],
    size: str, share: str, least: str, seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The sample (``request``, ``record``, ``categories``) and the report: per
    request and category ``wanted``, ``available``, ``drawn``, ``shortfall``,
    ``weight`` and ``share_gap`` (drawn less target share).

    ``rows`` has one row per ``record``.
    """
    categories = list(categories)
    cell = [sample, *categories]
    rows = rows.select(record, *cell).where(F.col(record).isNotNull())
    supply = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("available"))
    zero = lambda c, kind: F.coalesce(F.max(c), F.lit(0)).cast(kind)
    wanted = targets.where(F.col(request).isNotNull()).groupBy(request, *cell).agg(
        zero(size, "bigint").alias("size"), zero(share, "double").alias("share"), zero(least, "bigint").alias("least")
    )
    cells = wanted.join(supply, cell, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    schema = cells.schema.simpleString()[len("struct<") : -1]
    schema = f"{schema},need:bigint,weight:double,fill:bigint,limit:double,fill_limit:double,surely:double,fill_surely:double"
    plan = cut_lineage(cells.groupBy(request).applyInPandas(lambda pdf: _plan(pdf, categories), schema))

    exponential = -F.log((random_key(seed, F.col(record)) + 0.5) / float(SPAN))
    longest = plan.groupBy(*cell).agg(F.max("limit").alias("longest"))
    few = plan.count() <= _BROADCAST
    sent = F.broadcast if few else lambda df: df
    near = rows.withColumn("_e", exponential).join(sent(longest), cell).where(F.col("_e") <= F.col("longest")).drop("longest")
    drawn = near.join(sent(plan.select(request, *cell, "need", "weight", "fill", "limit", "fill_limit", "surely", "fill_surely")), cell).where(F.col("_e") <= F.col("limit"))
    drawn = _first(drawn, [request, *cell], F.col("_e"), F.col("surely"), F.col("need"), record)
    drawn = cut_lineage(drawn.where(F.col("_first") | ((F.col("fill") > 0) & (F.col("_e") <= F.col("fill_limit")))))
    more = _first(drawn.where("not _first"), [request], F.try_divide("_e", "weight"), F.col("fill_surely"), F.col("fill"), record)
    chosen = drawn.where("_first").unionByName(more.where("_first"))
    chosen = chosen.select(request, record, *cell)

    counts = chosen.groupBy(request, *categories).agg(F.count(F.lit(1)).alias("drawn"))
    joined = plan.alias("p").join(counts.alias("c"), [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [request, *categories]], "left")
    report = joined.select(
        *[F.col(f"p.{c}") for c in [request, *cell]], F.col("need").alias("wanted"), "available",
        F.coalesce("drawn", F.lit(0)).alias("drawn"), "weight", "share",
    )
    total = F.sum("drawn").over(Window.partitionBy(request))
    report = report.withColumn("share_gap", F.coalesce(F.try_divide("drawn", total), F.lit(0.0)) - F.col("share"))
    report = report.withColumn("shortfall", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)))
    return chosen, report.drop("share")

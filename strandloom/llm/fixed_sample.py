"""Problem 1: a fixed number of records from data of unknown length.

Method: accept-waitlist sampling. Every record gets a uniform key by hashing its
id. After counting, two concentration bounds decide most keys outright: a key
below the lower bound is in the sample, one above the upper bound is not. Only
the narrow waitlist between them, of the order of sqrt(size) rows, is ordered.
When the bounds turn out wrong (with a chance of ``failure``), they are widened
and the data are read again, so the sample always has exactly the wanted size.

Defined cases: null ids are left out; repeated ids count once; equal keys are
ordered by id; a wanted size above the number of ids gives all of them, 0 or an
empty table gives no row. Extra columns are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hashing import SPAN, random_key


def bounds(size: int, population: int, failure: float) -> tuple[float, float]:
    """Shares of the key range below which a key is taken and above which it is
    not, each wrong with a chance of at most ``failure``."""
    p = size / population
    above = -math.log(failure) / population
    below = 2 * above / 3
    accept = max(0.0, p + below - math.sqrt(below * below + 3 * below * p))
    reject = min(1.0, p + above + math.sqrt(above * above + 2 * above * p))
    return accept, reject


def cutoff(ids: DataFrame, id_column: str, size: int, population: int, seed: int, span: float = SPAN, failure: float = 1e-6) -> tuple[int, int] | None:
    """The (key, id) of the last record of the sample; None if all belong to it.

    ``ids`` may repeat an id. Keys are taken as uniform on [0, span).
    """
    if size >= population:
        return None
    key = random_key(seed, F.col(id_column))
    while True:
        accept, reject = (int(span * x) for x in bounds(size, population, failure))
        near = ids.select(F.col(id_column).alias("id"), key.alias("key")).where(F.col("key") <= reject).distinct()
        accepted, listed = near.agg(F.count_if(F.col("key") < accept), F.count(F.lit(1))).first()
        if accepted < size <= listed:
            waitlist = near.where(F.col("key") >= accept).orderBy("key", "id").limit(size - accepted)
            last = waitlist.agg(F.max(F.struct("key", "id")).alias("last")).first()["last"]
            return last["key"], last["id"]
        failure /= 1e6


def inside(id_column: str, seed: int, last: tuple[int, int] | None):
    """The condition that a record belongs to the sample ending at ``last``."""
    known = F.col(id_column).isNotNull()
    if last is None:
        return known
    key = random_key(seed, F.col(id_column))
    return known & ((key < last[0]) | ((key == last[0]) & (F.col(id_column) <= last[1])))


def fixed_size_sample(df: DataFrame, id_column: str, size: int, seed: int, newest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exactly ``min(size, number of ids)`` records, each id equally likely.

    ``newest`` picks one row of those that share an id; it sees sampled rows
    only, so nothing else is shuffled. By default any one is kept, which is
    defined only where repeated rows are equal.
    """
    if size <= 0:
        return df.limit(0)
    ids = df.select(id_column).where(F.col(id_column).isNotNull())
    population = ids.distinct().count()
    rows = df.where(inside(id_column, seed, cutoff(ids, id_column, size, population, seed)))
    return newest(rows) if newest else rows.dropDuplicates([id_column])


def sample_pieces(pieces: Iterable[DataFrame], id_column: str, size: int, seed: int) -> DataFrame:
    """The ids of the same sample, from pieces that come one after another.

    Between pieces only a candidate set is kept: the ids with keys up to a bound
    that falls as more ids are seen. Ids below the bound are all there, so their
    keys are uniform below it, and the number of candidates stands for the
    unknown length; an id that comes again in a later piece counts once. The set
    stays below about four times ``size`` rows.
    """
    held: DataFrame | None = None
    bound, count = SPAN, 0
    for piece in pieces:
        new = piece.select(F.col(id_column).alias("id")).where(F.col(id_column).isNotNull())
        new = new.where(random_key(seed, F.col("id")) < bound)
        held = cut_lineage((held.union(new) if held is not None else new).distinct())
        count = held.count()
        if count > 4 * max(size, 1):
            last = cutoff(held, "id", 2 * max(size, 1), count, seed, bound)
            bound = last[0] + 1
            held = held.where(random_key(seed, F.col("id")) < bound)
            count = held.count()
    if held is None:
        raise ValueError("there is no piece")
    if size <= 0:
        return held.limit(0).withColumnRenamed("id", id_column)
    return held.where(inside("id", seed, cutoff(held, "id", size, count, seed, bound))).withColumnRenamed("id", id_column)

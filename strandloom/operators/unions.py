"""Unions by name with conservation of rows (SRC-05, SET-01..03, PRJ-02, PRJ-03)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(names: Sequence[str]) -> list[str]:
    """PRJ-02: without repeats, in order."""
    return list(dict.fromkeys(names))


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """SRC-05: columns missing in a part are null there."""
    if not parts:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def check_conserved(parts: Sequence[DataFrame], whole: DataFrame) -> int:
    """SET-01: the number of rows, which must be the sum over the parts."""
    expected, found = sum(p.count() for p in parts), whole.count()
    if expected != found:
        raise ValueError(f"{found} rows of {expected}")
    return found


def tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """SET-02."""
    return union_by_name([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def or_null(df: DataFrame, name: str, kind: str) -> Column:
    """PRJ-03: the column cast to ``kind``, or a null of that type."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

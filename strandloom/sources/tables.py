"""Parquet tables by name (SRC-02, SRC-06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` as a DataFrame; a file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds (PRJ-01)."""
    return F.col("`" + name.replace("`", "``") + "`")


def scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    predicate: str | None = None,
    limit: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Projection, predicate and limit over a scan (SRC-02, TOP-02).

    The predicate is parsed as one SQL *expression*, so a statement or a second
    query in it fails. ``order`` makes a limit reproducible.
    """
    if predicate:
        df = df.where(F.expr(predicate))
    if order:
        df = df.orderBy(*[column(c).asc_nulls_last() for c in order])
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[column(c) for c in columns]) if columns else df

"""The newest delivery of every observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """For each non-null ``key`` the row with the greatest ``at``.

    Rows that tie on ``at`` are ordered by ``columns`` (greatest first, nulls
    last), so the result does not depend on the partitioning. The maximum is
    taken in each map task before the shuffle: a key that holds a third of all
    rows sends one row per task. An empty table gives an empty result.
    """
    rest = [c for c in columns if c not in (key, at)]
    best = F.max(F.struct(at, *rest)).alias("_best")
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return newest.select(*[F.col(key) if c == key else F.col(f"_best.{c}") for c in columns])


def latest_sql(table: str, key: str, at: str, columns: Sequence[str]) -> str:
    rest = [c for c in columns if c not in (key, at)]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [at, *rest])
    return (
        f"SELECT {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn "
        f"FROM {table} WHERE {key} IS NOT NULL) WHERE _rn = 1"
    )

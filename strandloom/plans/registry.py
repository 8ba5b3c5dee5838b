"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import plain, plain_sql
from ..operators.latest import latest, latest_sql
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPELLED = ("chrom", "ref_base", "alt_base", "x_prev1", "x_next1", "x_prev2", "x_next2", "x_prev3", "x_next3")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def observations(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """The newest row of each observation, bases and chromosome in one spelling."""
    columns = list(dict.fromkeys(["row_index", "loaded_at", *columns]))
    rows = latest(table(spark, folder, "featuremap"), "row_index", "loaded_at", columns)
    return rows.withColumns({c: plain(F.col(c)) for c in columns if c in SPELLED})


def observations_sql(columns: Sequence[str]) -> str:
    columns = list(dict.fromkeys(["row_index", "loaded_at", *columns]))
    shown = ", ".join(f"{plain_sql(c)} AS {c}" if c in SPELLED else c for c in columns)
    return f"(SELECT {shown} FROM ({latest_sql('featuremap', 'row_index', 'loaded_at', columns)}))"

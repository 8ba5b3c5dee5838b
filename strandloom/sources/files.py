"""Files other than plain parquet scans, and sinks (SRC-05..13, SNK-01..07)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sweeps import params_of_path
from ..operators.unions import check_conserved, union_by_name
from ..session import cut_lineage
from .tables import scan


def combine(spark: SparkSession, paths: Sequence[str], target: str) -> int:
    """SRC-05, SET-01: unite parquet files by name into one; returns the rows, which are checked."""
    parts = [spark.read.parquet(p) for p in paths]
    write_parquet(union_by_name(parts), target)
    return check_conserved(parts, spark.read.parquet(target))


def row_count(df: DataFrame, predicate: str | None = None) -> int:
    """SRC-03: without a predicate no column is read."""
    return (df.where(F.expr(predicate)) if predicate else df).count()


def inspect(df: DataFrame, predicate: str | None = None, rows: int = 5) -> dict:
    """SRC-12: schema, count and a preview."""
    chosen = df.where(F.expr(predicate)) if predicate else df
    return {"columns": dict(df.dtypes), "n_rows": chosen.count(), "preview": [r.asDict() for r in chosen.limit(rows).collect()]}


def batches(df: DataFrame, columns: Sequence[str], predicate: str | None = None, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """SRC-04, STR-01: a bounded scan in frames of ``rows`` rows; the driver holds one partition at a time."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    held = []
    for row in scan(df, columns, predicate).toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == rows:
            yield pd.DataFrame(held, columns=list(columns))
            held = []
    if held:
        yield pd.DataFrame(held, columns=list(columns))


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = (), files: int | None = None) -> None:
    """SNK-01..03: ZSTD parquet, sorted over all files where an order is given."""
    if order:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    if files:
        df = df.coalesce(files)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_in_parts(df: DataFrame, path: str, key: str, parts: int, progress: Callable[[int, int], None] | None = None) -> int:
    """SNK-02: a table that grows part by part, with the schema of the first; ``progress(rows, part)`` follows each.

    Rows are dealt to parts by a hash of ``key`` and computed once. Gives the rows written."""
    dealt = cut_lineage(df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))))
    rows = 0
    for part in range(parts):
        seen = Observation()
        own = dealt.where(F.col("_part") == part).drop("_part").observe(seen, F.count(F.lit(1)).alias("n"))
        own.write.mode("append" if part else "overwrite").option("compression", "zstd").parquet(path)
        rows += seen.get["n"]
        if progress:
            progress(rows, part + 1)
    return rows


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: with a header, columns in the order of the schema."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    """SNK-04."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: JSON arrays of records, with the parameters that the path encodes (SRC-10)."""
    df = spark.read.json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return df.withColumns(params_of_path(F.col("path")))


def write_json(data: object, path: str) -> None:
    """SNK-05: sorted keys, two spaces."""
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def find_run(recorded: str, roots: Sequence[str]) -> str | None:
    """SRC-11: a recorded path under its old root, looked for by its longest suffix under ``roots``."""
    parts = Path(recorded).parts
    for start in range(len(parts)):
        for root in roots:
            if (place := Path(root, *[p for p in parts[start:] if p != "/"])).exists():
                return str(place)
    return None

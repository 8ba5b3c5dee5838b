"""Joining labels to observations and writing them as VCF text (JOIN-01, AGG-30, SNK-06)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .labelled import cluster_predicate, join_keys
from .unions import or_null

#: Fixed values of the format.
VERSION = "VCFv4.3"
HEADER_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
INFO = {
    "CLUSTER": ("1", "Integer", "Cluster label"),
    "CLPROB": ("1", "Float", "Cluster membership probability"),
    "UMAP1": ("1", "Float", "First map coordinate"),
    "UMAP2": ("1", "Float", "Second map coordinate"),
    "SRC_FILT": ("1", "Integer", "Filter value of the source"),
}
SOURCE = "strandloom"


def export_rows(source: DataFrame, labels: DataFrame, predicate: str | None = None, only: Sequence[int] = (), without_noise: bool = False) -> DataFrame:
    """Observations that pass ``predicate``, with the label of each label row that has
    their key and passes the label filter. Missing optional columns are null."""
    keys = join_keys(source.columns, labels.columns)
    if predicate:
        source = source.where(F.expr(predicate))
    source = source.select(
        *dict.fromkeys([*keys, "chrom", "pos", "ref_base", "alt_base"]),
        *[or_null(source, c, t) for c, t in (("snvq", "double"), ("qual", "double"), ("mapq", "int"), ("dp", "int"), ("raw_vaf", "double"), ("filt", "int"))],
    )
    own = labels.where(cluster_predicate(F.col("cluster_label"), only, without_noise))
    own = own.select(*keys, "cluster_label", *[or_null(labels, c, "float") for c in ("cluster_probability", "umap_1", "umap_2")])
    return source.join(own, keys)


@F.pandas_udf(StringType())
def six_digits(values: pd.Series) -> pd.Series:
    """FN-06: ``%.6g``; null for null and NaN."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.6g}").astype(object)


def vcf_header(reference: str | None = None, date: str | None = None) -> list[str]:
    """The lines before the body; ``date`` as YYYYMMDD."""
    info = [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in INFO.items()]
    passed = '##FILTER=<ID=PASS,Description="Source filter is 1 or absent">'
    more = [f"##reference={reference}"] if reference else []
    return [f"##fileformat={VERSION}", *([f"##fileDate={date}"] if date else []), f"##source={SOURCE}", *info, passed, *more, HEADER_COLUMNS]


def vcf_lines(rows: DataFrame) -> DataFrame:
    """One line per row with its sort key. FILTER is PASS where the source filter is 1 or
    absent, else ``.``; QUAL is ``.`` where it is absent; INFO leaves absent values out."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    number = lambda c: six_digits(F.col(c).cast("double"))
    parts: dict[str, Column] = {
        "CLUSTER": F.col("cluster_label").cast("int").cast("string"), "CLPROB": number("cluster_probability"), "UMAP1": number("umap_1"), "UMAP2": number("umap_2"), "SRC_FILT": F.col("filt").cast("int").cast("string"),
    }
    info = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()])
    status = F.when(F.coalesce(F.col("filt"), F.lit(1)) == 1, "PASS").otherwise(".")
    line = F.concat_ws("\t", dot(F.col("chrom")), dot(F.col("pos")), F.lit("."), dot(F.col("ref_base")), dot(F.col("alt_base")), F.coalesce(number("qual"), F.lit(".")), status, F.when(info == "", ".").otherwise(info))
    return rows.select("chrom", "pos", "ref_base", "alt_base", line.alias("line"))


def write_vcf(rows: DataFrame, path: str, reference: str | None = None, date: str | None = None) -> None:
    """TOP-05: lines in locus order over sorted part files; the header is the part that sorts first."""
    lines = vcf_lines(rows).orderBy("chrom", "pos", "ref_base", "alt_base", "line").select("line")
    spark = rows.sparkSession
    header = spark.createDataFrame([("\n".join(vcf_header(reference, date)),)], "line string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/part=0-header")
    lines.write.mode("overwrite").text(f"{path}/part=1-body")

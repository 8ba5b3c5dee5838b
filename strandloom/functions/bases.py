"""Bases and chromosomes: spelling, complement, canonical contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: The six pyrimidine substitutions.
CHANGES = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")


def upper_base(c: Column) -> Column:
    """PRJ-06: text in upper case, nothing else changed."""
    return F.upper(c.cast("string"))


def plain(c: Column) -> Column:
    """One spelling for a base or chromosome: upper case, without surrounding
    spaces and the prefix ``chr``. Null stays null, blank text becomes ``""``."""
    return F.regexp_replace(F.trim(F.upper(c.cast("string"))), "^CHR", "")


def plain_sql(c: str) -> str:
    """The same as SQL text that DuckDB runs."""
    return f"regexp_replace(trim(upper({c})), '^CHR', '')"


def complement(c: Column) -> Column:
    """FN-01: A and T, C and G change places; anything else becomes null."""
    return F.when(c == "A", "T").when(c == "C", "G").when(c == "G", "C").when(c == "T", "A")

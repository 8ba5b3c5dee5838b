"""Mutation contexts (FN-01..FN-03) and bins (FN-04, FN-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bases import BASES, CHANGES, complement, upper_base

#: The 16 flank pairs, in the order of a matrix's rows.
FLANKS = [(p, n) for p in BASES for n in BASES]


def canonical(ref: Column, alt: Column, before: Column, after: Column) -> dict[str, Column]:
    """FN-02: a purine reference is complemented, and its flanks change places."""
    kept = ref.isin("C", "T")
    return {
        "ref": F.when(kept, ref).otherwise(complement(ref)),
        "alt": F.when(kept, alt).otherwise(complement(alt)),
        "before": F.when(kept, before).otherwise(complement(after)),
        "after": F.when(kept, after).otherwise(complement(before)),
    }


def labels(ref: Column, alt: Column, before: Column, after: Column) -> dict[str, Column]:
    """FN-03: ``R>A``, ``PN``, the strand-specific label and the canonical one.

    A null part gives a null label; the canonical label is null unless the change
    is one of the six."""
    c = canonical(ref, alt, before, after)
    change = F.concat(c["ref"], F.lit(">"), c["alt"])
    return {
        "ref_alt": F.concat(ref, F.lit(">"), alt),
        "context16": F.concat(before, after),
        "trinuc192": F.concat(before, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), after),
        "sbs96": F.when(change.isin(*CHANGES), F.concat(c["before"], F.lit("["), change, F.lit("]"), c["after"])),
    }


def valid(*bases: Column) -> Column:
    """FLT-04: four known bases whose first two, reference and alternative, differ."""
    ref, alt, *_ = bases
    ok = ref != alt
    for b in bases:
        ok &= b.isNotNull() & upper_base(b).isin(*BASES)
    return ok


def sbs96_labels() -> list[str]:
    """The 96 canonical labels in matrix order: by change, then flanks."""
    return [f"{p}[{c}]{n}" for c in CHANGES for p, n in FLANKS]


def bin_number(value: Column, low: float, high: float, bins: int) -> Column:
    """AGG-09: equal bins whose last one holds the upper edge too."""
    if bins < 1 or not high > low:
        raise ValueError("need at least one bin and low < high")
    width = (high - low) / bins
    return F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def bin_edges(low: float, high: float, bins: int) -> Column:
    """FN-11: the bins + 1 edges as array<double>."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.lit(low) + i * ((high - low) / bins))

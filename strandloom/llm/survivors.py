"""Problem 4: the best representative of each group of duplicates.

Method: fields are unpivoted to long rows (group, field, value, votes). A vote is
the trust in the row's source times a decay with its age; votes are summed per
normalised value, the winner of each field is chosen by max_by, and the winners
are pivoted back to one record per group.

A row can cast several votes, the first of which decides unless it ties: trust by one
quality, then by the next. So an explicit ranking of rows is a list of votes without
decay; a null vote is below every other.

No step gathers a group: sums and max_by run before each shuffle, so a group
with a third of all rows sends one row per value and task.

Defined cases: rows whose group key has a null belong to no group; a value that
its field calls unusable is no candidate; a field without candidates is null;
ties go to the smaller record id; repeated rows of one id must be resolved
before (see operators.latest); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """``value`` is normalised, so equal values are equal; null is unusable."""

    name: str
    value: Column
    #: The value names the record itself, so no two rows share it and votes need no summing.
    own: bool = False


def decay(at: Column, newest: Column, half_life_days: float) -> Column:
    """Halves with each ``half_life_days`` between ``at`` and ``newest``."""
    days = (F.unix_micros(newest) - F.unix_micros(at)) / 86_400_000_000.0
    return F.pow(F.lit(0.5), days / half_life_days)


def survivors(df: DataFrame, groups: Sequence[str], record: str, fields: Sequence[Field], votes: Sequence[Column] = ()) -> DataFrame:
    """``groups``, ``n_records`` and the winning value of each field.

    ``votes`` weigh a row, the first first (one vote of 1 where there are none). All fields share one value type.
    """
    votes = list(votes) or [F.lit(1.0)]
    last = len(votes)
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*votes, -F.col(record)])])
    keyed = df.where(F.greatest(*[F.col(g).isNull() for g in [*groups, record]]) == F.lit(False)) if len(groups) else df
    cells = [F.struct(F.lit(i).alias("field"), f.value.alias("value")) for i, f in enumerate(fields)]
    # One more cell per row, so that groups whose every field is unusable stay and records can be counted.
    cells.append(F.struct(F.lit(-1).alias("field"), F.lit(None).cast("void").alias("value")))
    long = keyed.select(*groups, F.inline(F.filter(F.array(*cells), lambda c: c["value"].isNotNull() | (c["field"] < 0))), order.alias("order"))
    size = F.when(F.col("field") < 0, 1)
    if all(f.own for f in fields):
        # A value that names its record has one voter: the sums are its votes, which ``order`` holds.
        tallied, count, best = long, F.count(size), F.col("order")
    else:
        sums = [F.sum(f"order._{i}").alias(f"_v{i}") for i in range(last)]
        tallied = long.groupBy(*groups, "field", "value").agg(*sums, F.max("order").alias("order"), F.count(size).alias("n"))
        best = F.struct(*[F.round(f"_v{i}", 9) for i in range(last)], F.col(f"order._{last}"))
        count = F.sum("n")
    winners = [F.max_by("value", F.when(F.col("field") == i, best)).alias(f.name) for i, f in enumerate(fields)]
    return tallied.groupBy(*groups).agg(count.alias("n_records"), *winners)

"""Profiles, normalisation and encoding of features (AGG-01..03, ENC-01..07)."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-6


@dataclass(frozen=True)
class Feature:
    """One model column. ``kind`` is "c" (categorical), "int" or "float"."""

    name: str
    kind: str
    values: Mapping[str, int] = field(default_factory=dict)

    @property
    def embedding_width(self) -> int:
        """ENC-06."""
        return max(2, min(16, math.ceil(math.sqrt(len(self.values))) * 2))


def read_features(path: str) -> list[Feature]:
    """SRC-08: a JSON feature specification."""
    with open(path, encoding="utf-8") as f:
        return [Feature(x["name"], x["type"], x.get("values") or {}) for x in json.load(f)["features"]]


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-01: one pass; NaN counts as present."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def is_missing(c: Column) -> Column:
    """ENC-02: null, or NaN."""
    return c.isNull() | F.isnan(c.cast("double"))


def _guarded(mean: Column, deviation: Column) -> tuple[Column, Column]:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite(mean), mean).otherwise(0.0), F.when(finite(deviation) & (deviation >= _TINY), deviation).otherwise(1.0)


def _long(df: DataFrame, features: Sequence[str], stats: Sequence[tuple[Column, Column]]) -> DataFrame:
    cells = []
    for name, (mean, deviation) in zip(features, stats):
        m, s = _guarded(mean, deviation)
        cells.append(F.struct(F.lit(name).alias("feature"), m.alias("mean"), s.alias("std")))
    return df.agg(F.array(*cells).alias("_s")).select(F.inline("_s"))


def sample_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AGG-02: mean and sample deviation over all rows with a value, in one pass."""
    value = [F.when(~is_missing(F.col(c)), F.col(c).cast("double")) for c in features]
    return _long(df, features, [(F.avg(v), F.stddev_samp(v)) for v in value])


def train_stats(df: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """AGG-03: mean and population deviation over training rows with a value."""
    value = [F.when(train & ~is_missing(F.col(c)), F.col(c).cast("double")) for c in features]
    return _long(df, features, [(F.avg(v), F.stddev_pop(v)) for v in value])


def null_code(feature: Feature) -> int:
    """ENC-01: the code of the empty text; without one, that of the first value named."""
    first, *_ = feature.values.values()
    return feature.values.get("", first)


def category_code(c: Column, feature: Feature) -> Column:
    """ENC-01: null and unknown values share ``null_code``."""
    code = F.lit(None)
    if feature.values:
        code = F.element_at(F.create_map(*[F.lit(x) for pair in feature.values.items() for x in pair]), c.cast("string"))
    return F.coalesce(code, F.lit(null_code(feature))).cast("int")


def standardised(c: Column, mean: float, deviation: float) -> Column:
    """ENC-03: a missing value becomes the mean, so 0."""
    v = c.cast("float").cast("double")
    return F.when(is_missing(c), 0.0).otherwise((v - mean) / deviation)


def kept_features(df: DataFrame, features: Sequence[Feature]) -> list[Feature]:
    """ENC-04, ENC-05: drops features without a value and categoricals that only hold the null code."""
    checks = []
    for f in features:
        if f.kind == "c":
            code, null = category_code(F.col(f.name), f), null_code(f)
            checks.append((F.count(f.name) > 0) & ((F.min(code) != null) | (F.max(code) != null)))
        else:
            checks.append(F.count_if(~is_missing(F.col(f.name))) > 0)
    flags = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"k{i}") for i, c in enumerate(checks)]).first()
    kept = [f for f, k in zip(features, flags) if k]
    if not kept:
        raise ValueError("no feature has any value")
    return kept


def encode(df: DataFrame, features: Sequence[Feature], stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``df`` with ``cat`` array<int>, ``num`` array<float> and ``mask`` array<float>."""
    cats = [f for f in features if f.kind == "c"]
    nums = [f for f in features if f.kind != "c"]
    return df.withColumns({
        "cat": F.array(*[category_code(F.col(f.name), f) for f in cats]).cast("array<int>"),
        "num": F.array(*[standardised(F.col(f.name), *stats[f.name]) for f in nums]).cast("array<float>"),
        "mask": F.array(*[F.when(is_missing(F.col(f.name)), 0.0).otherwise(1.0) for f in nums]).cast("array<float>"),
    })


def feature_report(features: Sequence[Feature], kept: Sequence[Feature], stats: Mapping[str, tuple[float, float]], n_rows: int) -> dict:
    """ENC-07."""
    names = {f.name for f in kept}
    return {
        "n_rows": n_rows,
        "kept_categorical": {f.name: len(f.values) for f in kept if f.kind == "c"},
        "kept_numeric": [f.name for f in kept if f.kind != "c"],
        "dropped": [f.name for f in features if f.name not in names],
        "means": {n: m for n, (m, _) in stats.items() if n in names},
        "stds": {n: s for n, (_, s) in stats.items() if n in names},
    }

"""Substitutes for a 2-d embedding and a density clustering (EXT-01, EXT-02), and a signature fit (EXT-03).

They keep the columns and the meaning of label -1; the values are those of principal
components and nearest centroids, not of the originals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latent import _sums


@dataclass
class Reducer:
    """What ``fit`` learned; ``apply`` gives new rows their place and label (the saved predictor of a run)."""

    mean: list[float]
    axes: list[list[float]]
    #: Per cluster: centre and mean squared distance of its members.
    centres: list[tuple[float, float, float]] = field(default_factory=list)
    reach: float = 2.5

    def place(self, df: DataFrame) -> DataFrame:
        """``map_1`` and ``map_2`` of ``v``."""
        part = lambda k: sum((F.col("v")[i] - m) * axis[k] for i, (m, axis) in enumerate(zip(self.mean, self.axes)))
        return df.withColumns({"map_1": part(0), "map_2": part(1)})

    def label(self, df: DataFrame) -> DataFrame:
        """``cluster_label`` and ``cluster_probability`` of (map_1, map_2): the nearest centre,
        or -1 where it is farther than ``reach`` root mean squares of its members."""
        away = F.array(*[
            F.struct((F.pow(F.col("map_1") - a, 2) + F.pow(F.col("map_2") - b, 2)).alias("d"), F.lit(i).alias("c"), F.lit(w).alias("w")) for i, (a, b, w) in enumerate(self.centres)
        ])
        near = df.withColumn("_n", F.array_min(away))
        share = F.sqrt(F.try_divide(F.col("_n.d"), F.col("_n.w")))
        noise = F.coalesce(share > self.reach, F.lit(False))
        probability = F.when(noise, 0.0).otherwise(F.exp(-F.coalesce(share, F.lit(0.0)) / 2))
        return near.withColumns({"cluster_label": F.when(noise, -1).otherwise(F.col("_n.c")).cast("int"), "cluster_probability": probability.cast("float")}).drop("_n")

    def apply(self, df: DataFrame) -> DataFrame:
        return self.label(self.place(df))


def fit_plane(df: DataFrame, d: int) -> Reducer:
    """The two main components of ``v``, from one pass over d x d sums."""
    n, s, c, _ = _sums(df.select(F.col("v").alias("x"), F.array(F.lit(0.0)).alias("y")))
    c = (c - np.outer(s, s) / n)[:d, :d]
    axes = np.linalg.eigh(c)[1][:, ::-1][:, :2]
    axes *= np.where(axes[np.abs(axes).argmax(0), [0, 1]] < 0, -1, 1)
    return Reducer((s[:d] / n).tolist(), axes.tolist())


def fit_centres(reducer: Reducer, placed: DataFrame, clusters: int, seed: int, reach: float) -> Reducer:
    """K-means centres of (map_1, map_2) and how far their members lie."""
    points = placed.withColumn("_v", array_to_vector(F.array("map_1", "map_2")))
    found = [tuple(map(float, c)) for c in KMeans(k=clusters, seed=seed, featuresCol="_v").fit(points).clusterCenters()]
    draft = Reducer(reducer.mean, reducer.axes, [(a, b, 0.0) for a, b in found], math.inf)
    own = F.array_min(F.array(*[F.struct((F.pow(F.col("map_1") - a, 2) + F.pow(F.col("map_2") - b, 2)).alias("d"), F.lit(i).alias("c")) for i, (a, b, _) in enumerate(draft.centres)]))
    widths = {r["c"]: r["w"] for r in placed.select(own.alias("n")).groupBy(F.col("n.c").alias("c")).agg(F.avg("n.d").alias("w")).collect()}  # one row per centre
    return Reducer(reducer.mean, reducer.axes, [(a, b, widths.get(i) or 0.0) for i, (a, b) in enumerate(found)], reach)


def principal_plane(df: DataFrame, d: int) -> DataFrame:
    return fit_plane(df, d).place(df)


def label_by_centroid(df: DataFrame, clusters: int, seed: int, reach: float) -> DataFrame:
    return fit_centres(Reducer([], []), df, clusters, seed, reach).label(df)


def signature_fit(spectrum: np.ndarray, signatures: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """EXT-03: non-negative least squares of a spectrum (96) on given signatures (96 x k),
    by multiplicative updates. The table of signatures is the user's."""
    x = np.full(signatures.shape[1], spectrum.sum() / max(signatures.shape[1], 1))
    top, gram = signatures.T @ spectrum, signatures.T @ signatures
    for _ in range(rounds):
        x = x * top / np.maximum(gram @ x, 1e-12)
    return x

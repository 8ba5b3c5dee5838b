"""Comparing latent spaces (AGG-14..16, AGG-29, CMP-01..06, JOIN-08..10).

A space is a DataFrame with an id and an array<double>. Two spaces are paired by id,
never by position. Everything of the size of d x d is built by one distributed pass;
only such matrices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import METRIC_ROWS, exact_sample

#: Fixed values (AGG-14, AGG-16).
ACTIVE_VARIANCE = 0.01
COLLAPSE = 0.01


def wide_to_array(df: DataFrame, key: str, prefix: str, first: int = 0, last: int | None = None) -> DataFrame:
    """PRJ-07: ``key`` and ``v``, the columns ``prefix<i>`` in the order of i."""
    names = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(key, F.array(*[F.col(c).cast("double") for c in names[first:last]]).alias("v"))


def as_space(scored: DataFrame, key: str) -> DataFrame:
    """``key`` and ``v`` of scored rows."""
    return scored.select(key, F.transform("latent", lambda x: x.cast("double")).alias("v"))


def width(df: DataFrame) -> int:
    row = df.select(F.size("v")).first()
    if row is None:
        raise ValueError("an empty space has no width")
    return row[0]


def moments(df: DataFrame, d: int) -> DataFrame:
    """AGG-14: mean and population variance (never below 0) per dimension, in one pass."""
    one = [F.struct(F.lit(i).alias("dim"), F.avg(F.col("v")[i]).alias("mean"), (F.avg(F.col("v")[i] * F.col("v")[i]) - F.avg(F.col("v")[i]) * F.avg(F.col("v")[i])).alias("var")) for i in range(d)]
    wide = df.agg(F.array(*one).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    return wide.select("n_rows", F.inline("m")).select("n_rows", "dim", "mean", F.greatest("var", F.lit(0.0)).alias("var"))


def active_units(moments_: DataFrame) -> DataFrame:
    return moments_.agg(F.count_if(F.col("var") > ACTIVE_VARIANCE).alias("active_units"), F.max("n_rows").alias("n_rows"))


def collapse_score(df: DataFrame, d: int) -> DataFrame:
    """AGG-15: mean over dimensions of the population deviation."""
    return df.agg((sum(F.stddev_pop(F.col("v")[i]) for i in range(d)) / d).alias("latent_collapse"))


def collapse_diagnosis(df: DataFrame, d: int) -> DataFrame:
    """AGG-16: a dimension has collapsed if its mean divergence or its variance is below 0.01.
    The divergence is that of a unit-variance posterior, half the mean square."""
    m = moments(df, d).withColumn("kl", (F.col("var") + F.col("mean") * F.col("mean")) / 2)
    down = (F.col("kl") < COLLAPSE) | (F.col("var") < COLLAPSE)
    lists = F.array_join(F.sort_array(F.collect_list(F.when(down, F.col("dim")))).cast("array<string>"), ",")
    return m.agg((100 * F.avg(F.when(down, 0.0).otherwise(1.0))).alias("active_percent"), F.count_if(down).alias("n_collapsed"), lists.alias("collapsed"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JOIN-08: ``x`` and ``y`` of every id that both spaces have."""
    return a.select(key, F.col("v").alias("x")).join(b.select(key, F.col("v").alias("y")), key)


def _sums(pairs: DataFrame) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Rows, sums and cross products of [x, y] over all pairs, added up per task, and the width of x."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, width = None, 0
        for batch in batches:
            if len(batch):
                width = len(batch["x"].iloc[0])
                z = np.hstack([np.stack(batch["x"].to_list()), np.stack(batch["y"].to_list())]).astype(float)
                add = np.vstack([np.hstack([[len(z)], z.sum(0)]), np.hstack([z.sum(0)[:, None], z.T @ z])])
                total = add if total is None else total + add
        if total is not None:
            yield pd.DataFrame({"i": np.arange(-1, total.size), "s": np.concatenate([[width], total.ravel()])})

    cells = pairs.select("x", "y").mapInPandas(part, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"), F.max("s").alias("most"))
    found = {r["i"]: r for r in cells.collect()}  # 1 + (1 + dx + dy) squared numbers
    if not found:
        raise ValueError("the spaces share no id")
    width = int(found.pop(-1)["most"])
    size = int(round(len(found) ** 0.5))
    m = np.array([found[i]["s"] for i in range(len(found))]).reshape(size, size)
    return int(round(m[0, 0])), m[0, 1:], m[1:, 1:], width


def _blocks(pairs: DataFrame, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, s, c, dx = _sums(pairs)
    if centred:
        c = c - np.outer(s, s) / n
    return c[:dx, :dx], c[:dx, dx:], c[dx:, dx:]


def linear_cka(pairs: DataFrame) -> float:
    """CMP-02: centred; 0 if a norm is below 1e-10."""
    xx, xy, yy = _blocks(pairs)
    a, b = np.linalg.norm(xx), np.linalg.norm(yy)
    return float(np.linalg.norm(xy) ** 2 / (a * b)) if a >= 1e-10 and b >= 1e-10 else 0.0


def gram_similarity(pairs: DataFrame) -> float:
    """CMP-03: uncentred, 1 - |XX' - YY'| / (|XX'| |YY'|) without n x n matrices. Not CKA."""
    xx, xy, yy = _blocks(pairs, centred=False)
    a, b = (xx**2).sum(), (yy**2).sum()
    gap = max(0.0, a + b - 2 * (xy**2).sum())
    return float(1 - np.sqrt(gap) / (np.sqrt(a) * np.sqrt(b))) if a and b else 0.0


def procrustes(pairs: DataFrame) -> float:
    """CMP-01: disparity after centring, scaling to unit norm and the best rotation."""
    xx, xy, yy = _blocks(pairs)
    a, b = np.sqrt(np.trace(xx)), np.sqrt(np.trace(yy))
    if not a or not b:
        raise ValueError("a space of equal points has no shape")
    return float(max(0.0, 1 - np.linalg.svd(xy / (a * b), compute_uv=False).sum() ** 2))


def metric_rows(pairs: DataFrame, key: str, rows: int = METRIC_ROWS, seed: int = 0) -> DataFrame:
    """SMP-08: what an O(n^2) metric is taken on; all pairs up to ``rows``, else a seeded sample."""
    return exact_sample(pairs, rows, seed, key)


def _ranked(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """Per row: the rank in x of its k nearest in y and the reverse.

    ``pairs`` is at most a metric sample (5,000 rows by default), sent to every task once; tasks take blocks of rows."""
    held = pairs.select(key, "x", "y").orderBy(key).limit(METRIC_ROWS + 1).collect()
    if len(held) > METRIC_ROWS:
        raise ValueError(f"more than {METRIC_ROWS} rows: take metric_rows() first")
    ids = np.array([r[0] for r in held])
    sent = pairs.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in held], float), np.array([r[2] for r in held], float)))
    columns = ["rank_in_x", "rank_in_y"]

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x, y = sent.value
        for batch in batches:
            for at in np.array_split(np.searchsorted(names, batch["id"].to_numpy()), max(1, len(batch) // 256)):
                out = {}
                for c, m in (("x", x), ("y", y)):
                    d = np.stack([((m - m[i]) ** 2).sum(1) for i in at])
                    d[np.arange(len(at)), at] = -1.0  # itself first, whatever lies on the same point
                    order = np.argsort(d, axis=1, kind="stable")
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
                    out[c] = order[:, 1 : k + 1], rank
                yield pd.DataFrame({
                    "id": names[at], "rank_in_x": list(np.take_along_axis(out["x"][1], out["y"][0], 1)), "rank_in_y": list(np.take_along_axis(out["y"][1], out["x"][0], 1)),
                })

    schema = "id bigint, " + ", ".join(f"{c} array<bigint>" for c in columns)
    spread = pairs.select(F.col(key).cast("bigint").alias("id")).repartition(max(1, min(64, len(held) // 256)), "id")
    return spread.mapInPandas(block, schema)


#: Rows of a block of the neighbour search, which is all that a task holds of each side.
BLOCK = 4_096


def _nearest(rows: DataFrame, key: str, k: int, spaces: Sequence[str]) -> DataFrame:
    """``space``, ``id``, ``place`` and ``neighbour``: the k nearest of every row among all others, ties by id.

    Rows are dealt into b blocks by a hash of the id. Each of the b x b pairs of blocks gives the k nearest
    of its query rows, of which the k nearest of all are kept; rows are sent b times, none to the driver."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("bigint").alias("id"), *spaces)
    n = rows.count()
    b = max(1, math.ceil(n / BLOCK), min(math.ceil(n / 256), math.ceil(spark.sparkContext.defaultParallelism**0.5)))
    parts = min(b * b, 4_096)
    own, other = F.pmod(F.xxhash64("id"), F.lit(b)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    fresh = [F.col(c).alias(c) for c in rows.columns]  # else the two sides are one to the planner
    # A number of partitions is given as the planner would put the few bytes into one task.
    asking = rows.select(*fresh, own.alias("q"), other.alias("s")).repartition(parts, "q", "s").groupBy("q", "s")
    stored = rows.select(*fresh, own.alias("s"), other.alias("q")).repartition(parts, "q", "s").groupBy("q", "s")

    def block(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values("id", kind="stable")
        ids, names, out = mine["id"].to_numpy(), theirs["id"].to_numpy(), []
        for space in spaces if len(ids) and len(names) else ():
            x, m = (np.stack(side[space].to_list()).astype(float) for side in (mine, theirs))
            for i, v in zip(ids, x):
                d = ((m - v) ** 2).sum(1)
                order = np.argsort(d, kind="stable")
                order = order[names[order] != i][:k]
                out.append((np.full(len(order), space, object), np.full(len(order), i), names[order], d[order]))
        columns = [np.concatenate(c) for c in zip(*out)] or [[]] * 4
        return pd.DataFrame(dict(zip(["space", "id", "neighbour", "d"], columns)))

    near = asking.cogroup(stored).applyInPandas(block, "space string, id bigint, neighbour bigint, d double")
    place = F.row_number().over(Window.partitionBy("space", "id").orderBy("d", "neighbour"))
    return near.withColumn("place", place).where(F.col("place") <= k).select("space", "id", "place", "neighbour")


def nearest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """JOIN-09: ``id``, ``place`` and ``neighbour`` in x, over all rows; ties by id."""
    return _nearest(rows, key, k, ["x"]).drop("space")


def knn_jaccard(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """CMP-04, JOIN-10: mean overlap of the k nearest in both spaces, over all rows."""
    near = _nearest(pairs, key, k, ["x", "y"]).groupBy("id").agg(*[F.collect_list(F.when(F.col("space") == s, F.col("neighbour"))).alias(s) for s in "xy"])
    return near.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


def trustworthiness(pairs: DataFrame, key: str, k: int, swapped: bool = False) -> DataFrame:
    """CMP-05: how far the k nearest in y are from being so in x; ``swapped`` gives CMP-06, continuity."""
    n = pairs.count()
    k = min(k, max(1, int(n / 2 - 1)))
    penalty = F.aggregate(F.col("rank_in_y" if swapped else "rank_in_x"), F.lit(0).cast("bigint"), lambda s, r: s + F.greatest(r - k, F.lit(0)))
    scale = 2.0 / (n * k * (2 * n - 3 * k - 1))
    return _ranked(pairs, key, k).agg((1 - F.sum(penalty) * F.lit(scale)).alias("continuity" if swapped else "trustworthiness"))


def _pairs_of(c: Column) -> Column:
    return c.cast("double") * (c - 1) / 2


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-29: adjusted Rand index and normalised mutual information (arithmetic mean),
    from the contingency of two labellings; rows with a null label are left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy("a").agg(F.sum("n").alias("na"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    one = cells.crossJoin(F.broadcast(total)).join(ra, "a").join(rb, "b").agg(
        F.sum(_pairs_of(F.col("n"))).alias("both"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"), F.max("t").alias("t")
    )
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    ha = ra.crossJoin(F.broadcast(total)).agg(F.sum(_pairs_of(F.col("na"))).alias("pa"), entropy("na").alias("ha"))
    hb = rb.crossJoin(F.broadcast(total)).agg(F.sum(_pairs_of(F.col("nb"))).alias("pb"), entropy("nb").alias("hb"))
    flat = one.crossJoin(ha).crossJoin(hb)  # three single rows
    expected = F.col("pa") * F.col("pb") / _pairs_of(F.col("t"))
    ari = F.try_divide(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected)
    nmi = F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2)
    return flat.select(F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(nmi, F.lit(1.0)).alias("nmi"))

"""Training over any number of rows (MDL-06): each epoch is a job, no row reaches the driver."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import ACTIVE_VARIANCE, AdamW, Fitted, History, Shape, Training, Weights, arrays, batch_step, encode, initial_weights, loss_and_gradient
from .sampling import sample_key

_LOSSES = ("total_loss", "numeric_loss", "categorical_loss", "kl_loss")
_RESULT = "part int, n bigint, weights binary, batches bigint, " + ", ".join(f"{c} double" for c in _LOSSES)


def _packed(w: Weights) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **w)
    return buffer.getvalue()


def _unpacked(data: bytes) -> Weights:
    return dict(np.load(io.BytesIO(data)))


def _batches(parts: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of ``size`` rows over the borders of frames; at most one frame and one batch are held."""
    held: tuple[np.ndarray, ...] | None = None
    for part in parts:
        if not len(part):
            continue
        new = arrays(part)
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        while len(held[1]) >= size:
            yield tuple(x[:size] for x in held)
            held = tuple(x[size:] for x in held)
    if held is not None and len(held[1]):
        yield held


def _epoch(train: DataFrame, w: Weights, shape: Shape, t: Training, epoch: int, key: str, tasks: int) -> tuple[Weights, dict]:
    """Every task takes its rows once, in the epoch's order, from the common weights on; the
    weights they end with are averaged, weighted by rows, in two steps so that about
    the root of ``tasks`` models reach the driver."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(w)
    part = F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")
    order = sample_key(t.seed + epoch, key)
    dealt = train.select("cat", "num", "mask", part.alias("_part"), order.alias("_order")).repartition(tasks, "_part").sortWithinPartitions("_part", "_order")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        optimiser, n, seen, number = AdamW({k: v.copy() for k, v in sent.value.items()}, t), 0, [], None

        def counted() -> Iterator[pd.DataFrame]:
            nonlocal number
            for frame in parts:
                number = int(frame["_part"].iloc[0]) if number is None and len(frame) else number
                yield frame

        for batch in _batches(counted(), t.batch_size):
            seen.append(batch_step(optimiser, shape, batch, np.random.default_rng([t.seed, epoch, number, len(seen)])))
            n += len(batch[1])
        if n:
            sums = {k: [sum(s[k] for s in seen)] for k in _LOSSES}
            yield pd.DataFrame({"part": [number], "n": [n], "weights": [_packed(optimiser.w)], "batches": [len(seen)], **sums})

    groups = max(1, ceil(tasks**0.5))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        models = [(n, _unpacked(x)) for n, x in zip(frame["n"], frame["weights"])]
        total = sum(n for n, _ in models)
        mean = {k: sum(n * m[k] for n, m in models) / total for k in models[0][1]}
        return pd.DataFrame({"part": frame["part"].iloc[:1], "n": [total], "weights": [_packed(mean)], **{k: [frame[k].sum()] for k in ("batches", *_LOSSES)}})

    merged = dealt.mapInPandas(run, _RESULT).groupBy(F.pmod("part", F.lit(groups))).applyInPandas(merge, _RESULT).toPandas()
    sent.unpersist()
    if not len(merged):
        raise ValueError("no row to train on")
    final = merge(merged).iloc[0]
    return _unpacked(final["weights"]), {k: final[k] / final["batches"] for k in _LOSSES}


def _validate(val: DataFrame, w: Weights, shape: Shape, t: Training) -> tuple[dict, int]:
    """MDL-04: the mean of the batch losses and the active units in one pass, from sums of every task."""
    sent = val.sparkSession.sparkContext.broadcast(w)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, float] = {}
        for batch in _batches(parts, t.batch_size):
            losses, _ = loss_and_gradient(sent.value, shape, *batch, t.kl_weight, gradient=False)
            mu, _ = encode(sent.value, shape, batch[0], batch[1])
            more = losses | {"batches": 1, "rows": len(mu)} | {f"s{i}": x for i, x in enumerate(mu.sum(0))} | {f"q{i}": x for i, x in enumerate((mu**2).sum(0))}
            sums = {k: sums.get(k, 0.0) + float(v) for k, v in more.items()}
        yield pd.DataFrame({"name": list(sums), "value": list(sums.values())})

    named = val.select("cat", "num", "mask").mapInPandas(run, "name string, value double").groupBy("name").agg(F.sum("value").alias("value"))
    sums = {r["name"]: r["value"] for r in named.collect()}
    sent.unpersist()
    if not sums:
        raise ValueError("no row to validate on")
    n = sums["rows"]
    active = sum(sums[f"q{i}"] / n - (sums[f"s{i}"] / n) ** 2 > ACTIVE_VARIANCE for i in range(shape.latent))
    return {k: sums[k] / sums["batches"] for k in _LOSSES}, int(active)


def fit_stream(
    train: DataFrame, val: DataFrame, shape: Shape, t: Training = Training(), key: str = "row_index", tasks: int = 8, on_epoch: Callable[[int, Fitted, dict], None] | None = None
) -> Fitted:
    """MDL-06: like ``model.fit``, over encoded rows that stay in the cluster.

    ``on_epoch`` gets each epoch's model, so convergence can be followed. ``tasks`` is part of the
    result: a row belongs to one of them by its key, whatever the partitioning."""
    w = initial_weights(shape, t.seed)
    history = History(shape, w, t, on_epoch)
    for epoch in range(1, t.epochs + 1):
        w, seen = _epoch(train, w, shape, t, epoch, key, tasks)
        held, active = _validate(val, w, shape, t)
        if history.add(epoch, w, seen, held, active):
            break
    return history.fitted

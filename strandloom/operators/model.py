"""A small tabular variational autoencoder in NumPy (MDL-01..05, MDL-07..09, AGG-17, AGG-18).

``fit`` takes a sample that the driver holds (``Training.sample_rows`` bounds it);
``stream_training.fit_stream`` takes any number of rows. Scoring runs in the workers. Parameters are a
flat dict of arrays, written as a long parquet table, never as a pickle. All draws come
from seeds, so a fit repeats exactly.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .encoding import Feature
from .latent import ACTIVE_VARIANCE

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Layer sizes: categories and widths per categorical, numerics, hidden layers, latents."""

    categories: tuple[int, ...]
    widths: tuple[int, ...]
    numerics: int
    hidden: tuple[int, ...] = (256, 128)
    latent: int = 16

    @classmethod
    def of(cls, features: Sequence[Feature], hidden: Sequence[int] = (256, 128), latent: int = 16) -> Shape:
        cats = [f for f in features if f.kind == "c"]
        sizes = tuple(max(f.values.values()) + 1 for f in cats)
        return cls(sizes, tuple(f.embedding_width for f in cats), len(features) - len(cats), tuple(hidden), latent)


@dataclass(frozen=True)
class Training:
    epochs: int = 10
    batch_size: int = 4_096
    learning_rate: float = 1e-3
    weight_decay: float = 1e-2
    kl_weight: float = 0.05
    input_dropout: float = 0.0
    hidden_dropout: float = 0.0
    seed: int = 42
    #: Rows that the driver may fit on.
    sample_rows: int = 200_000
    patience: int = 0
    min_delta: float = 1e-3
    #: MDL-04: forward and backward passes in single precision, weights and steps in double.
    mixed: bool = False


@dataclass
class Fitted:
    weights: Weights
    shape: Shape
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0


def initial_weights(shape: Shape, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {f"embed{i}": rng.normal(size=(c, e)) for i, (c, e) in enumerate(zip(shape.categories, shape.widths))}

    def dense(name: str, a: int, b: int) -> None:
        limit = 1 / np.sqrt(max(a, 1))
        w[f"{name}_w"], w[f"{name}_b"] = rng.uniform(-limit, limit, (a, b)), rng.uniform(-limit, limit, b)

    sizes = [sum(shape.widths) + shape.numerics, *shape.hidden]
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        dense(f"enc{i}", a, b)
    dense("mu", sizes[-1], shape.latent)
    dense("logvar", sizes[-1], shape.latent)
    back = [shape.latent, *reversed(shape.hidden)]
    for i, (a, b) in enumerate(zip(back, back[1:])):
        dense(f"dec{i}", a, b)
    dense("num", back[-1], shape.numerics)
    for i, c in enumerate(shape.categories):
        dense(f"cat{i}", back[-1], c)
    return w


def encode(w: Weights, shape: Shape, cat: np.ndarray, num: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MDL-07: posterior mean and log variance, without dropout or sampling."""
    h = np.hstack([*[w[f"embed{i}"][cat[:, i]] for i in range(len(shape.categories))], num])
    for i in range(len(shape.hidden)):
        h = np.maximum(h @ w[f"enc{i}_w"] + w[f"enc{i}_b"], 0)
    return h @ w["mu_w"] + w["mu_b"], h @ w["logvar_w"] + w["logvar_b"]


def loss_and_gradient(
    w: Weights, shape: Shape, cat: np.ndarray, num: np.ndarray, mask: np.ndarray, kl_weight: float,
    noise: np.ndarray | None = None, drops: Sequence[np.ndarray] = (), gradient: bool = True,
) -> tuple[dict, Weights]:
    """AGG-17: masked squared error over at least one value, mean cross-entropy over
    features, mean divergence; and the gradient of numeric + categorical + weight x KL.

    ``noise`` is the standard normal draw (None: the mean itself), ``drops`` factors for
    the input and each hidden layer of the encoder."""
    n = len(num)
    ones = lambda i: drops[i] if drops else 1.0
    x = np.hstack([*[w[f"embed{i}"][cat[:, i]] for i in range(len(shape.categories))], num]) * ones(0)
    acts = [x]
    for i in range(len(shape.hidden)):
        acts.append(np.maximum(acts[-1] @ w[f"enc{i}_w"] + w[f"enc{i}_b"], 0) * ones(i + 1))
    mu, logvar = acts[-1] @ w["mu_w"] + w["mu_b"], acts[-1] @ w["logvar_w"] + w["logvar_b"]
    eps = np.zeros_like(mu) if noise is None else noise
    spread = np.exp(0.5 * logvar)
    back = [mu + eps * spread]
    for i in range(len(shape.hidden)):
        back.append(np.maximum(back[-1] @ w[f"dec{i}_w"] + w[f"dec{i}_b"], 0))
    error = (back[-1] @ w["num_w"] + w["num_b"] - num) * mask
    present = max(mask.sum(), 1.0)
    numeric = float((error**2).sum() / present)
    categorical, logits_gradient = 0.0, []
    for i in range(len(shape.categories)):
        logits = back[-1] @ w[f"cat{i}_w"] + w[f"cat{i}_b"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        total = p.sum(1, keepdims=True)
        categorical += float((np.log(total[:, 0]) - logits[np.arange(n), cat[:, i]]).mean())
        p /= total
        p[np.arange(n), cat[:, i]] -= 1
        logits_gradient.append(p / (n * len(shape.categories)))
    categorical /= max(len(shape.categories), 1)
    kl = float(-0.5 * (1 + logvar - mu**2 - np.exp(logvar)).sum(1).mean())
    losses = {"total_loss": numeric + categorical + kl_weight * kl, "numeric_loss": numeric, "categorical_loss": categorical, "kl_loss": kl}
    if not gradient:
        return losses, {}

    g: Weights = {}

    def through(name: str, source: np.ndarray, delta: np.ndarray) -> np.ndarray:
        g[f"{name}_w"], g[f"{name}_b"] = source.T @ delta, delta.sum(0)
        return delta @ w[f"{name}_w"].T

    d = through("num", back[-1], 2 * error / present)
    for i, delta in enumerate(logits_gradient):
        d = d + through(f"cat{i}", back[-1], delta)
    for i in reversed(range(len(shape.hidden))):
        d = through(f"dec{i}", back[i], d * (back[i + 1] > 0))
    d_mu = d + kl_weight * mu / n
    d_logvar = d * eps * spread * 0.5 + kl_weight * 0.5 * (np.exp(logvar) - 1) / n
    d = through("mu", acts[-1], d_mu) + through("logvar", acts[-1], d_logvar)
    for i in reversed(range(len(shape.hidden))):
        d = through(f"enc{i}", acts[i], d * ones(i + 1) * (acts[i + 1] > 0))
    d = d * ones(0)
    at = 0
    for i, width in enumerate(shape.widths):
        table = np.zeros_like(w[f"embed{i}"])
        np.add.at(table, cat[:, i], d[:, at : at + width])
        g[f"embed{i}"] = table
        at += width
    return losses, g


class AdamW:
    """Adam with decoupled weight decay; changes the weights in place."""

    def __init__(self, w: Weights, t: Training):
        self.w, self.t, self.step = w, t, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def update(self, g: Weights) -> None:
        rate = self.t.learning_rate
        self.step += 1
        for k, w in self.w.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g[k]
            self.second[k] = 0.999 * self.second[k] + 0.001 * g[k] ** 2
            w *= 1 - rate * self.t.weight_decay
            w -= rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


def batch_step(optimiser: AdamW, shape: Shape, batch: tuple[np.ndarray, ...], rng: np.random.Generator) -> dict:
    """MDL-02..04: the losses of one batch, after which the weights have moved."""
    t, n, drops = optimiser.t, len(batch[1]), []
    if t.input_dropout or t.hidden_dropout:
        rates = [t.input_dropout, *[t.hidden_dropout] * len(shape.hidden)]
        sizes = [sum(shape.widths) + shape.numerics, *shape.hidden]
        drops = [(rng.random((n, s)) >= r) / (1 - r) for r, s in zip(rates, sizes)]
    w, noise = optimiser.w, rng.normal(size=(n, shape.latent))
    if t.mixed:
        single = lambda x: x.astype(np.float32)
        w, noise, drops, batch = {k: single(v) for k, v in w.items()}, single(noise), [single(d) for d in drops], (batch[0], single(batch[1]), single(batch[2]))
    losses, g = loss_and_gradient(w, shape, *batch, t.kl_weight, noise, drops)
    optimiser.update(g)
    return losses


class History:
    """MDL-05: the epochs so far, the best weights, and whether to stop.

    With ``patience`` > 0, stops after so many epochs that gain at most ``min_delta``
    of the best loss while the active units stay the same."""

    def __init__(self, shape: Shape, w: Weights, t: Training, on_epoch: Callable[[int, Fitted, dict], None] | None = None):
        self.t, self.on_epoch = t, on_epoch
        self.fitted = Fitted({k: v.copy() for k, v in w.items()}, shape)
        self.best, self.stagnant, self.units = np.inf, 0, None

    def add(self, epoch: int, w: Weights, train: dict, val: dict, active: int) -> bool:
        row = {"epoch": epoch, **{f"train_{k}": float(v) for k, v in train.items()}, **{f"val_{k}": float(v) for k, v in val.items()}, "active_units": active}
        self.fitted.history.append(row)
        loss = row["val_total_loss"]
        gain = (self.best - loss) / abs(self.best) if np.isfinite(self.best) and self.best else np.inf
        self.stagnant = self.stagnant + 1 if gain <= self.t.min_delta and active == self.units else 0
        self.units = active
        if loss < self.best:
            self.best, self.fitted.best_epoch = loss, epoch
            self.fitted.weights = {k: v.copy() for k, v in w.items()}
        if self.on_epoch:
            self.on_epoch(epoch, Fitted({k: v.copy() for k, v in w.items()}, self.fitted.shape), row)
        return bool(self.t.patience and self.stagnant >= self.t.patience)


def fit(shape: Shape, train: tuple[np.ndarray, ...], val: tuple[np.ndarray, ...], t: Training = Training(), on_epoch: Callable[[int, Fitted, dict], None] | None = None) -> Fitted:
    """AdamW over shuffled batches; an epoch's metric is the plain mean of its batches
    (AGG-18). Gives the weights of the best epoch back."""
    optimiser = AdamW(initial_weights(shape, t.seed), t)
    history = History(shape, optimiser.w, t, on_epoch)
    mean = lambda rows: {k: np.mean([r[k] for r in rows]) for k in rows[0]}
    for epoch in range(1, t.epochs + 1):
        rng = np.random.default_rng([t.seed, epoch])
        order = rng.permutation(len(train[1]))
        seen = [batch_step(optimiser, shape, tuple(x[order[a : a + t.batch_size]] for x in train), rng) for a in range(0, len(order), t.batch_size)]
        held = [loss_and_gradient(optimiser.w, shape, *(x[a : a + t.batch_size] for x in val), t.kl_weight, gradient=False)[0] for a in range(0, len(val[1]), t.batch_size)]
        active = int((encode(optimiser.w, shape, val[0], val[1])[0].var(0) > ACTIVE_VARIANCE).sum())
        if history.add(epoch, optimiser.w, mean(seen), mean(held), active):
            break
    return history.fitted


def diagnostics_report(fitted: Fitted, t: Training) -> dict:
    """MDL-05: how training went, why it ended and what the latents did."""
    rows = fitted.history
    last, best = rows[-1], rows[fitted.best_epoch - 1]
    early = len(rows) < t.epochs
    return {
        "epochs_run": len(rows), "epochs_planned": t.epochs, "stopped_early": early, "reason": f"no gain above {t.min_delta:g} in {t.patience} epochs" if early else "all epochs run",
        "best_epoch": fitted.best_epoch, "best_val_total_loss": best["val_total_loss"], "last_val_total_loss": last["val_total_loss"], "generalisation_gap": best["val_total_loss"] - best["train_total_loss"],
        "active_units": best["active_units"], "active_percent": 100.0 * best["active_units"] / fitted.shape.latent, "collapsed_units": fitted.shape.latent - best["active_units"],
        "changes": [(b["val_total_loss"] - a["val_total_loss"]) / abs(a["val_total_loss"]) if a["val_total_loss"] else 0.0 for a, b in zip(rows, rows[1:])],
    }


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stack = lambda c, kind: np.array(pdf[c].to_list(), dtype=kind).reshape(len(pdf), -1)
    return stack("cat", np.int64), stack("num", float), stack("mask", float)


#: Rows that ``matrices`` brings to the driver at most.
DRIVER_ROWS = 2_000_000


def matrices(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoded rows as arrays on the driver. More than ``DRIVER_ROWS`` are refused: ``fit_stream`` takes those."""
    pdf = df.select("cat", "num", "mask").limit(DRIVER_ROWS + 1).toPandas()
    if len(pdf) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} rows; use fit_stream")
    return arrays(pdf)


class Progress:
    """API-03: calls ``callback(rows, batches)`` on the driver while an action scores rows.

    Tasks report as they end. Use as a context manager around the action and give it to ``score``."""

    def __init__(self, spark: SparkSession, callback: Callable[[int, int], None], every: float = 1.0):
        self.rows, self.batches = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        self._callback, self._every, self._end = callback, every, threading.Event()
        self._last, self._thread = (0, 0), threading.Thread(target=self._watch, daemon=True)

    def _tell(self) -> None:
        now = (self.rows.value, self.batches.value)
        if now != self._last:
            self._last = now
            self._callback(*now)

    def _watch(self) -> None:
        while not self._end.wait(self._every):
            self._tell()

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()
        self._tell()


def score(df: DataFrame, fitted: Fitted, keep: Sequence[str], progress: Progress | None = None) -> DataFrame:
    """MDL-07, MDL-08: ``keep`` and ``latent`` array<float> of every encoded row, in any partitioning."""
    rows, batches = (progress.rows, progress.batches) if progress else (None, None)
    sent, shape = df.sparkSession.sparkContext.broadcast(fitted.weights), fitted.shape
    schema = df.select(*keep).schema.add("latent", ArrayType(FloatType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for part in parts:
            cat = np.array(part["cat"].to_list(), dtype=np.int64).reshape(len(part), -1)
            num = np.array(part["num"].to_list(), dtype=float).reshape(len(part), -1)
            mu, _ = encode(w, shape, cat, num)
            if rows is not None:
                rows.add(len(part))
                batches.add(1)
            yield part[list(keep)].assign(latent=list(mu.astype(np.float32)))

    return df.select(*keep, "cat", "num").mapInPandas(run, schema)


def expand(df: DataFrame, d: int) -> DataFrame:
    """PRJ-05: ``latent_0`` .. in place of the array."""
    return df.select(*[c for c in df.columns if c != "latent"], *[F.col("latent")[i].alias(f"latent_{i}") for i in range(d)])


def with_encoder(df: DataFrame, encoder: Callable[[pd.DataFrame], np.ndarray], keep: Sequence[str]) -> DataFrame:
    """API-01: any encoder of a frame as a source of latents."""
    schema = df.select(*keep).schema.add("latent", ArrayType(FloatType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[list(keep)].assign(latent=list(np.asarray(encoder(part), np.float32)))

    return df.mapInPandas(run, schema)


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """SNK-07: one row per number; shape and history as a JSON line."""
    import json

    rows = [(k, int(i), int(j), float(x)) for k, v in fitted.weights.items() for (i, j), x in np.ndenumerate(np.atleast_2d(v))]
    spark.createDataFrame(rows, "tensor string, i int, j int, value double").write.mode("overwrite").parquet(f"{path}/weights")
    meta = json.dumps({"shape": asdict(fitted.shape), "history": fitted.history, "best_epoch": fitted.best_epoch})
    spark.createDataFrame([(meta,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Fitted:
    """SRC-09. The weights are as many as the model has, whatever the data."""
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    shape = Shape(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["shape"].items()})
    pdf = spark.read.parquet(f"{path}/weights").toPandas()
    like, weights = initial_weights(shape, 0), {}
    for name, part in pdf.groupby("tensor"):
        m = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        m[part["i"], part["j"]] = part["value"]
        weights[name] = m.reshape(like[name].shape)
    return Fitted(weights, shape, meta["history"], meta["best_epoch"])

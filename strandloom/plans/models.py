"""Queries that train, score and compare models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import encoding, evaluation, latent, model, reduce, sampling, stream_training
from ..session import cut_lineage
from ..sources.tables import table
from .records import SPECTRUM_SQL
from .registry import observations, query
from .variants import DEFAULT_FILTER, NUMERIC, ST, TM

FEATURES = [TM, encoding.Feature("ref_base", "c", {"A": 0, "C": 1, "G": 2, "T": 3, "": 4}), *[encoding.Feature(c, "float") for c in NUMERIC if c not in ("snvq", "sd")]]
#: A bounded sample fits the model; every row is scored.
TRAINING = model.Training(epochs=3, batch_size=1_024, sample_rows=20_000)


def encoded(spark, folder, features=FEATURES, predicate=DEFAULT_FILTER):
    """Rows that pass the filter, encoded, with the features kept and their statistics."""
    rows = observations(spark, folder, ["st", "et", "filt", *[f.name for f in features]])
    rows = rows.where(F.expr(predicate)) if predicate else rows
    kept = encoding.kept_features(rows, features)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in encoding.sample_stats(rows, [f.name for f in kept if f.kind != "c"]).collect()}
    return cut_lineage(encoding.encode(rows, kept, stats).select("row_index", "cat", "num", "mask")), kept


def trained(rows, kept, training=TRAINING, on_epoch=None, shape=((64, 32), 8)):
    """SMP-05 splits the sample; the fit sees rows in the order of their numbers."""
    sample = sampling.exact_sample(rows, training.sample_rows, training.seed, "row_index").orderBy("row_index")
    split = sampling.modulo_split(F.col("row_index"), 0.9, training.seed)
    train, val = (model.matrices(sample.where(split == s)) for s in ("train", "val"))
    return model.fit(model.Shape.of(kept, *shape), train, val, training, on_epoch)


@query()
def vae_train_history(spark, folder):
    """MDL-01..06, AGG-17/18: the losses of every epoch."""
    return spark.createDataFrame(pd.DataFrame(trained(*encoded(spark, folder)).history))


@query()
def vae_score(spark, folder):
    """MDL-07/08, PRJ-05: the latents of every row."""
    rows, kept = encoded(spark, folder)
    return model.expand(model.score(rows, trained(rows, kept), ["row_index"]), 8)


@query()
def vae_stream_history(spark, folder):
    """MDL-06, MDL-02: every row is trained on, in the cluster, with dropout and early stopping."""
    rows, kept = encoded(spark, folder)
    split = sampling.modulo_split(F.col("row_index"), 0.9, 42)
    t = model.Training(epochs=3, batch_size=1_024, input_dropout=0.1, hidden_dropout=0.4, patience=2)
    fitted = stream_training.fit_stream(rows.where(split == "train"), rows.where(split == "val"), model.Shape.of(kept, (64, 32), 8), t)
    return spark.createDataFrame(pd.DataFrame(fitted.history))


@query()
def convergence_bundle(spark, folder):
    """CMP-09, WIN-04: each epoch's latents against those of the epoch before, on one held-out sample (SMP-08)."""
    rows, kept = encoded(spark, folder)
    held = cut_lineage(sampling.exact_sample(rows, 1_000, 99, "row_index"))
    spaces = []
    trained(rows, kept, model.Training(epochs=3, batch_size=1_024, sample_rows=5_000), lambda epoch, now, row: spaces.append(latent.as_space(model.score(held, now, ["row_index"]), "row_index")))
    out = [{"epoch": i + 2, **evaluation.bundle(latent.paired(a, b, "row_index"), "row_index")} for i, (a, b) in enumerate(zip(spaces, spaces[1:]))]
    return spark.createDataFrame(pd.DataFrame(out))


@query()
def evaluation_table(spark, folder):
    """CMP-08, SMP-09, TOP-08, API-01/02: models of a ladder of sizes against the largest, on one fixed reference sample, labels by centroid."""
    rows, kept = encoded(spark, folder)
    held = cut_lineage(sampling.exact_sample(rows, 1_000, 42 + sampling.REFERENCE_OFFSET, "row_index"))

    def trainer(sample, random_seed):
        fitted = trained(sample, kept, model.Training(epochs=2, batch_size=512, sample_rows=model.DRIVER_ROWS, seed=random_seed))
        return fitted, lambda df: latent.as_space(model.score(df, fitted, ["row_index"]), "row_index"), {"val_total_loss": fitted.history[-1]["val_total_loss"]}

    def labels(space):
        plane = reduce.principal_plane(space, 8)
        return reduce.label_by_centroid(plane, 6, 42, 3.0).withColumnRenamed("cluster_label", "label")

    out = evaluation.evaluate_subsamples(rows, held, (5_000, 2_500, 1_250), trainer, "row_index", 42, labels)
    return spark.createDataFrame(pd.DataFrame(out))


_BASE = {"A": 0, "C": 1, "G": 2, "T": 3, "": 4}
#: As many categorical and numeric features as the published runs kept: 11 and 15.
WIDE = [
    TM, ST, encoding.Feature("et", "c", dict(ST.values)), *[encoding.Feature(c, "c", _BASE) for c in ("ref_base", "alt_base", *[f"x_{side}{i}" for i in (1, 2, 3) for side in ("prev", "next")])],
    *[encoding.Feature(c, "float") for c in (*[c for c in NUMERIC if c != "sd"], "hamdist_filt", "bcsqcss", "x_hmer_ref", "x_hmer_alt", "scst")],
]


@query()
def vae_published_size(spark, folder):
    """MDL-01..08: the published configuration (hidden 256 and 128, 16 latents, batches of 4,096, 10 epochs, rate 1e-3,
    divergence weight 0.05, 90 % for training; mixed precision) on up to 100,000 rows; then all rows are scored and measured."""
    rows, kept = encoded(spark, folder, WIDE, None)
    fitted = trained(rows, kept, model.Training(sample_rows=100_000, mixed=True), shape=((256, 128), 16))
    space = cut_lineage(latent.as_space(model.score(rows, fitted, ["row_index"]), "row_index"))
    down, best = latent.collapse_diagnosis(space, 16).first(), fitted.history[fitted.best_epoch - 1]
    row = {"n_scored": space.count(), "best_epoch": fitted.best_epoch, "val_total_loss": best["val_total_loss"], "latent_collapse": latent.collapse_score(space, 16).first()[0], "active_percent": down["active_percent"]}
    return spark.createDataFrame(pd.DataFrame([row]))


@query()
def plane_and_labels(spark, folder):
    """EXT-01/02 substitutes: two principal components and nearest centroids, -1 for the far."""
    space = latent.wide_to_array(table(spark, folder, "embedding"), "row_index", "latent_")
    plane = reduce.principal_plane(space, 16).drop("v")
    return reduce.label_by_centroid(plane, 8, 42, 2.5)


_KNOWN = r"regexp_matches(sbs96, '^[ACGT]\[[ACGT]>[ACGT]\][ACGT]$')"


@query(f"""SELECT cluster_label, round(CAST(coalesce(sum(n) FILTER (WHERE contains(sbs96, 'C>T') AND {_KNOWN}), 0) AS DOUBLE), 4) AS transition,
    round(CAST(coalesce(sum(n) FILTER (WHERE NOT contains(sbs96, 'C>T') AND {_KNOWN}), 0) AS DOUBLE), 4) AS other FROM ({SPECTRUM_SQL}) GROUP BY cluster_label""")
def signature_activities(spark, folder):
    """EXT-03: the spectra of all clusters on a user's table; here two plain signatures, for which the fit is the sum of their parts."""
    from ..functions.contexts import sbs96_labels
    from ..operators import labelled

    names = sbs96_labels()
    wide = labelled.spectrum(labelled.context_counts(table(spark, folder, "analysis")))
    spectra = wide.groupBy("cluster_label").agg(F.map_from_entries(F.collect_list(F.struct("sbs96", "n"))).alias("s"))  # at most 96 entries
    signatures = np.array([["C>T" in x, "C>T" not in x] for x in names], float)
    signatures /= signatures.sum(0)

    def solve(parts):
        for part in parts:
            found = [reduce.signature_fit(np.array([dict(s).get(x, 0) for x in names], float), signatures) for s in part["s"]]
            yield pd.DataFrame({"cluster_label": part["cluster_label"], "transition": [f[0] for f in found], "other": [f[1] for f in found]})

    found = spectra.mapInPandas(solve, "cluster_label int, transition double, other double")
    return found.withColumns({c: F.round(c, 4) for c in ("transition", "other")})

"""Command line: ``python -m strandloom COMMAND ...`` (API-04..API-10)."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import encoding, evaluation, exports, histograms, labelled, latent, model, ranked, reduce, sampling, stream_training, sweeps
from .session import cut_lineage
from .sources import files


def _features(args) -> list[encoding.Feature]:
    return encoding.read_features(args.features)


def _encode(args, spark):
    rows = spark.read.parquet(args.input)
    if args.where:
        rows = rows.where(F.expr(args.where))
    kept = encoding.kept_features(rows, _features(args))
    names = [f.name for f in kept if f.kind != "c"]
    stats = {r["feature"]: (r["mean"], r["std"]) for r in encoding.sample_stats(rows, names).collect()}
    return encoding.encode(rows, kept, stats), kept, stats


def _training(args) -> model.Training:
    return model.Training(
        epochs=args.epochs, batch_size=args.batch_size, seed=args.seed, sample_rows=args.sample_rows, patience=args.patience, min_delta=args.min_delta, input_dropout=args.input_dropout, hidden_dropout=args.hidden_dropout,
        learning_rate=args.learning_rate, kl_weight=args.kl_weight, mixed=args.mixed,
    )


def _fit(args, rows, kept, t: model.Training, on_epoch=None) -> model.Fitted:
    """On the sample, or with --stream over all rows."""
    shape = model.Shape.of(kept, args.hidden, args.latent)
    split = sampling.modulo_split(F.col(args.key), args.train_fraction, t.seed)
    if args.stream:
        rows = cut_lineage(rows.select(args.key, "cat", "num", "mask"))
        return stream_training.fit_stream(rows.where(split == "train"), rows.where(split == "val"), shape, t, args.key, args.tasks, on_epoch)
    sample = sampling.exact_sample(rows, t.sample_rows, args.data_seed if args.data_seed is not None else t.seed, args.key).orderBy(args.key)
    return model.fit(shape, *(model.matrices(sample.where(split == s)) for s in ("train", "val")), t, on_epoch)


def _save(args, spark, fitted, kept, stats, t: model.Training, output: str, changes: list[dict]) -> None:
    model.save(spark, fitted, output)
    files.write_json({"features": [{"name": f.name, "type": f.kind, "values": dict(f.values)} for f in kept], "stats": stats, "history": fitted.history, "convergence": changes}, f"{output}/report.json")
    files.write_json(model.diagnostics_report(fitted, t), f"{output}/diagnostics_report.json")


def train(args, spark) -> None:
    rows, kept, stats = _encode(args, spark)
    t, spaces, changes = _training(args), [], []
    held = cut_lineage(sampling.exact_sample(rows, args.convergence, 99, args.key)) if args.convergence else None

    def follow(epoch, now, row):
        spaces.append(latent.as_space(model.score(held, now, [args.key]), args.key))
        if len(spaces) > 1:
            changes.append({"epoch": epoch, **evaluation.bundle(latent.paired(spaces[-2], spaces[-1], args.key), args.key)})

    fitted = _fit(args, rows, kept, t, follow if args.convergence else None)
    _save(args, spark, fitted, kept, stats, t, args.output, changes)


def evaluate_subsamples(args, spark) -> None:
    rows, kept, _ = _encode(args, spark)
    rows = cut_lineage(rows)
    held = cut_lineage(sampling.exact_sample(rows, args.held_rows, args.seed + sampling.REFERENCE_OFFSET, args.key))

    def trainer(sample, random_seed):
        fitted = _fit(args, sample, kept, replace(_training(args), seed=random_seed))
        return fitted, lambda df: latent.as_space(model.score(df, fitted, [args.key]), args.key), {"val_total_loss": fitted.history[fitted.best_epoch - 1]["val_total_loss"]}

    def labels(space):
        return reduce.label_by_centroid(reduce.principal_plane(space, args.latent), args.clusters, args.seed, 3.0).withColumnRenamed("cluster_label", "label")

    table = evaluation.evaluate_subsamples(rows, held, [max(1, int(args.sample_rows * f)) for f in args.fractions], trainer, args.key, args.seed, labels if args.clusters else None)
    files.write_tsv(spark.createDataFrame(table).coalesce(1), args.output)


def sweep(args, spark) -> None:
    """Every number of rows with every seed; finished runs are kept."""
    rows, kept, stats = _encode(args, spark)
    rows = cut_lineage(rows)
    held = cut_lineage(sampling.exact_sample(rows, args.held_rows, args.seed + sampling.REFERENCE_OFFSET, args.key))

    def space(folder):
        fitted = model.load(spark, folder)
        return latent.as_space(model.score(held, fitted, [args.key]), args.key)

    def run(parameters, folder):
        t = replace(_training(args), sample_rows=parameters["rows"], seed=parameters["seed"], epochs=parameters["epochs"])
        fitted = _fit(args, rows, kept, t)
        _save(args, spark, fitted, kept, stats, t, folder, [])
        own = space(folder)
        d = latent.width(own)
        largest = str(Path(args.output, evaluation.run_name({**parameters, "rows": max(args.rows)})))
        pairs = latent.paired(own if largest == folder else space(largest), own, args.key)
        return {**evaluation.bundle(pairs, args.key), "latent_collapse": latent.collapse_score(own, d).first()[0], "val_total_loss": fitted.history[fitted.best_epoch - 1]["val_total_loss"]}

    grid = [{"rows": r, "epochs": args.epochs, "seed": s} for s in args.seeds for r in sorted(args.rows, reverse=True)]
    evaluation.sweep(args.output, grid, run, not args.fresh, print)


def pipeline(args, spark) -> None:
    """From raw rows to latents: dedup, train, embed."""
    base = args.output
    dedup(argparse.Namespace(**{**vars(args), "output": f"{base}/deduplicated", "sample_rows": None}), spark)
    train(argparse.Namespace(**{**vars(args), "input": f"{base}/deduplicated", "output": f"{base}/model", "where": None}), spark)
    embed(argparse.Namespace(**{**vars(args), "input": f"{base}/deduplicated", "output": f"{base}/embedding", "model": f"{base}/model", "where": None}), spark)
    files.write_json({"input": args.input, "where": args.where, "seed": args.seed, "deduplicated": f"{base}/deduplicated", "model": f"{base}/model", "embedding": f"{base}/embedding"}, f"{base}/manifest.json")


def embed(args, spark) -> None:
    with open(f"{args.model}/report.json", encoding="utf-8") as f:
        report = json.load(f)
    kept = [encoding.Feature(x["name"], x["type"], x["values"]) for x in report["features"]]
    rows = spark.read.parquet(args.input)
    if args.where:
        rows = rows.where(F.expr(args.where))
    if not rows.head(1):
        raise SystemExit("no row passes the filter")
    fitted = model.load(spark, args.model)
    scored = model.score(encoding.encode(rows, kept, {k: tuple(v) for k, v in report["stats"].items()}), fitted, [args.key, *[c for c in ranked.LOCUS if c in rows.columns]])
    files.write_parquet(model.expand(scored, fitted.shape.latent), args.output, [args.key])


def cluster(args, spark) -> None:
    """Labels of all rows, and what describes them; a saved predictor labels new rows."""
    rows = spark.read.parquet(args.input)
    if args.where:
        rows = rows.where(F.expr(args.where))
    d = sum(c.startswith("latent_") for c in rows.columns)
    space = latent.wide_to_array(rows, args.key, "latent_")
    if args.predictor:
        with open(args.predictor, encoding="utf-8") as f:
            found = reduce.Reducer(**json.load(f))
    else:
        sample = sampling.exact_sample(space, args.fit_rows, args.seed, args.key)
        plane = reduce.fit_plane(sample, d)
        found = reduce.fit_centres(plane, plane.place(sample), args.clusters, args.seed, args.reach)
    labels = cut_lineage(found.apply(space).drop("v"))
    files.write_parquet(labels, f"{args.output}/labels")
    files.write_parquet(labelled.cluster_stats(labels), f"{args.output}/stats", files=1)
    if not args.predictor:
        files.write_json(asdict(found), f"{args.output}/predictor.json")
    if set(labelled.CONTEXT) <= set(rows.columns):
        counts = labelled.context_counts(labels.join(rows.select(args.key, *labelled.CONTEXT), args.key))
        named = labelled.annotated(counts, labelled.cluster_stats(labels))
        files.write_parquet(named, f"{args.output}/contexts", files=1)
        top = labelled.top_per_group(named.where("trinuc192 IS NOT NULL"), ["cluster_label"], [F.desc("n"), F.asc("trinuc192")], args.top_contexts)
        files.write_parquet(top, f"{args.output}/top_contexts", files=1)
        files.write_parquet(labelled.dense_matrix(labelled.spectrum(counts)), f"{args.output}/spectra", files=1)
    noise = labelled.noise_count(labels).first().asDict()
    parameters = {k: getattr(args, k) for k in ("input", "where", "key", "seed", "clusters", "reach", "fit_rows", "top_contexts", "predictor")}
    files.write_json({"parameters": parameters, "rows": labels.count(), **noise}, f"{args.output}/manifest.json")


def dedup(args, spark) -> None:
    rows = spark.read.parquet(args.input)
    if args.where:
        rows = rows.where(F.expr(args.where))
    best = ranked.best_per_locus(rows)
    if args.sample_rows:
        best = sampling.exact_sample(best, args.sample_rows, args.seed, *best.columns)
    files.write_parquet(best, args.output)


def combine(args, spark) -> None:
    print(files.combine(spark, args.input, args.output), "rows")


def vcf(args, spark) -> None:
    rows = exports.export_rows(spark.read.parquet(args.input), spark.read.parquet(args.labels), args.where, args.clusters or (), args.exclude_noise)
    if not rows.head(1):
        raise SystemExit("nothing to export")
    exports.write_vcf(rows, args.output, args.reference, date.today().strftime("%Y%m%d"))


def histogram(args, spark) -> None:
    rows = spark.read.parquet(args.input)
    if args.where:
        rows = rows.where(F.expr(args.where))
    window = histograms.Window(args.low, args.high, args.bins)
    files.write_parquet(histograms.dense(spark, histograms.histogram(rows, window), window), args.output, files=1)
    print(histograms.funnel(rows, window).first().asDict())


def inspect(args, spark) -> None:
    print(json.dumps(files.inspect(spark.read.parquet(args.input), args.where, args.rows), indent=2, default=str))


def compare(args, spark) -> None:
    results = files.read_results(spark, args.input)
    files.write_tsv(sweeps.group_stats(results, args.by, args.metric), args.output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(f, *, output: bool = True, several: bool = False, where: bool = True):
        p = commands.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        p.add_argument("--input", required=True, nargs="+" if several else None)
        if output:
            p.add_argument("--output", required=True)
        if where:
            p.add_argument("--where", help="a SQL condition")
        p.add_argument("--key", default="row_index")
        p.add_argument("--seed", type=int, default=42)
        return p

    def trains(f):
        p = command(f)
        p.add_argument("--features", required=True, help="JSON specification")
        for name, kind, default in (
            ("epochs", int, 10), ("batch-size", int, 4096), ("sample-rows", int, 200_000), ("train-fraction", float, 0.9), ("patience", int, 0), ("min-delta", float, 1e-3), ("input-dropout", float, 0.0),
            ("hidden-dropout", float, 0.0), ("data-seed", int, None), ("learning-rate", float, 1e-3), ("kl-weight", float, 0.05), ("latent", int, 16), ("tasks", int, 8),
        ):
            p.add_argument(f"--{name}", type=kind, default=default)
        p.add_argument("--hidden", type=int, nargs="+", default=[256, 128])
        p.add_argument("--mixed", action="store_true", help="single-precision passes")
        p.add_argument("--stream", action="store_true", help="train on all rows, in the cluster")
        return p

    for f in (train, pipeline):
        trains(f).add_argument("--convergence", type=int, default=0, help="rows on which each epoch is compared with the one before")
    p = trains(evaluate_subsamples)
    p.add_argument("--fractions", type=float, nargs="+", default=[1.0, 0.5, 0.25, 0.1])
    p.add_argument("--held-rows", type=int, default=10_000)
    p.add_argument("--clusters", type=int, default=0, help="compare labels by centroid too")
    p = trains(sweep)
    p.add_argument("--rows", type=int, nargs="+", required=True)
    p.add_argument("--seeds", type=int, nargs="+", default=[42])
    p.add_argument("--held-rows", type=int, default=10_000)
    p.add_argument("--fresh", action="store_true", help="run finished runs again")
    command(embed).add_argument("--model", required=True)
    p = command(cluster)
    p.add_argument("--clusters", type=int, default=20)
    p.add_argument("--reach", type=float, default=2.5)
    p.add_argument("--fit-rows", type=int, default=100_000, help="rows that fit the plane and the centres; all are labelled")
    p.add_argument("--top-contexts", type=int, default=6)
    p.add_argument("--predictor", help="label with a saved predictor.json")
    command(dedup).add_argument("--sample-rows", type=int)
    command(combine, several=True, where=False)
    p = command(vcf)
    p.add_argument("--labels", required=True)
    p.add_argument("--clusters", type=int, nargs="*")
    p.add_argument("--exclude-noise", action="store_true")
    p.add_argument("--reference", help="for the header")
    p = command(histogram)
    p.add_argument("--low", type=float, default=0.0)
    p.add_argument("--high", type=float, default=100.0)
    p.add_argument("--bins", type=int, default=20)
    command(inspect, output=False).add_argument("--rows", type=int, default=5)
    p = command(compare, where=False)
    p.add_argument("--by", nargs="+", default=["sample_rows"])
    p.add_argument("--metric", default="procrustes_disparity")
    args = parser.parse_args(argv)
    args.run(args, SparkSession.builder.getOrCreate())


if __name__ == "__main__":
    main()

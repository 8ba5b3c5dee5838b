import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases, contexts
from strandloom.functions import labels as words
from strandloom.operators import encoding, evaluation, exports, histograms, labelled, latent, model, quantiles, ranked, reduce, sampling, stream_training, sweeps, unions
from strandloom.operators.latest import latest
from strandloom.sources import files, tables

LOCUS = "chrom string, pos bigint, ref_base string, alt_base string"


def test_plain_spelling(spark):
    df = spark.createDataFrame([("chr1",), (" CHR1 ",), ("1",), (None,), ("",), ("Chrx",)], "c string")
    assert [r[0] for r in df.select(bases.plain(F.col("c"))).collect()] == ["1", "1", "1", None, "", "X"]


def test_latest_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (None, 1, "d"), (2, None, "e")], "k int, at int, v string")
    assert sorted(tuple(r) for r in latest(df, "k", "at", ["k", "at", "v"]).collect()) == [(1, 9, "c"), (2, None, "e")]
    assert latest(df.limit(0), "k", "at", ["k", "at", "v"]).count() == 0


def test_canonical_labels(spark):
    df = spark.createDataFrame([("G", "T", "A", "C"), ("C", "A", "G", "T"), ("N", "A", "A", "A"), (None, "A", "A", "A")], "r string, a string, p string, n string")
    got = df.select(contexts.labels(*[F.col(c) for c in "rapn"])["sbs96"].alias("x")).collect()
    assert [r[0] for r in got] == ["G[C>A]T", "G[C>A]T", None, None]
    assert len(set(contexts.sbs96_labels())) == 96


def test_last_bin_holds_the_upper_edge(spark):
    df = spark.createDataFrame([(40.0,), (64.9,), (65.0,), (41.25,)], "v double")
    assert [r[0] for r in df.select(contexts.bin_number(F.col("v"), 40.0, 65.0, 20)).collect()] == [0, 19, 19, 1]
    with pytest.raises(ValueError):
        contexts.bin_number(F.lit(1.0), 5.0, 5.0, 3)


def test_histogram_edges(spark):
    schema = "ref_base string, alt_base string, x_prev1 string, x_next1 string, snvq double"
    rows = [("C", "T", "A", "A", 10.0), ("C", "C", "A", "A", 10.0), ("C", "T", "N", "A", 10.0), (None, "T", "A", "A", 10.0), ("G", "A", "A", "A", float("nan")), ("G", "A", "A", "A", None)]
    df = spark.createDataFrame(rows, schema)
    assert histograms.funnel(df).first().asDict() == {"n_filtered": 6, "n_valid": 3, "n_canonical": 3, "n_window": 1, "least": 10.0, "most": 10.0}
    dense = histograms.dense(spark, histograms.histogram(df))
    assert dense.count() == 6 * 16 * 20 and dense.agg(F.sum("n")).first()[0] == 1


def test_ranked_dedup_leaves_unusable_values_last(spark):
    schema = f"{LOCUS}, snvq double, qual double, mapq int, dp int, row_index bigint"
    nan = float("nan")
    rows = [("1", 1, "A", "C", nan, 9.0, 60, 9, 1), ("1", 1, "A", "C", 5.0, 1.0, 255, 9, 2), ("1", 1, "A", "C", 5.0, 1.0, 60, -1, 3), ("1", 1, "A", "C", 5.0, 1.0, 60, 0, 4), ("2", 1, "A", "C", nan, nan, 255, -1, 5)]
    df = spark.createDataFrame(rows, schema)
    best = ranked.best_per_locus(df, output=["row_index", *ranked.LOCUS, "snvq"])
    assert sorted((r["row_index"], r["snvq"]) for r in best.collect()) == [(4, 5.0), (5, None)]
    assert ranked.group_maximum_mismatches(df, best, ranked.LOCUS, "snvq").first().asDict() == {"n_checked": 2, "n_mismatches": 0}


def test_ranked_dedup_ties_and_nulls(spark):
    schema = f"{LOCUS}, snvq double, qual double, row_index bigint"
    rows = [("1", 1, "A", "C", 5.0, None, 2), ("1", 1, "A", "C", 5.0, 1.0, 3), ("1", 1, "A", "C", 5.0, 1.0, 1), ("1", 1, None, "C", 5.0, 1.0, 4), ("1", 1, None, "C", 6.0, 1.0, 5)]
    df = spark.createDataFrame(rows, schema)
    best = ranked.best_per_locus(df, output=["row_index", *ranked.LOCUS, "snvq"])
    assert sorted(r["row_index"] for r in best.collect()) == [1, 5]
    assert ranked.uniqueness(best, ranked.LOCUS).first().asDict() == {"n_rows": 2, "n_keys": 2}
    again = ranked.best_per_locus(best, ranking=["snvq"], output=best.columns)
    assert sorted(again.collect()) == sorted(best.collect())
    assert ranked.best_per_locus(df.select("snvq")).count() == 5
    assert ranked.group_maximum_mismatches(df.where("ref_base = 'A'"), best.where("ref_base = 'A'"), ranked.LOCUS, "snvq").first()["n_mismatches"] == 0


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5_000)
    one = [r[0] for r in sampling.exact_sample(df.repartition(3), 100, 1, "id").collect()]
    assert one == [r[0] for r in sampling.exact_sample(df.coalesce(1), 100, 1, "id").collect()]
    assert len(set(one)) == 100
    assert sampling.exact_sample(df, 9_000, 1, "id").count() == 5_000
    assert one != [r[0] for r in sampling.exact_sample(df, 100, 2, "id").collect()]


def test_large_samples_need_no_order(spark, monkeypatch):
    df = spark.range(6_000).withColumn("p", F.lit(1))
    want = sorted(r[0] for r in sampling.exact_sample(df, 700, 1, "id").collect())
    monkeypatch.setattr(sampling, "ORDERED", 10)
    got = sampling.exact_sample(df.drop("p").repartition(3), 700, 1, "id")
    assert sorted(r[0] for r in got.collect()) == want
    twice = spark.range(1_000).union(spark.range(1_000))
    assert sampling.exact_sample(twice, 101, 1, "id").count() == 101


def test_splits(spark):
    assert [sampling.split_divisor(s) for s in (0.9, 0.8, 0.7, 0.1)] == [10, 5, 3, 2]
    split = sampling.ranked_split(spark.range(1_000), 0.9, 3, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 900, "val": 100}
    small = {r["split"]: r["count"] for r in sampling.ranked_split(spark.range(2), 0.99, 3, "id").groupBy("split").count().collect()}
    assert small == {"train": 1, "val": 1}


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 7 % 1_000,) for i in range(1_000)], "k int").repartition(5)
    assert all(r["k"] == r["dense_index"] for r in sampling.dense_index(df, "k").collect())


def test_ladder_is_nested(spark):
    steps = sampling.fraction_ladder(spark.range(500), [0.5, 1.0, 0.5], 100, 3, "id").groupBy("fraction").agg(F.collect_set("id").alias("s")).collect()
    by = {r["fraction"]: set(r["s"]) for r in steps}
    assert {k: len(v) for k, v in by.items()} == {0.5: 50, 1.0: 100} and by[0.5] < by[1.0]


def test_encoding_edges(spark):
    f = encoding.Feature("c", "c", {"x": 3, "y": 4})
    g = encoding.Feature("c", "c", {"x": 3, "": 4})
    df = spark.createDataFrame([("x",), (None,), ("?",), ("y",), ("",)], "c string")
    assert [tuple(r) for r in df.select(encoding.category_code(F.col("c"), f), encoding.category_code(F.col("c"), g)).collect()] == [(3, 3), (3, 4), (3, 4), (4, 4), (3, 4)]
    assert [encoding.Feature("c", "c", {str(i): i for i in range(n)}).embedding_width for n in (5, 8, 16)] == [6, 6, 8]
    n = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    stats = encoding.sample_stats(n, ["v"]).first()
    assert (stats["mean"], round(stats["std"], 6)) == (2.0, round(math.sqrt(2), 6))
    assert [r[0] for r in n.select(encoding.standardised(F.col("v"), 2.0, 1.0)).collect()] == [-1.0, 0.0, 0.0, 1.0]
    constant = encoding.sample_stats(spark.createDataFrame([(5.0,)], "v double"), ["v"]).first()
    assert constant["std"] == 1.0
    with pytest.raises(ValueError):
        encoding.kept_features(spark.createDataFrame([(None,)], "v double"), [encoding.Feature("v", "float")])


def test_labels_and_overlay(spark):
    label = spark.createDataFrame([(-1,), (0,), (3,), (None,)], "l int")
    got = lambda **k: [r[0] for r in label.where(labelled.cluster_predicate(F.col("l"), **k)).collect()]
    assert got() == [-1, 0, 3] and got(without_noise=True) == [0, 3] and got(only=(-1,), without_noise=True) == [-1]
    schema = "row_index int, cluster_label int, cluster_probability float"
    over = labelled.overlay(spark.createDataFrame([(1, 5, 0.5), (2, 6, 0.5)], schema), spark.createDataFrame([(2, -1, 0.0)], schema), ["row_index"])
    assert {r["row_index"]: r["cluster_label"] for r in over.collect()} == {1: 5, 2: -1}
    tied = labelled.dominant(spark.createDataFrame([(2, 2, 0), (0, 0, 0), (None, 1, 3)], "a int, b int, c int"), ["a", "b", "c"]).collect()
    assert [(r["dominant"], r["dominant_fraction"]) for r in tied] == [("a", 0.5), ("a", 0.0), ("c", 0.75)]
    assert labelled.join_keys(["row_index"], ["row_index"]) == ["row_index"]
    with pytest.raises(ValueError):
        labelled.join_keys(["a"], ["b"])


def test_unions(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y",)], "s string")
    for n, df in (("a", a), ("b", b)):
        df.write.parquet(f"{tmp_path}/{n}")
    assert files.combine(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/c") == 2
    with pytest.raises(ValueError):
        unions.check_conserved([a, b], a)
    assert unions.once(["a", "b", "a"]) == ["a", "b"]
    assert b.select(unions.or_null(b, "i", "bigint")).first()[0] is None


def test_predicate_is_one_expression(spark):
    with pytest.raises(Exception):
        tables.scan(spark.range(3), predicate="1 = 1; DROP TABLE x").collect()
    odd = spark.createDataFrame([(1,)], ["a`b c"])
    assert tables.scan(odd, ["a`b c"]).count() == 1


def space(spark, m):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(m)), "v": [list(map(float, r)) for r in m]}))


def test_latent_invariances(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    same = latent.paired(space(spark, x), space(spark, 3 * x @ turn + 2), "id")
    other = latent.paired(space(spark, x), space(spark, rng.normal(size=(60, 4))), "id")
    assert latent.procrustes(same) < 1e-9 and abs(latent.linear_cka(same) - 1) < 1e-9
    assert latent.procrustes(other) > 0.5 and latent.linear_cka(other) < 0.5
    assert latent.knn_jaccard(same, "id", 5).first()[0] == 1.0
    assert latent.trustworthiness(same, "id", 5).first()[0] == 1.0
    t, c = latent.trustworthiness(other, "id", 5).first()[0], latent.trustworthiness(other, "id", 5, True).first()[0]
    assert 0 < t < 1 and 0 < c < 1
    fewer = latent.paired(space(spark, x), space(spark, x[:30]), "id")
    assert fewer.count() == 30


def test_exact_sample_of_a_shared_key(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, F.col("id")).otherwise(-1).alias("k"))  # -1 for a third
    lead = spark.createDataFrame([(-1,)], "k bigint")
    seed = next(s for s in range(50) if lead.select(sampling.sample_key(s, "k")).first()[0] > "f")
    for n in (100, 2_000, 2_500, 2_999):
        assert sampling.exact_sample(rows, n, seed, "k").count() == n


def test_matrix_of_all_clusters(spark, tmp_path):
    from strandloom.plans import records

    rows = [(c, "C", "T", "A", "A") for c in (0, 6, 6, 240)] + [(7, "N", "T", "A", "A"), (-1, "C", "T", "A", "A"), (None, "C", "T", "A", "A")]
    spark.createDataFrame(rows, "cluster_label int, ref_base string, alt_base string, x_prev1 string, x_next1 string").write.parquet(f"{tmp_path}/analysis.parquet")
    got = records.sbs96_matrix(spark, str(tmp_path)).collect()
    assert len(got) == 3 * 96 and {r["sbs96"]: r["place"] for r in got} == {x: i for i, x in enumerate(contexts.sbs96_labels())}
    assert {(r["cluster_label"], r["sbs96"]): r["n"] for r in got if r["n"]} == {(0, "A[C>T]A"): 1, (6, "A[C>T]A"): 2, (240, "A[C>T]A"): 1}


def test_all_latent_dimensions(spark, tmp_path):
    from strandloom.plans import records

    m = np.random.default_rng(5).normal(size=(200, 16))
    m[:, 12] = 3.0
    pd.DataFrame({"row_index": np.arange(200), **{f"latent_{i}": m[:, i] for i in range(16)}}).to_parquet(f"{tmp_path}/embedding.parquet")
    folder = str(tmp_path)
    got = {r["dim"]: r for r in records.latent_moments(spark, folder).collect()}
    assert sorted(got) == list(range(16)) and all(abs(got[i]["mean"] - m[:, i].mean()) < 1e-5 and abs(got[i]["var"] - m[:, i].var()) < 1e-5 for i in got)
    assert records.latent_active_units(spark, folder).first().asDict() == {"active_units": 15, "n_rows": 200}
    assert abs(records.collapse_score(spark, folder).first()[0] - m.std(0).mean()) < 1e-5
    assert records.collapse_diagnosis(spark, folder).first().asDict() == {"active_percent": 93.75, "n_collapsed": 1, "collapsed": "12"}


def test_neighbours_of_all_rows(spark, monkeypatch, tmp_path):
    from strandloom.plans import records

    rng = np.random.default_rng(4)
    m = rng.integers(0, 4, (300, 64)).astype("float32")  # many ties
    folder = str(tmp_path)
    pd.DataFrame({"vec_id": np.arange(300) * 3, "embedding": list(m), "label": 0}).to_parquet(f"{folder}/embeddings.parquet")
    monkeypatch.setattr(sampling, "METRIC_ROWS", 100)
    monkeypatch.setattr(latent, "METRIC_ROWS", 100)
    monkeypatch.setattr(latent.metric_rows, "__defaults__", (100, 0))
    monkeypatch.setattr(latent, "BLOCK", 70)

    def near(a):
        d = ((a[:, None] - a[None]) ** 2).sum(2)
        np.fill_diagonal(d, -1)
        return np.argsort(d, axis=1, kind="stable")[:, 1:11]

    x, y = near(m[:, :16].astype(float)), near(m[:, 16:].astype(float))
    got = {(r["id"], r["place"]): r["neighbour"] for r in records.knn_topk(spark, folder).collect()}
    assert got == {(3 * i, k + 1): 3 * x[i, k] for i in range(300) for k in range(10)}
    shared = [len(set(a) & set(b)) for a, b in zip(x, y)]
    assert abs(records.knn_jaccard10(spark, folder).first()[0] - np.mean([c / (20 - c) for c in shared])) < 1e-6
    assert records.trustworthiness(spark, folder).count() == 1  # on a metric sample still


def test_collapse(spark):
    m = np.column_stack([np.random.default_rng(1).normal(size=200), np.full(200, 0.0)])
    assert latent.collapse_diagnosis(space(spark, m), 2).first().asDict() == {"active_percent": 50.0, "n_collapsed": 1, "collapsed": "1"}


def test_label_agreement(spark):
    df = spark.createDataFrame([(0, 5, 1), (0, 5, 1), (1, 7, 1), (1, 7, 1), (None, 7, 1)], "a int, b int, c int")
    assert tuple(round(v, 9) for v in latent.label_agreement(df, "a", "b").first()) == (1.0, 1.0)
    assert latent.label_agreement(df, "c", "c").first()["nmi"] == 1.0
    assert abs(latent.label_agreement(df, "a", "c").first()["ari"]) < 1e-9


def test_sweep_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), ("c", None), ("d", 1.0), ("d", -1.0)], "g string, v double")
    got = {r["g"]: r for r in sweeps.group_stats(df, ["g"], "v").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["cv_percent"]) == (2, 2.0, 50.0)
    assert got["b"]["cv_percent"] is None and got["c"]["n"] == 0 and got["d"]["cv_percent"] is None
    verdicts = spark.createDataFrame([(1.0,), (0.96,), (0.5,), (None,)], "v double").select(sweeps.verdict(F.col("v"), F.lit(0.94), True)).collect()
    assert [r[0] for r in verdicts] == ["BETTER", "similar", "WORSE", None]
    labels = spark.createDataFrame([(0.025,), (0.02,), (1.0,), (0.005,)], "f double").select(sweeps.percent_label(F.col("f"))).collect()
    assert [r[0] for r in labels] == ["2.5pct", "2pct", "100pct", "0.5pct"]


def test_stagnation(spark):
    rows = [(1, 1, 1.0, 4), (1, 2, 0.999, 4), (1, 3, 0.9985, 4), (1, 4, 0.99, 5), (1, 5, 0.5, 5), (1, 6, 0.5, 5), (1, 7, 0.5, 6)]
    df = spark.createDataFrame(rows, "run int, epoch int, loss double, units int")
    got = [r["stagnant"] for r in sweeps.stagnation(df, "run", "epoch", "loss", "units", 0.01).orderBy("epoch").collect()]
    assert got == [0, 1, 2, 0, 0, 1, 0]
    assert sweeps.best_epoch(df, "run", "epoch", "loss").first()["best_epoch"] == 5
    empty = spark.createDataFrame([([],), ([1, 2],)], "h array<int>")
    assert [r["last"] for r in sweeps.last_of_history(empty, "h").collect()] == [None, 2]


def test_vcf_text(spark):
    schema = f"{LOCUS}, qual double, filt int, cluster_label int, cluster_probability float, umap_1 float, umap_2 float"
    some = lambda filt: ("1", 7, "A", "C", 0.1234567, filt, 3, 0.25, -1.5, 1e-7)
    rows = spark.createDataFrame([some(1), some(0), some(None), (None, None, None, None, float("nan"), None, None, None, None, None)], schema)
    lines = sorted(r["line"] for r in exports.vcf_lines(rows).collect())
    head, info = "1\t7\t.\tA\tC\t0.123457", "CLUSTER=3;CLPROB=0.25;UMAP1=-1.5;UMAP2=1e-07"
    assert lines == sorted([".\t.\t.\t.\t.\t.\tPASS\t.", f"{head}\tPASS\t{info};SRC_FILT=1", f"{head}\t.\t{info};SRC_FILT=0", f"{head}\tPASS\t{info}"])
    header = exports.vcf_header("ref.fa", "20260101")
    assert header[:3] == ["##fileformat=VCFv4.3", "##fileDate=20260101", "##source=strandloom"] and header[-2:] == ["##reference=ref.fa", exports.HEADER_COLUMNS]
    assert any(h.startswith("##FILTER=<ID=PASS,") for h in header) and sum(h.startswith("##INFO") for h in header) == 5


def test_vcf_without_optional_columns(spark):
    source = spark.createDataFrame([(1, "2", 5, "G", "T")], f"row_index bigint, {LOCUS}")
    labels = spark.createDataFrame([(1, 4)], "row_index bigint, cluster_label int")
    assert [r["line"] for r in exports.vcf_lines(exports.export_rows(source, labels)).collect()] == ["2\t5\t.\tG\tT\t.\tPASS\tCLUSTER=4"]


def test_exact_quantiles_of_hot_groups(spark):
    rng = np.random.default_rng(3)
    data = [(("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 20}"), float(np.round(rng.normal(), 2))) for i in range(4_000)] + [("hot", None), ("none", None)]
    shares = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in quantiles.exact(spark.createDataFrame(data, "g string, v double"), ["g"], F.col("v"), shares).collect()}
    assert set(got) == {g for g, v in data if v is not None}
    for g, row in got.items():
        assert np.allclose(row, np.quantile([v for h, v in data if h == g and v is not None], list(shares.values())))
    assert quantiles.exact(spark.createDataFrame([], "g string, v double"), ["g"], F.col("v"), shares).count() == 0


def test_similarity_of_spectra(spark):
    spectra = spark.createDataFrame([(1, "x", 3), (1, "y", 4), (2, "x", 1), (3, "z", 5)], "cluster_label int, sbs96 string, n bigint")
    signature = spark.createDataFrame([("x", 3), ("y", 4)], "sbs96 string, n bigint")
    assert [(r["cluster_label"], round(r["similarity"], 6)) for r in labelled.similarities(spectra, signature).collect()] == [(1, 1.0), (2, 0.6), (3, 0.0)]


def small_shape():
    return model.Shape((3, 4), (2, 2), 3, (5, 4), 2)


def random_rows(n, shape, seed=0):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.integers(0, c, n) for c in shape.categories]), rng.normal(size=(n, shape.numerics)), (rng.random((n, shape.numerics)) > 0.2).astype(float)


def test_gradient_by_differences():
    shape = small_shape()
    w = model.initial_weights(shape, 1)
    data, rng = random_rows(12, shape), np.random.default_rng(2)
    noise = rng.normal(size=(12, 2))
    drops = [(rng.random((12, s)) > 0.3) / 0.7 for s in (7, 5, 4)]
    _, g = model.loss_and_gradient(w, shape, *data, 0.3, noise, drops)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        ends = []
        for step in (1e-6, -1e-6):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            ends.append(model.loss_and_gradient(moved, shape, *data, 0.3, noise, drops, gradient=False)[0]["total_loss"])
        assert abs((ends[0] - ends[1]) / 2e-6 - g[name][at]) < 1e-5


def test_fit_learns_and_stops_early():
    shape = small_shape()
    train, val = random_rows(400, shape), random_rows(80, shape, 1)
    fitted = model.fit(shape, train, val, model.Training(epochs=15, batch_size=64, learning_rate=5e-3))
    losses = [h["train_total_loss"] for h in fitted.history]
    assert losses[-1] < losses[0]
    again = model.fit(shape, train, val, model.Training(epochs=15, batch_size=64, learning_rate=5e-3))
    assert again.history == fitted.history
    stopped = model.fit(shape, train, val, model.Training(epochs=50, batch_size=64, learning_rate=1e-9, patience=2))
    assert len(stopped.history) < 50


def test_mixed_precision_is_close():
    shape = small_shape()
    train, val = random_rows(300, shape), random_rows(60, shape, 1)
    full, mixed = (model.fit(shape, train, val, model.Training(epochs=4, batch_size=64, mixed=m, hidden_dropout=0.2)) for m in (False, True))
    assert mixed.weights["mu_w"].dtype == np.float64
    assert np.allclose([h["val_total_loss"] for h in full.history], [h["val_total_loss"] for h in mixed.history], rtol=1e-3)


def test_scores_and_saved_model(spark, tmp_path):
    shape = small_shape()
    cat, num, mask = random_rows(50, shape)
    fitted = model.fit(shape, (cat, num, mask), (cat, num, mask), model.Training(epochs=2, batch_size=16))
    df = spark.createDataFrame(pd.DataFrame({"k": range(50), "cat": cat.tolist(), "num": num.tolist(), "mask": mask.tolist()}))
    one = {r["k"]: tuple(r["latent"]) for r in model.score(df.repartition(4), fitted, ["k"]).collect()}
    model.save(spark, fitted, str(tmp_path / "m"))
    back = model.load(spark, str(tmp_path / "m"))
    two = {r["k"]: tuple(r["latent"]) for r in model.score(df.coalesce(1), back, ["k"]).collect()}
    assert one == two and back.history == fitted.history
    assert model.expand(model.score(df, fitted, ["k"]), 2).columns == ["k", "latent_0", "latent_1"]


def frame_of(spark, shape, n, seed=0):
    cat, num, mask = random_rows(n, shape, seed)
    return spark.createDataFrame(pd.DataFrame({"k": range(n), "cat": cat.tolist(), "num": num.tolist(), "mask": mask.tolist()}))


def test_training_over_rows_that_stay_in_the_cluster(spark):
    shape, seen = small_shape(), []
    train, val = frame_of(spark, shape, 600), frame_of(spark, shape, 90, 1)
    t = model.Training(epochs=4, batch_size=50, learning_rate=5e-3, input_dropout=0.1, hidden_dropout=0.2)
    fitted = stream_training.fit_stream(train, val, shape, t, "k", 3, lambda epoch, now, row: seen.append((epoch, now.weights["mu_w"].sum())))
    assert [h["epoch"] for h in fitted.history] == [1, 2, 3, 4] and fitted.history[-1]["val_total_loss"] < fitted.history[0]["val_total_loss"]
    assert [e for e, _ in seen] == [1, 2, 3, 4] and len({w for _, w in seen}) == 4
    again = stream_training.fit_stream(train.repartition(7), val.coalesce(1), shape, t, "k", 3)
    assert np.allclose([h["train_total_loss"] for h in again.history], [h["train_total_loss"] for h in fitted.history])
    one = stream_training.fit_stream(train, val, shape, model.Training(epochs=1, batch_size=1_000, learning_rate=5e-3), "k", 1)
    alone = model.AdamW(model.initial_weights(shape, 42), model.Training(learning_rate=5e-3))
    ordered = train.orderBy(sampling.sample_key(43, "k")).toPandas()
    losses = model.batch_step(alone, shape, model.arrays(ordered), np.random.default_rng([42, 1, 0, 0]))
    assert abs(losses["total_loss"] - one.history[0]["train_total_loss"]) < 1e-9 and np.allclose(alone.w["mu_w"], one.weights["mu_w"])
    for a, b in ((train.limit(0), val), (train, val.limit(0))):
        with pytest.raises(ValueError):
            stream_training.fit_stream(a, b, shape, t, "k", 2)


def test_diagnostics_and_refused_rows(spark, monkeypatch):
    shape = small_shape()
    train, val = random_rows(200, shape), random_rows(50, shape, 1)
    t = model.Training(epochs=30, batch_size=64, learning_rate=1e-9, patience=2)
    report = model.diagnostics_report(model.fit(shape, train, val, t), t)
    assert report["stopped_early"] and report["epochs_run"] < 30 and len(report["changes"]) == report["epochs_run"] - 1 and report["active_units"] + report["collapsed_units"] == 2
    monkeypatch.setattr(model, "DRIVER_ROWS", 40)
    with pytest.raises(ValueError):
        model.matrices(frame_of(spark, shape, 41))


def test_progress_and_growing_table(spark, tmp_path):
    shape, seen, parts = small_shape(), [], []
    fitted = model.Fitted(model.initial_weights(shape, 0), shape)
    with model.Progress(spark, lambda rows, batches: seen.append((rows, batches)), 0.05) as progress:
        model.score(frame_of(spark, shape, 120).repartition(4), fitted, ["k"], progress).write.format("noop").mode("overwrite").save()
    assert seen[-1][0] == 120 and seen[-1][1] >= 4
    path = str(tmp_path / "grown")
    assert files.write_in_parts(spark.range(500), path, "id", 3, lambda rows, part: parts.append((rows, part))) == 500
    assert spark.read.parquet(path).count() == 500 and [p for _, p in parts] == [1, 2, 3] and parts[-1][0] == 500


def test_subsamples_against_the_largest(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "k bigint, x array<double>")
    asked = []

    def trainer(sample, random_seed):
        asked.append((sample.count(), random_seed))
        factor = float(sample.count())
        return None, lambda df: df.select("k", F.transform("x", lambda c: c * factor).alias("v")), {"val_total_loss": factor}

    label = lambda space: space.select("k", (F.col("v")[0] > 0).cast("int").alias("label"))
    table = evaluation.evaluate_subsamples(rows, rows, [80, 40, 20], trainer, "k", 7, label)
    assert asked == [(80, 7), (40, 7), (20, 7)] and [r["sample_rows"] for r in table] == [80, 40, 20] and [r["fraction"] for r in table] == [1.0, 0.5, 0.25]
    assert all(abs(r["procrustes"]) < 1e-9 and abs(r["linear_cka"] - 1) < 1e-9 and r["ari"] == r["nmi"] == 1.0 and r["val_total_loss"] == r["sample_rows"] for r in table)
    assert math.isnan(evaluation.evaluate_subsamples(rows, rows, [80], trainer, "k")[0]["ari"])


def test_sweep_goes_on_where_it_ended(tmp_path):
    grid, ran = [{"rows": r, "seed": s} for s in (1, 2) for r in (100, 50)], []

    def run(parameters, folder):
        if len(ran) == 2 and parameters["rows"] == 100 and "broken" not in told:
            told.append("broken")
            raise RuntimeError("out of time")
        ran.append(parameters)
        return {"loss": 1.0 / parameters["rows"]}

    told = []
    with pytest.raises(RuntimeError):
        evaluation.sweep(str(tmp_path), grid, run)
    assert len(ran) == 2
    (tmp_path / "rows_50_seed_1" / "result.json").write_text("{ cut off")
    results = evaluation.sweep(str(tmp_path), grid, run, tell=told.append)
    assert [(r["rows"], r["seed"], r["loss"]) for r in results] == [(100, 1, 0.01), (50, 1, 0.02), (100, 2, 0.01), (50, 2, 0.02)]
    assert told[1:] == ["rows_100_seed_1: kept", "rows_50_seed_1: run", "rows_100_seed_2: run", "rows_50_seed_2: run"]
    assert len(evaluation.sweep(str(tmp_path), grid, run, resume=False)) == 4 and len(ran) == 9


def test_substitutes(spark):
    rng = np.random.default_rng(0)
    m = np.vstack([rng.normal(size=(50, 3)) * 0.1, rng.normal(size=(50, 3)) * 0.1 + 5, [[2.5, 2.5, 40.0]]])
    out = reduce.label_by_centroid(reduce.principal_plane(space(spark, m), 3), 2, 1, 3.0)
    assert out.where("cluster_label >= 0").count() >= 98
    x = reduce.signature_fit(np.array([10.0, 0, 30]), np.array([[1.0, 0], [0, 0], [0, 1]]))
    assert np.allclose(x, [10, 30], atol=1e-6)


def test_streams(spark, tmp_path):
    from strandloom.streaming import scoring

    shape = model.Shape((), (), 1, (4,), 2)
    features, stats = [encoding.Feature("v", "float")], {"v": (0.0, 1.0)}
    fitted = model.Fitted(model.initial_weights(shape, 0), shape)
    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "k bigint, v double")
    source = str(tmp_path / "in")
    for expected in (20, 40):
        rows.write.mode("append").parquet(source)
        q = scoring.score_new_files(spark, source, rows.schema, features, stats, fitted, ["k"], str(tmp_path / "out"), str(tmp_path / "at"))
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected


def test_tsv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "s string, v double")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(files.read_tsv(spark, str(tmp_path / "t"), "s string, v double").collect()) == sorted(df.collect())
    place = tmp_path / "rows_500_epochs_3" / "r.json"
    place.parent.mkdir()
    files.write_json([{"b": 1, "a": 2}], str(place))
    row = files.read_results(spark, str(place)).first()
    assert (row["path_rows"], row["path_epochs"], row["path_seed"]) == (500, 3, None)
    assert files.find_run("/old/rows_500_epochs_3/r.json", [str(tmp_path)]) == str(place)
    assert files.find_run("/old/none", [str(tmp_path)]) is None


def test_stagnation_over_a_stream(spark, tmp_path):
    from strandloom.streaming import scoring

    schema = "run bigint, epoch int, loss double, units int"
    rows = [(1, 1, 1.0, 4), (1, 2, 0.999, 4), (1, 3, 0.9985, 4), (1, 4, 0.5, 4), (2, 1, 1.0, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = scoring.stagnation_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "h")), 0.01)
    q = stream.writeStream.format("memory").queryName("stagnation").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("stagnation").collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 0), (2, 1, 0)]


def test_command_line(spark, tmp_path, capsys):
    import json

    from strandloom import __main__ as cli

    rows = spark.range(300).select(
        F.col("id").alias("row_index"), F.lit("1").alias("chrom"), (F.col("id") % 200).alias("pos"), F.lit("C").alias("ref_base"), F.lit("T").alias("alt_base"), F.lit("A").alias("x_prev1"), F.lit("G").alias("x_next1"),
        (F.col("id") % 50).cast("double").alias("snvq"), (F.col("id") % 7).cast("double").alias("rq"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("tag"), F.lit(1).alias("filt"),
    )
    at = lambda name: str(tmp_path / name)
    rows.write.parquet(at("in"))
    (tmp_path / "spec.json").write_text(json.dumps({"features": [{"name": "rq", "type": "float"}, {"name": "tag", "type": "c", "values": {"x": 0, "y": 1}}, {"name": "snvq", "type": "float"}]}))
    cli.main(["train", "--input", at("in"), "--output", at("model"), "--features", at("spec.json"), "--epochs", "2"])
    cli.main(["embed", "--input", at("in"), "--output", at("emb"), "--model", at("model")])
    assert spark.read.parquet(at("emb")).count() == 300
    more = ["--input", at("in"), "--features", at("spec.json"), "--epochs", "2", "--hidden", "8", "4", "--latent", "2"]
    cli.main(["train", *more, "--output", at("streamed"), "--stream", "--tasks", "2", "--convergence", "60", "--input-dropout", "0.1"])
    assert len(json.loads((tmp_path / "streamed" / "report.json").read_text())["convergence"]) == 1 and json.loads((tmp_path / "streamed" / "diagnostics_report.json").read_text())["epochs_run"] == 2
    cli.main(["evaluate-subsamples", *more, "--output", at("evaluated"), "--sample-rows", "200", "--fractions", "1", "0.5", "--held-rows", "60", "--clusters", "2"])
    assert spark.read.csv(at("evaluated"), sep="\t", header=True).count() == 2
    for _ in range(2):
        cli.main(["sweep", *more, "--output", at("swept"), "--rows", "100", "200", "--held-rows", "60"])
    assert [r["rows"] for r in json.loads((tmp_path / "swept" / "sweep_results.json").read_text())] == [200, 100]
    cli.main(["pipeline", *more, "--output", at("piped")])
    assert spark.read.parquet(at("piped") + "/embedding").count() == 200
    cli.main(["cluster", "--input", at("emb"), "--output", at("clu"), "--clusters", "2"])
    cli.main(["cluster", "--input", at("emb"), "--output", at("again"), "--predictor", at("clu") + "/predictor.json"])
    assert sorted(spark.read.parquet(at("again") + "/labels").collect()) == sorted(spark.read.parquet(at("clu") + "/labels").collect())
    cli.main(["vcf", "--input", at("in"), "--labels", at("clu") + "/labels", "--output", at("vcf")])
    text = [r[0] for r in spark.read.text(at("vcf")).collect()]
    assert text.count("##fileformat=VCFv4.3") == 1 and sum(not t.startswith("#") for t in text) == 300
    cli.main(["dedup", "--input", at("in"), "--output", at("ded")])
    assert spark.read.parquet(at("ded")).count() == 200
    cli.main(["combine", "--input", at("ded"), at("in"), "--output", at("all")])
    cli.main(["histogram", "--input", at("in"), "--output", at("his")])
    cli.main(["inspect", "--input", at("in"), "--where", "snvq > 40"])
    assert "500 rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["embed", "--input", at("in"), "--output", at("emb"), "--model", at("model"), "--where", "snvq > 1000"])


def test_batches(spark):
    frames = list(files.batches(spark.range(250), ["id"], "id < 230", 100))
    assert [len(f) for f in frames] == [100, 100, 30]
    with pytest.raises(ValueError):
        next(files.batches(spark.range(1), ["nothing"]))


def test_words():
    assert [words.duration(s) for s in (5, 65, 3_723)] == ["5s", "1m 05s", "1h 02m 03s"]
    assert [words.size_label(n) for n in (999, 250_000, 2_500_000)] == ["999", "250k", "2.5M"]
    assert words.split_list(" a, b,,a ") == ["a", "b"] and words.split_numbers("3,1,3") == [3, 1]
    assert len(set(words.palette(20))) == 20

"""Queries over sweeps, training histories and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sweeps
from ..sources.tables import table
from .registry import observations, observations_sql, query

METRICS = ["procrustes_disparity", "linear_cka", "latent_collapse", "trustworthiness", "val_total_loss"]


def sweep(spark, folder):
    return table(spark, folder, "sweep_results")


def _ok(c):
    return f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN {c} END"


def _stats_sql(groups, metric):
    return f"""SELECT {groups}, n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN n >= 2 AND abs(mean) > 1e-12 THEN 100 * std / mean END, 5) AS cv_percent, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75
        FROM (SELECT {groups}, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75
              FROM (SELECT *, {_ok(metric)} AS v FROM sweep_results) GROUP BY {groups})"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "median", "p75")}).withColumn("cv_percent", F.round("cv_percent", 5))


@query(_stats_sql("sample_rows, epochs", "procrustes_disparity"))
def seed_group_stats(spark, folder):
    """AGG-19, FLT-11/12, AGG-22."""
    return _rounded(sweeps.group_stats(sweep(spark, folder), ["sample_rows", "epochs"], "procrustes_disparity"))


@query(_stats_sql("data_seed", "linear_cka"))
def seed_cv(spark, folder):
    """AGG-19, AGG-22: runs without a seed form a group of their own."""
    return _rounded(sweeps.group_stats(sweep(spark, folder), ["data_seed"], "linear_cka"))


@query(f"""SELECT sample_rows, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM (
    SELECT sample_rows, {_ok("procrustes_disparity")} AS v FROM sweep_results WHERE rq_threshold IS NULL UNION ALL SELECT sample_rows, {_ok("procrustes_disparity")} FROM sweep_results WHERE rq_threshold IS NOT NULL AND fraction = 1.0) GROUP BY sample_rows""")
def rand_baseline(spark, folder):
    """AGG-20, SET-02."""
    rows = sweep(spark, folder)
    both = rows.where("rq_threshold IS NULL").unionByName(rows.where("rq_threshold IS NOT NULL AND fraction = 1.0"))
    v = sweeps.usable("procrustes_disparity")
    return both.groupBy("sample_rows").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.count(v).alias("n"))


@query(f"SELECT sample_rows, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS spread, count(v) AS n FROM (SELECT sample_rows, {_ok('trustworthiness')} AS v FROM sweep_results) GROUP BY sample_rows ORDER BY sample_rows")
def spread_by_rows(spark, folder):
    """AGG-21, TOP-08."""
    rows = sweeps.spread(sweep(spark, folder), ["sample_rows"], "trustworthiness").withColumns({c: F.round(c, 6) for c in ("least", "most", "spread")})
    return rows.orderBy("sample_rows")


_BASE = "(SELECT avg(v) FROM (SELECT " + _ok("{m}") + " AS v FROM sweep_results WHERE rq_threshold IS NULL))"


def _verdict_sql(metric, better):
    delta = f"round(v - b, 9)" if better else "round(b - v, 9)"
    return f"CASE WHEN v IS NULL OR b IS NULL THEN NULL WHEN abs({delta}) <= 0.05 THEN 'similar' WHEN {delta} > 0 THEN 'BETTER' ELSE 'WORSE' END"


@query(f"""SELECT run_id, sample_rows, rq_threshold, verdict, count(*) AS n FROM (SELECT run_id, sample_rows, rq_threshold, {_verdict_sql('linear_cka', True)} AS verdict
    FROM (SELECT *, {_ok('linear_cka')} AS v, {_BASE.format(m='linear_cka')} AS b FROM sweep_results)) GROUP BY ALL""")
def verdict_vs_baseline(spark, folder):
    """FN-08."""
    rows = sweep(spark, folder)
    base = rows.where("rq_threshold IS NULL").agg(F.avg(sweeps.usable("linear_cka")).alias("b"))
    judged = rows.crossJoin(base)  # one row
    delta = F.round(sweeps.usable("linear_cka") - F.col("b"), 9)
    verdict = sweeps.verdict(delta, F.lit(0.0), True)
    return judged.select("run_id", "sample_rows", "rq_threshold", verdict.alias("verdict")).groupBy("run_id", "sample_rows", "rq_threshold", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sample_rows, run_dir, n_rows FROM sweep_results ORDER BY sample_rows DESC NULLS LAST, run_dir NULLS LAST LIMIT 1")
def reference_max_by(spark, folder):
    """AGG-24, WIN-08."""
    return sweeps.reference_row(sweep(spark, folder), "sample_rows", ["n_rows"], "run_dir")


@query(f"""SELECT run_id, sample_rows, run_dir, first_value(run_dir) OVER (PARTITION BY run_id ORDER BY sample_rows DESC NULLS LAST, run_dir NULLS LAST) AS reference_dir FROM sweep_results""")
def reference_first(spark, folder):
    """WIN-08: the first entry by size is its run's reference."""
    order = Window.partitionBy("run_id").orderBy(F.col("sample_rows").desc_nulls_last(), F.col("run_dir").asc_nulls_last())
    return sweep(spark, folder).select("run_id", "sample_rows", "run_dir", F.first("run_dir").over(order).alias("reference_dir"))


@query(r"""SELECT run_dir, CAST(nullif(regexp_extract(run_dir, 'rows_(\d+)', 1), '') AS BIGINT) AS path_rows, CAST(nullif(regexp_extract(run_dir, 'epochs_(\d+)', 1), '') AS BIGINT) AS path_epochs,
    CAST(nullif(regexp_extract(run_dir, '(?:data)?seed_?(\d+)', 1), '') AS BIGINT) AS path_seed FROM sweep_results""")
def param_from_path(spark, folder):
    """SRC-10."""
    return sweep(spark, folder).select("run_dir", *[c.alias(n) for n, c in sweeps.params_of_path(F.col("run_dir")).items()])


@query("SELECT DISTINCT fraction, regexp_replace(printf('%.4f', fraction * 100), '\\.?0+$', '') || 'pct' AS label FROM sweep_results WHERE fraction IS NOT NULL")
def fraction_labels(spark, folder):
    """FN-09: exact, so that no two fractions share a label."""
    return sweep(spark, folder).where("fraction IS NOT NULL").select("fraction", sweeps.percent_label(F.col("fraction")).alias("label")).distinct()


@query(f"""WITH r AS (SELECT sample_rows, avg(v) AS v FROM (SELECT sample_rows, {_ok("linear_cka")} AS v FROM sweep_results) WHERE v IS NOT NULL GROUP BY sample_rows), f AS (SELECT arg_max(v, sample_rows) AS reference FROM r)
    SELECT min(sample_rows) FILTER (WHERE abs(v - reference) <= 0.05) AS elbow, round(max(reference), 6) AS reference FROM r, f""")
def elbow(spark, folder):
    """WIN-07."""
    return sweeps.elbow(sweep(spark, folder), "sample_rows", "linear_cka").withColumn("reference", F.round("reference", 6))


@query(f"SELECT {', '.join(f'round(avg({_ok(m)}), 6) AS {m}' for m in METRICS)}, count(*) AS n FROM sweep_results")
def metric_bundle(spark, folder):
    """CMP-07, FN-07."""
    return sweep(spark, folder).agg(*[F.round(F.avg(sweeps.usable(m)), 6).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))


@query("""SELECT c.run_id, c.epochs, coalesce(c.data_seed, c.seed) AS effective_seed, count(s.run_id) AS n_results, max(s.n_rows) AS n_rows, max(s.sample_rows) AS requested FROM training_config c
    LEFT JOIN sweep_results s ON c.run_id = s.run_id GROUP BY ALL""")
def run_overview(spark, folder):
    """SMP-10, API-12: a run with the rows that it asked for and those it had; runs without results stay."""
    runs = table(spark, folder, "training_config").select("run_id", F.col("epochs"), F.coalesce("data_seed", "seed").alias("effective_seed"))
    results = sweep(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_results"), F.max("n_rows").alias("n_rows"), F.max("sample_rows").alias("requested"))
    return runs.join(results, "run_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


# --- Histories: a customer's orders by date stand for a run's epochs -------------------------

_HISTORY_SQL = """SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS INT) AS epoch, o_totalprice / 100000.0 AS loss, CAST(o_orderkey % 3 AS INT) AS units FROM orders"""


def history(spark, folder):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run"), F.row_number().over(order).alias("epoch"), (F.col("o_totalprice") / 100000.0).alias("loss"), (F.col("o_orderkey") % 3).cast("int").alias("units")
    )


@query(f"""SELECT run, epoch, round(loss, 7) AS loss, round(best, 7) AS best_before, (best IS NULL OR loss < best) AS improved FROM (
    SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({_HISTORY_SQL}))""")
def running_best(spark, folder):
    """WIN-05."""
    return sweeps.best_epochs(history(spark, folder), "run", "epoch", "loss").select("run", "epoch", F.round("loss", 7).alias("loss"), F.round("best_before", 7).alias("best_before"), "improved")


@query(f"SELECT run, arg_min(epoch, (loss, epoch)) AS best_epoch, round(min(loss), 7) AS best_loss FROM ({_HISTORY_SQL}) GROUP BY run")
def best_epoch(spark, folder):
    """WIN-05."""
    return sweeps.best_epoch(history(spark, folder), "run", "epoch", "loss").withColumn("best_loss", F.round("best_loss", 7))


@query(f"""WITH h AS ({_HISTORY_SQL}), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, lag(units) OVER (PARTITION BY run ORDER BY epoch) AS u FROM h),
    f AS (SELECT *, coalesce((best - loss) / nullif(abs(best), 0) <= 0.01 AND units = u, FALSE) AS flat FROM b),
    i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY epoch) AS island FROM f)
    SELECT run, epoch, sum(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY epoch)::BIGINT AS stagnant FROM i""")
def stagnation_run(spark, folder):
    """WIN-06."""
    return sweeps.stagnation(history(spark, folder), "run", "epoch", "loss", "units", 0.01).select("run", "epoch", "stagnant")


@query(f"SELECT run, epoch, round(previous, 7) AS previous, round((loss - previous) / nullif(previous, 0), 6) AS change FROM (SELECT *, lag(loss) OVER (PARTITION BY run ORDER BY epoch) AS previous FROM ({_HISTORY_SQL}))")
def epoch_lag_compare(spark, folder):
    """WIN-04."""
    return sweeps.epoch_changes(history(spark, folder), "run", "epoch", "loss").select("run", "epoch", F.round("previous", 7).alias("previous"), F.round("change", 6).alias("change"))


@query(f"SELECT run, arg_max(epoch, epoch) AS last_epoch, round(arg_max(loss, epoch), 7) AS last_loss FROM ({_HISTORY_SQL}) GROUP BY run")
def history_last(spark, folder):
    """SRC-13: an array of epochs and its last entry."""
    runs = history(spark, folder).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "loss"))).alias("history"))
    return sweeps.last_of_history(runs, "history").select("run", F.col("last.epoch").alias("last_epoch"), F.round("last.loss", 7).alias("last_loss"))


# --- Losses over scored rows: smq_after stands for the reconstruction of smq_before ------------

_LOSS = ["smq_before", "smq_after", "edist", "hamdist"]
_MSE_SQL = "sum(CASE WHEN {t} IS NOT NULL AND {p} IS NOT NULL THEN pow({p} - {t}, 2) END)"


@query(f"""SELECT round((coalesce(sum(pow(smq_after - smq_before, 2)), 0) + coalesce(sum(pow(hamdist - edist, 2)), 0)) / greatest(count(smq_after - smq_before) + count(hamdist - edist), 1), 6) AS numeric_loss FROM {observations_sql(_LOSS)}""")
def masked_loss(spark, folder):
    """AGG-17: squared errors where the mask is 1, over at least one value."""
    rows = observations(spark, folder, _LOSS)
    gaps = [(F.col(p) - F.col(t)).cast("double") for t, p in (("smq_before", "smq_after"), ("edist", "hamdist"))]
    errors = sum(F.coalesce(F.sum(g * g), F.lit(0.0)) for g in gaps)
    return rows.agg(F.round(errors / F.greatest(sum(F.count(g) for g in gaps), F.lit(1)), 6).alias("numeric_loss"))


@query(f"SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(pow(smq_after - smq_before, 2)) AS m FROM {observations_sql(_LOSS)} GROUP BY row_index // 4096)")
def batch_mean_of_means(spark, folder):
    """AGG-18."""
    gap = (F.col("smq_after") - F.col("smq_before")).cast("double")
    batches = observations(spark, folder, _LOSS).groupBy(F.floor(F.col("row_index") / 4096)).agg(F.avg(gap * gap).alias("m"))
    return batches.agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("SELECT run_id, round(epoch_us(max(scored_at) - min(scored_at)) / 1000000.0 / greatest(count(*), 1) * 1000000, 3) AS seconds_per_million FROM analysis GROUP BY run_id")
def throughput(spark, folder):
    """AGG-27: seconds per million rows, extrapolated from what was scored."""
    seconds = (F.unix_micros(F.max("scored_at")) - F.unix_micros(F.min("scored_at"))) / 1_000_000.0
    return table(spark, folder, "analysis").groupBy("run_id").agg(F.round(seconds / F.greatest(F.count(F.lit(1)), F.lit(1)) * 1_000_000, 3).alias("seconds_per_million"))


#: Runs of a grid, numbered with the last parameter fastest.
GRID_ROWS, GRID_SEEDS = (50_000, 100_000, 250_000), (1, 2, 3, 4, 5)


@query("SELECT i AS task, ([50000, 100000, 250000])[i // 5 + 1]::BIGINT AS sample_rows, ([1, 2, 3, 4, 5])[i % 5 + 1]::INT AS data_seed FROM (SELECT unnest(range(15)) AS i)")
def parameter_grid(spark, folder):
    """API-12: a task's number gives its size and seed by division and remainder."""
    return sweeps.grid(spark, {"sample_rows": ("bigint", GRID_ROWS), "data_seed": ("int", GRID_SEEDS)})


@query(f"""SELECT feature, error, CAST(row_number() OVER (ORDER BY error DESC, feature) AS INT) AS place FROM (
    SELECT 'smq' AS feature, round(avg(pow(smq_after - smq_before, 2)), 6) AS error FROM {observations_sql(_LOSS)} UNION ALL SELECT 'dist', round(avg(pow(hamdist - edist, 2)), 6) FROM {observations_sql(_LOSS)})""")
def worst_columns(spark, folder):
    """AGG-16, TOP-06: columns by their error, worst first."""
    pairs = {"smq": ("smq_before", "smq_after"), "dist": ("edist", "hamdist")}
    return sweeps.worst_columns(observations(spark, folder, _LOSS), pairs)


@query("SELECT p_type AS label, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def subset_renamed(spark, folder):
    """EXT-04, PRJ-04, FLT-09: a subset of a table under other names."""
    rows = table(spark, folder, "part").select("p_type", "p_retailprice").where("p_type IS NOT NULL").withColumnsRenamed({"p_type": "label", "p_retailprice": "price"})
    return rows.groupBy("label").agg(F.min("price").alias("low"), F.max("price").alias("high"))

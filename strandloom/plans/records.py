"""Queries over labelled records and latent spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bases import plain, plain_sql
from ..functions.contexts import sbs96_labels
from ..operators import exports, labelled, latent, quantiles
from ..sources.tables import table
from .registry import observations, observations_sql, query
from .variants import comp

CONTEXT = ["ref_base", "alt_base", "x_prev1", "x_next1"]


def scored(spark, folder):
    """Labelled records as they were scored, repeats included."""
    return table(spark, folder, "analysis")


_STATS_SQL = """
    SELECT cluster_label, count(*) AS cluster_size, round(avg(p), 6) AS mean_probability, round(median(p), 6) AS median_probability
    FROM (SELECT cluster_label, CASE WHEN CAST(cluster_probability AS VARCHAR) <> 'nan' THEN CAST(cluster_probability AS DOUBLE) END AS p FROM analysis WHERE cluster_label >= 0) GROUP BY cluster_label"""


@query(_STATS_SQL)
def cluster_stats(spark, folder):
    """AGG-04."""
    return labelled.cluster_stats(scored(spark, folder)).withColumns({c: F.round(c, 6) for c in ("mean_probability", "median_probability")})


@query("SELECT count(*) FILTER (WHERE cluster_label = -1) AS n_noise, count(DISTINCT cluster_label) FILTER (WHERE cluster_label >= 0) AS n_labels FROM analysis")
def noise_count(spark, folder):
    """AGG-06, AGG-25."""
    return labelled.noise_count(scored(spark, folder))


_COUNTS_SQL = "SELECT cluster_label, ref_base, alt_base, x_prev1, x_next1, count(*) AS n FROM analysis WHERE cluster_label >= 0 GROUP BY ALL"


@query(_COUNTS_SQL)
def context192_counts(spark, folder):
    """AGG-05."""
    return labelled.context_counts(scored(spark, folder))


_SBS_SQL = f"""CASE WHEN ref_base IN ('C','T') AND alt_base IN ('A','C','G','T') AND ref_base <> alt_base THEN x_prev1 || '[' || ref_base || '>' || alt_base || ']' || x_next1
    WHEN ref_base IN ('A','G') AND alt_base IN ('A','C','G','T') AND ref_base <> alt_base THEN ({comp("x_next1")}) || '[' || ({comp("ref_base")}) || '>' || ({comp("alt_base")}) || ']' || ({comp("x_prev1")}) END"""


@query(f"""SELECT c.cluster_label, c.n, ref_base || '>' || alt_base AS ref_alt, x_prev1 || '[' || ref_base || '>' || alt_base || ']' || x_next1 AS trinuc192, {_SBS_SQL} AS sbs96, s.cluster_size,
    round(n / s.cluster_size, 6) AS fraction FROM ({_COUNTS_SQL}) c LEFT JOIN ({_STATS_SQL}) s USING (cluster_label)""")
def context_annotated_fraction(spark, folder):
    """AGG-28, JOIN-04, FN-03."""
    rows = scored(spark, folder)
    named = labelled.annotated(labelled.context_counts(rows), labelled.cluster_stats(rows))
    return named.select("cluster_label", "n", "ref_alt", "trinuc192", "sbs96", "cluster_size", F.round("fraction", 6).alias("fraction"))


SPECTRUM_SQL = f"SELECT cluster_label, sbs96, CAST(sum(n) AS BIGINT) AS n FROM (SELECT cluster_label, {_SBS_SQL} AS sbs96, n FROM ({_COUNTS_SQL})) WHERE sbs96 IS NOT NULL GROUP BY ALL"


@query(SPECTRUM_SQL)
def sbs96_spectrum(spark, folder):
    """AGG-11."""
    return labelled.spectrum(labelled.context_counts(scored(spark, folder)))


@query(f"""WITH s AS (SELECT cluster_label, {_SBS_SQL} AS sbs96, n FROM ({_COUNTS_SQL}))
    SELECT k.cluster_label, CAST(l.place AS INT) AS place, l.sbs96, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT cluster_label FROM s WHERE sbs96 IS NOT NULL) k
    CROSS JOIN (SELECT unnest([{", ".join(f"'{x}'" for x in sbs96_labels())}]) AS sbs96, unnest(range(96)) AS place) l
    LEFT JOIN s ON s.cluster_label = k.cluster_label AND s.sbs96 = l.sbs96 GROUP BY ALL""")
def sbs96_matrix(spark, folder):
    """AGG-12: every cluster present, in long form."""
    return labelled.dense_matrix(labelled.spectrum(labelled.context_counts(scored(spark, folder))))


@query(f"""SELECT cluster_label, trinuc192, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_label ORDER BY n DESC, trinuc192) AS INT) AS place FROM (
    SELECT cluster_label, x_prev1 || '[' || ref_base || '>' || alt_base || ']' || x_next1 AS trinuc192, n FROM ({_COUNTS_SQL})) WHERE trinuc192 IS NOT NULL) WHERE place <= 6""")
def top6_contexts(spark, folder):
    """TOP-03."""
    rows = scored(spark, folder)
    named = labelled.annotated(labelled.context_counts(rows), labelled.cluster_stats(rows)).where("trinuc192 IS NOT NULL")
    return labelled.top_per_group(named, ["cluster_label"], [F.desc("n"), F.asc("trinuc192")], 6).select("cluster_label", "trinuc192", "n", "place")


@query(f"SELECT cluster_label, cluster_size FROM ({_STATS_SQL}) ORDER BY cluster_size DESC, cluster_label LIMIT 20")
def largest_clusters(spark, folder):
    """TOP-07: the legend's twenty."""
    return labelled.cluster_stats(scored(spark, folder)).select("cluster_label", "cluster_size").limit(20)


_WEIGHTS_SQL = f"""s AS (SELECT cluster_label, sbs96, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT cluster_label, {_SBS_SQL} AS sbs96, n FROM ({_COUNTS_SQL})) WHERE sbs96 IS NOT NULL GROUP BY ALL),
    w AS (SELECT sbs96, sum(n) AS w FROM s GROUP BY ALL)"""


@query(f"""WITH {_WEIGHTS_SQL} SELECT cluster_label, round(sum(n * w) / sqrt(sum(n * n) * (SELECT sum(w * w) FROM w)), 6) AS similarity FROM s JOIN w USING (sbs96) GROUP BY cluster_label ORDER BY similarity DESC, cluster_label""")
def spectrum_similarity(spark, folder):
    """TOP-04: the cosine of each cluster's spectrum and that of all clusters, most similar first."""
    spectra = labelled.spectrum(labelled.context_counts(scored(spark, folder)))
    whole = spectra.groupBy("sbs96").agg(F.sum("n").alias("n"))
    return labelled.similarities(spectra, whole).withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "cluster_label")


_STATUS = ["MIXED", "PLUS", "MINUS", "UNDETERMINED"]
_ACTIVITY_SQL = f"SELECT sample_id, {', '.join(f'''count(*) FILTER (WHERE st = '{s}') AS {s.lower()}''' for s in _STATUS)} FROM {observations_sql(['sample_id', 'st'])} GROUP BY sample_id"
_GREATEST = "greatest(mixed, plus, minus, undetermined)"
_DOMINANT_SQL = f"""SELECT *, CASE {_GREATEST} WHEN mixed THEN 'mixed' WHEN plus THEN 'plus' WHEN minus THEN 'minus' ELSE 'undetermined' END AS dominant,
    round(coalesce({_GREATEST} / nullif(mixed + plus + minus + undetermined, 0), 0.0), 6) AS dominant_fraction FROM ({_ACTIVITY_SQL})"""


def _activities(spark, folder):
    rows = observations(spark, folder, ["sample_id", "st"])
    wide = rows.groupBy("sample_id").agg(*[F.count_if(F.coalesce(F.col("st") == s, F.lit(False))).alias(s.lower()) for s in _STATUS])
    return labelled.dominant(wide, [s.lower() for s in _STATUS]).withColumn("dominant_fraction", F.round("dominant_fraction", 6))


@query(_DOMINANT_SQL)
def dominant_signature(spark, folder):
    """AGG-13, TOP-06: activities are counts of strand tags per sample."""
    return _activities(spark, folder)


@query(f"""SELECT s.run_id, s.cluster_label, s.cluster_size, s.best_snvq, coalesce(f.n_fitted, 0) AS n_fitted FROM (
    SELECT run_id, cluster_label, count(*) AS cluster_size, max(CASE WHEN CAST(snvq AS VARCHAR) <> 'nan' THEN snvq END) AS best_snvq FROM analysis WHERE cluster_label >= 0 GROUP BY ALL) s
    LEFT JOIN (SELECT run_id, CAST(replace('cluster_' || cluster_label, 'cluster_', '') AS BIGINT) AS cluster_label, count(*) AS n_fitted FROM fit_assignments WHERE cluster_label IS NOT NULL GROUP BY ALL) f
    ON s.run_id = f.run_id AND s.cluster_label = f.cluster_label""")
def cluster_summary_join(spark, folder):
    """JOIN-05, FN-05: a two-key left join on a label that comes as text."""
    best = F.max(F.when(~F.isnan("snvq"), F.col("snvq"))).alias("best_snvq")
    sizes = scored(spark, folder).where("cluster_label >= 0").groupBy("run_id", "cluster_label").agg(F.count(F.lit(1)).alias("cluster_size"), best)
    fitted = table(spark, folder, "fit_assignments").where("cluster_label IS NOT NULL")
    fitted = fitted.select("run_id", labelled.cluster_number(F.concat(F.lit("cluster_"), F.col("cluster_label"))).alias("cluster_label"))
    fitted = fitted.groupBy("run_id", "cluster_label").agg(F.count(F.lit(1)).alias("n_fitted"))
    return sizes.join(fitted, ["run_id", "cluster_label"], "left").withColumn("n_fitted", F.coalesce("n_fitted", F.lit(0)))


_FIT_SQL = "SELECT run_id, row_index, max(cluster_label) AS l, max(cluster_probability) AS p FROM fit_assignments GROUP BY ALL"


@query(f"""SELECT a.run_id, a.row_index, CASE WHEN f.run_id IS NULL THEN a.cluster_label ELSE f.l END AS cluster_label, f.run_id IS NOT NULL AS from_fit
    FROM analysis a LEFT JOIN ({_FIT_SQL}) f ON a.run_id = f.run_id AND a.row_index = f.row_index""")
def overlay_labels(spark, folder):
    """JOIN-07."""
    fitted = table(spark, folder, "fit_assignments").groupBy("run_id", "row_index").agg(F.max("cluster_label").alias("cluster_label"), F.max("cluster_probability").alias("cluster_probability"))
    predicted = scored(spark, folder).select("run_id", "row_index", "cluster_label", "cluster_probability")
    return labelled.overlay(predicted, fitted, ["run_id", "row_index"]).drop("cluster_probability")


_SOURCE = ["row_index", "chrom", "pos", "ref_base", "alt_base", "snvq", "qual", "mapq", "dp", "raw_vaf", "filt"]
_EXPORT_SQL = f"""SELECT s.row_index, s.chrom, s.pos, s.ref_base, s.alt_base, s.mapq, a.cluster_label FROM {observations_sql(_SOURCE)} s JOIN analysis a ON s.row_index = a.row_index
    WHERE s.filt = 1 AND a.cluster_label >= 0"""


def _export(spark, folder, predicate="filt = 1", **filters):
    return exports.export_rows(observations(spark, folder, _SOURCE), scored(spark, folder), predicate, **filters)


@query(_EXPORT_SQL)
def export_join_rowindex(spark, folder):
    """JOIN-01/02, PRJ-03, FLT-03."""
    return _export(spark, folder, without_noise=True).select("row_index", "chrom", "pos", "ref_base", "alt_base", "mapq", "cluster_label")


@query(f"""SELECT s.chrom, s.pos, s.ref_base, s.alt_base, a.cluster_label FROM {observations_sql(_SOURCE)} s
    JOIN (SELECT {plain_sql("chrom")} AS chrom, pos, {plain_sql("ref_base")} AS ref_base, {plain_sql("alt_base")} AS alt_base, cluster_label FROM analysis WHERE cluster_label IS NOT NULL) a USING (chrom, pos, ref_base, alt_base) WHERE s.filt = 1""")
def export_join_locus(spark, folder):
    """JOIN-01/02: without row_index the locus joins; noise stays where nothing excludes it."""
    source = observations(spark, folder, _SOURCE).drop("row_index")
    labels = scored(spark, folder).drop("row_index").withColumns({c: plain(F.col(c)) for c in ("chrom", "ref_base", "alt_base")})
    return exports.export_rows(source, labels, "filt = 1").select("chrom", "pos", "ref_base", "alt_base", "cluster_label")


@query(f"SELECT row_index, cluster_label FROM ({_EXPORT_SQL.replace('a.cluster_label >= 0', 'a.cluster_label IN (-1, 3)')})")
def export_cluster_filter(spark, folder):
    """FLT-03: an explicit list overrides the exclusion of noise."""
    return _export(spark, folder, only=(-1, 3), without_noise=True).select("row_index", "cluster_label")


@query(f"SELECT count(*) AS n_rows FROM ({_EXPORT_SQL})")
def export_count(spark, folder):
    """AGG-30."""
    return _export(spark, folder, without_noise=True).agg(F.count(F.lit(1)).alias("n_rows"))


def _six(c):
    return f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN printf('%.6g', CAST({c} AS DOUBLE)) END"


_INFO_SQL = ", ".join([
    "'CLUSTER=' || a.cluster_label", f"'CLPROB=' || ({_six('a.cluster_probability')})", f"'UMAP1=' || ({_six('a.umap_1')})", f"'UMAP2=' || ({_six('a.umap_2')})", "'SRC_FILT=' || s.filt",
])


@query(f"""SELECT concat_ws(chr(9), coalesce(s.chrom, '.'), coalesce(CAST(s.pos AS VARCHAR), '.'), '.', coalesce(s.ref_base, '.'), coalesce(s.alt_base, '.'), coalesce({_six("s.qual")}, '.'),
    CASE WHEN s.filt IS NULL OR s.filt = 1 THEN 'PASS' ELSE '.' END, concat_ws(';', {_INFO_SQL})) AS line
    FROM {observations_sql(_SOURCE)} s JOIN analysis a ON s.row_index = a.row_index WHERE a.cluster_label >= 0""")
def vcf_lines(spark, folder):
    """SNK-06, FN-06, TOP-05: whatever the source filter says."""
    return exports.vcf_lines(_export(spark, folder, None, without_noise=True)).select("line")


@query("""SELECT run_id, round(quantile_cont(snvq, 0.01), 6) AS p01, round(quantile_cont(snvq, 0.99), 6) AS p99 FROM analysis WHERE snvq IS NOT NULL AND isfinite(snvq) GROUP BY run_id""")
def quantile_clamp(spark, folder):
    """AGG-23, FLT-10."""
    finite = scored(spark, folder).where(F.col("snvq").isNotNull() & ~F.isnan("snvq") & (F.abs("snvq") < float("inf")))
    found = quantiles.exact(finite, ["run_id"], F.col("snvq"), {"p01": 0.01, "p99": 0.99})
    return found.select("run_id", F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"))


@query("""SELECT run_id, round(min(umap_1::DOUBLE) - 0.5, 5) AS x_low, round(max(umap_1::DOUBLE) + 0.5, 5) AS x_high, round(min(umap_2::DOUBLE) - 0.5, 5) AS y_low, round(max(umap_2::DOUBLE) + 0.5, 5) AS y_high
    FROM analysis WHERE umap_1 IS NOT NULL AND umap_2 IS NOT NULL AND CAST(umap_1 AS VARCHAR) <> 'nan' AND CAST(umap_2 AS VARCHAR) <> 'nan' GROUP BY run_id""")
def extent(spark, folder):
    """AGG-26."""
    rows = scored(spark, folder).where("umap_1 IS NOT NULL AND umap_2 IS NOT NULL AND NOT isnan(umap_1) AND NOT isnan(umap_2)")
    ends = [(f, a, s, n) for a, n in (("umap_1", "x"), ("umap_2", "y")) for f, s, n in ((F.min, -0.5, f"{n}_low"), (F.max, 0.5, f"{n}_high"))]
    return rows.groupBy("run_id").agg(*[F.round(f(F.col(a).cast("double")) + s, 5).alias(n) for f, a, s, n in ends])


# --- Latent spaces: the first and the last half of the dimensions are the two spaces compared ---

D = 8


def _space(spark, folder, half):
    return latent.wide_to_array(table(spark, folder, "embedding"), "row_index", "latent_", half * D, (half + 1) * D)


def _pairs(spark, folder):
    return latent.paired(_space(spark, folder, 0), _space(spark, folder, 1), "row_index")


def _one(spark, name, value):
    return spark.createDataFrame([(round(value, 6) + 0.0,)], f"{name} double")


_DIMS = range(D)
_L = lambda i: f"latent_{i}::DOUBLE"


def _whole(spark, folder):
    space = latent.wide_to_array(table(spark, folder, "embedding"), "row_index", "latent_")
    return space, latent.width(space)


_ALL = range(2 * D)
_ALL_MOMENTS_SQL = " UNION ALL ".join(f"SELECT {i} AS dim, count(*) AS n_rows, avg({_L(i)}) AS mean, greatest(avg({_L(i)} * {_L(i)}) - avg({_L(i)}) * avg({_L(i)}), 0) AS var FROM embedding" for i in _ALL)


@query(f"SELECT dim, n_rows, round(mean, 6) AS mean, round(var, 6) AS var FROM ({_ALL_MOMENTS_SQL})")
def latent_moments(spark, folder):
    """AGG-14."""
    return latent.moments(*_whole(spark, folder)).withColumns({c: F.round(c, 6) for c in ("mean", "var")})


@query(f"SELECT count(*) FILTER (WHERE var > 0.01) AS active_units, max(n_rows) AS n_rows FROM ({_ALL_MOMENTS_SQL})")
def latent_active_units(spark, folder):
    """AGG-14."""
    return latent.active_units(latent.moments(*_whole(spark, folder)))


@query(f"SELECT round(({' + '.join(f'stddev_pop({_L(i)})' for i in _ALL)}) / {len(_ALL)}, 6) AS latent_collapse FROM embedding")
def collapse_score(spark, folder):
    """AGG-15."""
    return latent.collapse_score(*_whole(spark, folder)).withColumn("latent_collapse", F.round("latent_collapse", 6))


@query(f"""SELECT round(100 * avg(CASE WHEN down THEN 0.0 ELSE 1.0 END), 6) AS active_percent, count(*) FILTER (WHERE down) AS n_collapsed, coalesce(string_agg(CAST(dim AS VARCHAR), ',' ORDER BY dim) FILTER (WHERE down), '') AS collapsed
    FROM (SELECT dim, ((var + mean * mean) / 2 < 0.01 OR var < 0.01) AS down FROM ({_ALL_MOMENTS_SQL}))""")
def collapse_diagnosis(spark, folder):
    """AGG-16."""
    return latent.collapse_diagnosis(*_whole(spark, folder)).withColumn("active_percent", F.round("active_percent", 6))


def _cross_sql(a, b, centred=True):
    cell = lambda i, j: f"pow(sum({_L(i)} * {_L(j)})" + (f" - sum({_L(i)}) * sum({_L(j)}) / count(*)" if centred else "") + ", 2)"
    return " + ".join(cell(a * D + i, b * D + j) for i in _DIMS for j in _DIMS)


@query(f"SELECT round(({_cross_sql(0, 1)}) / (sqrt({_cross_sql(0, 0)}) * sqrt({_cross_sql(1, 1)})), 6) AS linear_cka FROM embedding")
def linear_cka(spark, folder):
    """CMP-02, JOIN-08."""
    return _one(spark, "linear_cka", latent.linear_cka(_pairs(spark, folder)))


@query(f"SELECT round(1 - sqrt(xx + yy - 2 * xy) / (sqrt(xx) * sqrt(yy)), 6) AS gram_similarity FROM (SELECT {_cross_sql(0, 0, False)} AS xx, {_cross_sql(1, 1, False)} AS yy, {_cross_sql(0, 1, False)} AS xy FROM embedding)")
def gram_similarity(spark, folder):
    """CMP-03."""
    return _one(spark, "gram_similarity", latent.gram_similarity(_pairs(spark, folder)))


@query()
def procrustes(spark, folder):
    """CMP-01."""
    return _one(spark, "procrustes_disparity", latent.procrustes(_pairs(spark, folder)))


def _centred_sql(i, j):
    return f"(sum({_L(i)} * {_L(j)}) - sum({_L(i)}) * sum({_L(j)}) / count(*))"


@query(f"""SELECT round(1 - (xx + 2 * abs(det)) / (a * b), 6) AS procrustes_disparity FROM (SELECT {_centred_sql(0, 0)} + {_centred_sql(1, 1)} AS a, {_centred_sql(2, 2)} + {_centred_sql(3, 3)} AS b,
    pow({_centred_sql(0, 2)}, 2) + pow({_centred_sql(0, 3)}, 2) + pow({_centred_sql(1, 2)}, 2) + pow({_centred_sql(1, 3)}, 2) AS xx,
    {_centred_sql(0, 2)} * {_centred_sql(1, 3)} - {_centred_sql(0, 3)} * {_centred_sql(1, 2)} AS det FROM embedding)""")
def procrustes_planes(spark, folder):
    """CMP-01 on two planes, where the best rotation has a closed form."""
    plane = lambda first: latent.wide_to_array(table(spark, folder, "embedding"), "row_index", "latent_", first, first + 2)
    return _one(spark, "procrustes_disparity", latent.procrustes(latent.paired(plane(0), plane(2), "row_index")))


def _vectors(spark, folder):
    half = lambda a, b: F.transform(F.slice("embedding", a, b), lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), half(1, 16).alias("x"), half(17, 48).alias("y"))


_RANKS_SQL = """WITH v AS (SELECT vec_id AS id, embedding[1:16]::DOUBLE[] AS x, embedding[17:64]::DOUBLE[] AS y FROM embeddings),
    d AS (SELECT a.id, b.id AS other, list_distance(a.x, b.x) AS dx, list_distance(a.y, b.y) AS dy FROM v a JOIN v b ON a.id <> b.id),
    r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY dx, other) AS rx, row_number() OVER (PARTITION BY id ORDER BY dy, other) AS ry FROM d)"""


@query(f"{_RANKS_SQL} SELECT id, CAST(rx AS INT) AS place, other AS neighbour FROM r WHERE rx <= 10")
def knn_topk(spark, folder):
    """JOIN-09."""
    return latent.nearest(_vectors(spark, folder), "id", 10)


@query(f"""{_RANKS_SQL} SELECT round(avg(shared / (20 - shared)), 6) AS jaccard FROM (SELECT id, count(*) FILTER (WHERE rx <= 10 AND ry <= 10) AS shared FROM r GROUP BY id)""")
def knn_jaccard10(spark, folder):
    """CMP-04, JOIN-10."""
    return latent.knn_jaccard(_vectors(spark, folder), "id", 10).withColumn("jaccard", F.round("jaccard", 6))


def _trust_sql(a, b, name):
    return f"""{_RANKS_SQL}, n AS (SELECT count(*) AS n FROM v)
        SELECT round(1 - 2.0 / (n * 10 * (2 * n - 31)) * (SELECT sum(greatest({a} - 10, 0)) FROM r WHERE {b} <= 10), 6) AS {name} FROM n"""


@query(_trust_sql("rx", "ry", "trustworthiness"))
def trustworthiness(spark, folder):
    """CMP-05."""
    return latent.trustworthiness(latent.metric_rows(_vectors(spark, folder), "id"), "id", 10).withColumn("trustworthiness", F.round("trustworthiness", 6))


@query(_trust_sql("ry", "rx", "continuity"))
def continuity(spark, folder):
    """CMP-06."""
    return latent.trustworthiness(latent.metric_rows(_vectors(spark, folder), "id"), "id", 10, swapped=True).withColumn("continuity", F.round("continuity", 6))


@query("""WITH c AS (SELECT a.cluster_label AS a, f.cluster_label AS b, count(*)::DOUBLE AS n FROM (SELECT DISTINCT run_id, row_index, cluster_label FROM analysis) a
        JOIN (SELECT DISTINCT run_id, row_index, cluster_label FROM fit_assignments) f USING (run_id, row_index) WHERE a.cluster_label IS NOT NULL AND f.cluster_label IS NOT NULL GROUP BY ALL),
    ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS nn, (SELECT sum(na * (na - 1) / 2) FROM ra) AS pa, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS pb, t * (t - 1) / 2 AS pt,
        (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(na / t * ln(na / t)) FROM ra, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM rb, t) AS hb FROM t)
    SELECT round((nn - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM s""")
def ari_nmi(spark, folder):
    """AGG-29: predicted against fitted labels."""
    a = scored(spark, folder).select("run_id", "row_index", F.col("cluster_label").alias("a")).distinct()
    b = table(spark, folder, "fit_assignments").select("run_id", "row_index", F.col("cluster_label").alias("b")).distinct()
    return latent.label_agreement(a.join(b, ["run_id", "row_index"]), "a", "b").withColumns({c: F.round(c, 6) for c in ("ari", "nmi")})

"""Queries over single-read observations: filters, histograms, dedup, samples, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import complement
from ..functions.contexts import labels
from ..operators import encoding, histograms, ranked, sampling, unions
from ..sources.tables import scan, table
from .registry import observations, observations_sql, query

BASES4 = ["ref_base", "alt_base", "x_prev1", "x_next1"]
#: Fixed value (FLT-01): the predicate that is applied where none is given.
DEFAULT_FILTER = "st = 'MIXED' AND et = 'MIXED' AND filt = 1"
HIST = histograms.Window(0.0, 100.0, 20)
_HIST_COLUMNS = [*BASES4, "snvq", "st", "et", "filt"]


def comp(c: str) -> str:
    """The complements of the bases."""
    return f"CASE {c} WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' END"


def filtered(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return observations(spark, folder, [*columns, "st", "et", "filt"]).where(F.expr(DEFAULT_FILTER))


_VALID = " AND ".join(f"{c} IN ('A','C','G','T')" for c in BASES4) + " AND ref_base <> alt_base"
_CANONICAL_SQL = f"""
    SELECT CASE WHEN ref_base IN ('C','T') THEN ref_base || '>' || alt_base ELSE ({comp("ref_base")}) || '>' || ({comp("alt_base")}) END AS change,
           CASE WHEN ref_base IN ('C','T') THEN x_prev1 || x_next1 ELSE ({comp("x_next1")}) || ({comp("x_prev1")}) END AS context, CAST(snvq AS DOUBLE) AS quality
    FROM {observations_sql(_HIST_COLUMNS)} WHERE {DEFAULT_FILTER} AND {_VALID}"""
_BIN_SQL = f"CAST(least(greatest(floor((quality - {HIST.low}) / {(HIST.high - HIST.low) / HIST.bins}), 0), {HIST.bins - 1}) AS INT)"
_CHANGES_SQL = "('C>A','C>G','C>T','T>A','T>C','T>G')"
_HIST_SQL = f"SELECT change, context, {_BIN_SQL} AS bin, count(*) AS n FROM ({_CANONICAL_SQL}) WHERE change IN {_CHANGES_SQL} AND quality BETWEEN {HIST.low} AND {HIST.high} GROUP BY ALL"


@query(_HIST_SQL)
def snvq_hist(spark, folder):
    """FLT-01/04/05/06, FN-01..04, AGG-09."""
    return histograms.histogram(filtered(spark, folder, [*BASES4, "snvq"]), HIST)


@query(f"""SELECT count(*) AS n_filtered, count(*) FILTER (WHERE {_VALID}) AS n_valid, count(*) FILTER (WHERE {_VALID}) AS n_canonical,
    count(*) FILTER (WHERE {_VALID} AND snvq BETWEEN {HIST.low} AND {HIST.high}) AS n_window,
    min(snvq) FILTER (WHERE {_VALID} AND snvq BETWEEN {HIST.low} AND {HIST.high}) AS least, max(snvq) FILTER (WHERE {_VALID} AND snvq BETWEEN {HIST.low} AND {HIST.high}) AS most
    FROM {observations_sql(_HIST_COLUMNS)} WHERE {DEFAULT_FILTER}""")
def snvq_funnel(spark, folder):
    """AGG-10."""
    return histograms.funnel(filtered(spark, folder, [*BASES4, "snvq"]), HIST)


@query(f"""SELECT c.change, p.b || q.b AS context, CAST(i.bin AS INT) AS bin, coalesce(h.n, 0) AS n
    FROM (SELECT unnest(['C>A','C>G','C>T','T>A','T>C','T>G']) AS change) c, (SELECT unnest(['A','C','G','T']) AS b) p, (SELECT unnest(['A','C','G','T']) AS b) q,
         (SELECT unnest(range({HIST.bins})) AS bin) i
    LEFT JOIN ({_HIST_SQL}) h ON h.change = c.change AND h.context = p.b || q.b AND h.bin = i.bin""")
def hist_dense_grid(spark, folder):
    """JOIN-06."""
    return histograms.dense(spark, histograms.histogram(filtered(spark, folder, [*BASES4, "snvq"]), HIST), HIST)


#: Fixed values (FLT-02).
RQ = (0.025, 0.05, 0.075, 0.1, 0.15)


@query(f"""SELECT t AS threshold, count(*) FILTER (WHERE rq < t) AS n_rows FROM {observations_sql(["rq", "st", "et", "filt"])},
    (SELECT unnest([{", ".join(map(str, RQ))}]::DOUBLE[]) AS t) WHERE {DEFAULT_FILTER} GROUP BY t""")
def rq_threshold_counts(spark, folder):
    """FLT-02: all thresholds in one pass."""
    rows = filtered(spark, folder, ["rq"])
    counts = rows.agg(*[F.count_if(F.col("rq").cast("double") < t).alias(f"_{i}") for i, t in enumerate(RQ)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{i}").alias("n_rows")) for i, t in enumerate(RQ)])))


_DEDUP = [*ranked.LOCUS, *ranked.RANKING, "row_index"]
_DEDUP_OUT = ["row_index", *ranked.LOCUS, "snvq"]
_DEDUP_COLUMNS = [*_DEDUP, "st", "et", "filt"]
#: By its text: isnan() on a scanned column can be folded away from file statistics.
_USABLE_SQL = {c: f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN {c} END" for c in ("snvq", "qual", "raw_vaf")} | {"mapq": "CASE WHEN mapq <> 255 THEN mapq END", "dp": "CASE WHEN dp >= 0 THEN dp END"}
_RANKED_SQL = f"(SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in _USABLE_SQL.items())}) FROM {observations_sql(_DEDUP_COLUMNS)} WHERE {DEFAULT_FILTER})"
_DEDUP_SQL = f"""
    SELECT {", ".join(_DEDUP_OUT)} FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(ranked.LOCUS)} ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ranked.RANKING)},
    {", ".join(f"{c} ASC NULLS LAST" for c in _DEDUP_OUT)}) AS rn FROM {_RANKED_SQL}) WHERE rn = 1"""


def deduplicated(spark, folder):
    return ranked.best_per_locus(filtered(spark, folder, _DEDUP), output=_DEDUP_OUT)


@query(_DEDUP_SQL)
def dedup_rank(spark, folder):
    """WIN-01."""
    return deduplicated(spark, folder)


@query(f"SELECT * FROM ({_DEDUP_SQL}) ORDER BY {sampling.sample_key_sql(42, 'row_index')}, row_index LIMIT 500")
def dedup_sample_exact(spark, folder):
    """SMP-01/02, TOP-01: a sample is what this query is for."""
    return sampling.exact_sample(deduplicated(spark, folder), 500, 42, "row_index")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10")
def dedup_no_identity(spark, folder):
    """WIN-02: no locus, so only the filter."""
    return ranked.best_per_locus(table(spark, folder, "part").where("p_size > 10"), output=["p_partkey", "p_brand"])


@query(f"SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ranked.LOCUS)} FROM ({_DEDUP_SQL}))) AS n_keys FROM ({_DEDUP_SQL})")
def verify_unique(spark, folder):
    """AGG-07."""
    return ranked.uniqueness(deduplicated(spark, folder), ranked.LOCUS)


@query(f"""SELECT count(*) AS n_checked, count(*) FILTER (WHERE kept IS DISTINCT FROM top) AS n_mismatches FROM (
    SELECT k.snvq AS kept, max(s.snvq) AS top FROM {_RANKED_SQL} s JOIN ({_DEDUP_SQL}) k USING ({", ".join(ranked.LOCUS)})
    GROUP BY {", ".join(ranked.LOCUS)}, k.snvq)""")
def verify_group_max(spark, folder):
    """AGG-08, JOIN-03, FLT-08: every kept row, not a spot check."""
    return ranked.group_maximum_mismatches(filtered(spark, folder, _DEDUP), deduplicated(spark, folder), ranked.LOCUS, "snvq")


@query("SELECT row_index, row_number() OVER (ORDER BY row_index) - 1 AS dense_index FROM embedding")
def row_index_dense(spark, folder):
    """WIN-03."""
    return sampling.dense_index(table(spark, folder, "embedding").select("row_index"), "row_index")


SPLIT = 0.9


@query("SELECT row_index, CASE WHEN row_index % 10 = 42 % 10 THEN 'val' ELSE 'train' END AS split FROM embedding")
def split_modulo(spark, folder):
    """SMP-05, FLT-07."""
    return table(spark, folder, "embedding").select("row_index", sampling.modulo_split(F.col("row_index"), SPLIT, 42).alias("split"))


@query(f"""SELECT row_index, CASE WHEN row_number() OVER (ORDER BY {sampling.sample_key_sql(42, "row_index")}, row_index) <= greatest(1, least(n - 1, CAST(floor(n * {SPLIT}) AS BIGINT))) THEN 'train' ELSE 'val' END AS split
    FROM embedding, (SELECT count(*) AS n FROM embedding)""")
def split_hash(spark, folder):
    """SMP-04."""
    return sampling.ranked_split(table(spark, folder, "embedding").select("row_index"), SPLIT, 42, "row_index").select("row_index", "split")


LADDER = (0.5, 1.0, 0.25, 0.1, 0.25)
LADDER_CAP = 1_000


@query(f"""SELECT fraction, sample_rows, row_index FROM (SELECT row_index, row_number() OVER (ORDER BY {sampling.sample_key_sql(7, "row_index")}, row_index) AS rn FROM embedding),
    (SELECT unnest([0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS fraction, unnest([100, 250, 500, 1000]) AS sample_rows) WHERE rn <= sample_rows""")
def fraction_ladder(spark, folder):
    """SMP-09/11: samples of a ladder of sizes are what this query is for."""
    return sampling.fraction_ladder(table(spark, folder, "embedding").select("row_index"), LADDER, LADDER_CAP, 7, "row_index")


@query(f"SELECT event_id, event_id // 500 AS buffer, row_number() OVER (PARTITION BY event_id // 500 ORDER BY {sampling.sample_key_sql(45, 'event_id')}, event_id) AS place FROM events")
def shuffle_epoch_order(spark, folder):
    """SMP-06: epoch 3 of seed 42."""
    rows = table(spark, folder, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("buffer"))
    return sampling.epoch_order(rows, 3, 42, F.col("buffer"), "event_id").withColumn("place", F.col("place").cast("bigint"))


@query(f"SELECT * FROM ({_DEDUP_SQL}) ORDER BY {sampling.sample_key_sql(42 + sampling.REFERENCE_OFFSET, 'row_index')}, row_index LIMIT 300")
def reference_sample(spark, folder):
    """SMP-07, SMP-10: the held-out reference has a seed of its own."""
    return sampling.exact_sample(deduplicated(spark, folder), 300, 42 + sampling.REFERENCE_OFFSET, "row_index")


PROFILE = ["chrom", "ref_base", "tm", "st", "snvq", "mapq", "dp", "rq", "sd", "ed", "l1", "l7", "q2", "q6", "bcsq", "raw_vaf"]


@query(f"SELECT {', '.join(f'count({c}) AS {c}' for c in PROFILE)} FROM {observations_sql(PROFILE)}")
def non_null_counts(spark, folder):
    """AGG-01, SRC-03."""
    return encoding.non_null_counts(observations(spark, folder, PROFILE), PROFILE)


NUMERIC = ["bcsq", "rl", "read_index", "rev", "smq_before", "smq_after", "rq", "edist", "hamdist", "snvq", "sd"]


def _stats_sql(deviation: str, where: str = "TRUE") -> str:
    one = lambda c: f"SELECT '{c}' AS feature, avg({c}::DOUBLE) AS m, {deviation}({c}::DOUBLE) AS s FROM r WHERE {where} AND {c} IS NOT NULL AND NOT isnan({c}::DOUBLE)"
    return f"""WITH r AS (SELECT * FROM {observations_sql(NUMERIC)})
        SELECT feature, round(CASE WHEN m IS NULL OR NOT isfinite(m) THEN 0.0 ELSE m END, 5) AS mean, round(CASE WHEN s IS NULL OR NOT isfinite(s) OR s < 1e-6 THEN 1.0 ELSE s END, 5) AS std
        FROM ({" UNION ALL ".join(one(c) for c in NUMERIC)})"""


@query(_stats_sql("stddev_samp"))
def norm_stats_samp(spark, folder):
    """AGG-02."""
    return encoding.sample_stats(observations(spark, folder, NUMERIC), NUMERIC).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(_stats_sql("stddev_pop", "row_index % 10 <> 2"))
def norm_stats_pop_train(spark, folder):
    """AGG-03, SMP-05."""
    rows = observations(spark, folder, NUMERIC)
    train = sampling.modulo_split(F.col("row_index"), SPLIT, 42) == "train"
    return encoding.train_stats(rows, NUMERIC, train).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


#: The categories of the mixture and strand tags.
TM = encoding.Feature("tm", "c", {"A": 0, "AQ": 1, "AQZ": 2, "AZ": 3, "Q": 4, "QZ": 5, "Z": 6, "": 7})
ST = encoding.Feature("st", "c", {"MINUS": 0, "MIXED": 1, "PLUS": 2, "UNDETERMINED": 3})


def _code_sql(f: encoding.Feature) -> str:
    null = encoding.null_code(f)
    return f"CASE {f.name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in f.values.items()) + f" ELSE {null} END"


@query(f"SELECT row_index, {_code_sql(TM)} AS tm_code, {_code_sql(ST)} AS st_code FROM {observations_sql(['tm', 'st'])}")
def encode_categorical(spark, folder):
    """ENC-01: with and without an empty-text token."""
    rows = observations(spark, folder, ["tm", "st"])
    return rows.select("row_index", encoding.category_code(F.col("tm"), TM).alias("tm_code"), encoding.category_code(F.col("st"), ST).alias("st_code"))


def _missing_sql(c: str) -> str:
    """By its text: isnan() on a scanned column can be folded away from file statistics."""
    return f"({c} IS NULL OR CAST({c} AS VARCHAR) = 'nan')"


Z = {"rq": (0.239, 0.192), "snvq": (40.0, 15.0), "dp": (60.0, 30.0)}


@query("SELECT row_index, " + ", ".join(
    f"round(CASE WHEN {_missing_sql(c)} THEN 0.0 ELSE ({c}::FLOAT::DOUBLE - {m}) / {s} END, 4) AS {c}, CASE WHEN {_missing_sql(c)} THEN 0 ELSE 1 END AS {c}_mask" for c, (m, s) in Z.items()
) + f" FROM {observations_sql(list(Z))}")
def encode_numeric_zscore(spark, folder):
    """ENC-02, ENC-03."""
    rows = observations(spark, folder, list(Z))
    shown = [F.round(encoding.standardised(F.col(c), m, s), 4).alias(c) for c, (m, s) in Z.items()]
    return rows.select("row_index", *shown, *[F.when(encoding.is_missing(F.col(c)), 0).otherwise(1).alias(f"{c}_mask") for c in Z])


_DROP = [TM, ST, *[encoding.Feature(c, "float") for c in ("rq", "snvq", "sd", "ed", "l1", "l2", "q2", "rev")]]


@query("SELECT unnest(list_filter([" + ", ".join(
    f"CASE WHEN {('count(' + f.name + ') > 0 AND NOT (min(' + _code_sql(f) + ') = ' + str(encoding.null_code(f)) + ' AND max(' + _code_sql(f) + ') = ' + str(encoding.null_code(f)) + ')') if f.kind == 'c' else 'count(*) FILTER (WHERE NOT ' + _missing_sql(f.name) + ') > 0'} THEN '{f.name}' END" for f in _DROP
) + f"], lambda x: x IS NOT NULL)) AS feature FROM {observations_sql([f.name for f in _DROP])}")
def sample_null_drop(spark, folder):
    """ENC-04, ENC-05."""
    kept = encoding.kept_features(observations(spark, folder, [f.name for f in _DROP]), _DROP)
    return spark.createDataFrame([(f.name,) for f in kept], "feature string")


@query(f"SELECT ref_base, {comp('ref_base')} AS complement, count(*) AS n FROM {observations_sql(['ref_base'])} GROUP BY ALL")
def base_complement(spark, folder):
    """FN-01, PRJ-06."""
    return observations(spark, folder, ["ref_base"]).groupBy("ref_base").agg(F.count(F.lit(1)).alias("n")).withColumn("complement", complement(F.col("ref_base")))


@query(f"""SELECT ref_base || '>' || alt_base AS ref_alt, x_prev1 || x_next1 AS context16, x_prev1 || '[' || ref_base || '>' || alt_base || ']' || x_next1 AS trinuc192,
    CASE WHEN (CASE WHEN ref_base IN ('C','T') THEN ref_base || '>' || alt_base ELSE ({comp("ref_base")}) || '>' || ({comp("alt_base")}) END) IN {_CHANGES_SQL} THEN
      CASE WHEN ref_base IN ('C','T') THEN x_prev1 || '[' || ref_base || '>' || alt_base || ']' || x_next1
      ELSE ({comp("x_next1")}) || '[' || ({comp("ref_base")}) || '>' || ({comp("alt_base")}) || ']' || ({comp("x_prev1")}) END END AS sbs96, count(*) AS n
    FROM {observations_sql(BASES4)} GROUP BY ALL""")
def context_labels(spark, folder):
    """FN-02, FN-03."""
    return observations(spark, folder, BASES4).select(*[c.alias(n) for n, c in labels(*[F.col(c) for c in BASES4]).items()]).groupBy("ref_alt", "context16", "trinuc192", "sbs96").agg(F.count(F.lit(1)).alias("n"))


_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_linenumber > 3")
def union_by_name(spark, folder):
    """SRC-05, SET-01: one part lacks a column and has another order."""
    lines = table(spark, folder, "lineitem")
    return unions.union_by_name([lines.where("l_linenumber <= 3").select(*_LINE), lines.where("l_linenumber > 3").select("l_linenumber", "l_orderkey")])


@query("SELECT 'returned' AS part, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL UNION ALL SELECT 'other', l_returnflag, count(*) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def union_tagged(spark, folder):
    """SET-02."""
    lines = table(spark, folder, "lineitem")
    both = {"returned": lines.where("l_returnflag = 'R'"), "other": lines.where("l_returnflag <> 'R'")}
    return unions.tagged(both, "part").groupBy("part", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT epochs FROM sweep_results WHERE epochs IS NOT NULL ORDER BY epochs")
def distinct_sorted(spark, folder):
    """SET-03."""
    return table(spark, folder, "sweep_results").where("epochs IS NOT NULL").select("epochs").distinct().orderBy("epochs")


@query("SELECT sample_id, row_index, snvq FROM featuremap WHERE filt = 1 AND snvq >= 60 AND NOT isnan(snvq)")
def scan_project_filter(spark, folder):
    """SRC-02, PRJ-01: projection and predicate reach the scan."""
    return scan(table(spark, folder, "featuremap"), ["sample_id", "row_index", "snvq"], "filt = 1 AND snvq >= 60 AND NOT isnan(snvq)")


@query("SELECT row_index FROM embedding ORDER BY row_index LIMIT 20")
def ordered_limit(spark, folder):
    """TOP-01, TOP-02, SRC-12: a preview is what the limit is for."""
    return scan(table(spark, folder, "embedding"), ["row_index"], None, 20, ["row_index"])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE filt = 1) AS n_passed FROM featuremap")
def row_counts(spark, folder):
    """SRC-03."""
    return table(spark, folder, "featuremap").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("filt") == 1).alias("n_passed"))


@query("SELECT st, count(*) AS n_rows, count(snvq) FILTER (WHERE NOT isnan(snvq)) AS n_values FROM featuremap WHERE filt = 1 GROUP BY st")
def batch_scan(spark, folder):
    """SRC-04, STR-01: a Python function over Arrow batches, its partial sums added up."""

    def part(frames):
        for f in frames:
            yield f.assign(n_rows=1, n_values=f["snvq"].notna().astype("int64")).groupby("st", dropna=False, as_index=False)[["n_rows", "n_values"]].sum()

    rows = scan(table(spark, folder, "featuremap"), ["st", "snvq"], "filt = 1")
    return rows.mapInPandas(part, "st string, n_rows bigint, n_values bigint").groupBy("st").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))

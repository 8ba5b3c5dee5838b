"""The pN_ queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import plain, plain_sql
from ..operators.latest import latest, latest_sql
from ..session import by_value
from ..sources.tables import table
from . import clusters, fixed_sample, leakage, neighbours, packing, proportions, quantile_sketch, residue, stable_sample, survivors
from .hashing import random_key_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- Problem 1: fixed-size sample ---------------------------------------------------------

SAMPLE_SEED = 42
SAMPLE_COLUMNS = ["row_index", "loaded_at", "chrom", "pos", "batch_no"]


def _newest(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: latest(df, "row_index", "loaded_at", columns)


def _fixed_sql(size: int) -> str:
    return f"""
        SELECT row_index, {plain_sql("chrom")} AS chrom, pos, batch_no
        FROM ({latest_sql("featuremap", "row_index", "loaded_at", SAMPLE_COLUMNS)})
        ORDER BY {random_key_sql(SAMPLE_SEED, "row_index")}, row_index LIMIT {size}"""


def _fixed(spark: SparkSession, folder: str, size: int) -> DataFrame:
    rows = table(spark, folder, "featuremap")
    sample = fixed_sample.fixed_size_sample(rows, "row_index", size, SAMPLE_SEED, _newest(SAMPLE_COLUMNS))
    return sample.select("row_index", plain(F.col("chrom")).alias("chrom"), "pos", "batch_no")


@query(_fixed_sql(25_000))
def p1_fixed_size_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _fixed(spark, folder, 25_000)


@query(_fixed_sql(1_000))
def p1_fixed_size_sample_small(spark: SparkSession, folder: str) -> DataFrame:
    return _fixed(spark, folder, 1_000)


#: Deliveries that p1_sample_by_piece takes as one piece.
PIECE_DAYS = 30


@query(f"SELECT row_index FROM (SELECT DISTINCT row_index FROM featuremap WHERE row_index IS NOT NULL) ORDER BY {random_key_sql(SAMPLE_SEED, 'row_index')}, row_index LIMIT 2000")
def p1_sample_by_piece(spark: SparkSession, folder: str) -> DataFrame:
    """The batches come one after another, each read once; how many there will be is not used."""
    piece = F.coalesce(F.floor(F.col("batch_no") / PIECE_DAYS), F.lit(0)).cast("int").alias("piece")
    rows = by_value(table(spark, folder, "featuremap").select("row_index", piece), "piece")
    numbers = sorted(r["piece"] for r in rows.select("piece").distinct().collect())
    return fixed_sample.sample_pieces((rows.where(F.col("piece") == i) for i in numbers), "row_index", 2_000, SAMPLE_SEED)


# --- Problem 2: target proportions --------------------------------------------------------

CONTEXT = ["ref_base", "alt_base", "x_prev1", "x_next1"]


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every observation with its sample and context in one spelling."""
    rows = latest(table(spark, folder, "featuremap"), "row_index", "loaded_at", ["row_index", "loaded_at", "sample_id", *CONTEXT])
    return rows.select("row_index", "sample_id", *[plain(F.col(c)).alias(c) for c in CONTEXT])


def _proportions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return proportions.proportional_sample(
        observations(spark, folder), table(spark, folder, "context_targets"), "request_id", "sample_id", "row_index",
        CONTEXT, "sample_rows", "target_share", "min_rows", seed=7,
    )


_SUPPLY_SQL = f"""
    SELECT t.request_id, t.ref_base, t.alt_base, t.x_prev1, t.x_next1, coalesce(n, 0) AS available,
           greatest(CAST(floor(t.target_share * t.sample_rows + 0.5) AS BIGINT), CAST(t.min_rows AS BIGINT)) AS wanted
    FROM context_targets t LEFT JOIN (
        SELECT sample_id, {", ".join(f"{plain_sql(c)} AS {c}" for c in CONTEXT)}, count(*) AS n
        FROM ({latest_sql("featuremap", "row_index", "loaded_at", ["row_index", "loaded_at", "sample_id", *CONTEXT])})
        GROUP BY ALL) s
    USING (sample_id, ref_base, alt_base, x_prev1, x_next1)"""


@query(f"SELECT request_id, ref_base, alt_base, x_prev1, x_next1 FROM ({_SUPPLY_SQL}) WHERE available < wanted")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    _, report = _proportions(spark, folder)
    return report.where(F.col("shortfall") > 0).select("request_id", *CONTEXT)


@query(f"SELECT request_id, ref_base, alt_base, x_prev1, x_next1, wanted, CAST(available AS BIGINT) AS available, CAST(greatest(wanted - available, 0) AS BIGINT) AS shortfall FROM ({_SUPPLY_SQL})")
def p2_shortfalls(spark: SparkSession, folder: str) -> DataFrame:
    """What every context wants, has and lacks in the drawn sample."""
    return _proportions(spark, folder)[1].select("request_id", *CONTEXT, "wanted", "available", "shortfall")


@query()
def p2_proportional_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _proportions(spark, folder)[0]


@query()
def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return _proportions(spark, folder)[1].withColumns({c: F.round(c, 9) for c in ("weight", "share_gap")})


# --- Problem 4: survivors -----------------------------------------------------------------

LOCUS = ["chrom", "pos", "ref_base", "alt_base"]
RANKS = ["snvq", "qual", "mapq", "dp", "raw_vaf"]
SURVIVOR_COLUMNS = ["row_index", "loaded_at", *LOCUS, *RANKS, "observed_at", "st"]
#: Trust in an observation by its strand tag; others count 1.
TRUST = {"MIXED": 1.0, "PLUS": 0.8, "MINUS": 0.8}
OTHER_TRUST = 0.5
HALF_LIFE_DAYS = 30.0
_USABLE_SQL = {c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" for c in ("snvq", "qual", "raw_vaf")} | {
    "mapq": "CASE WHEN mapq = 255 THEN NULL ELSE mapq END", "dp": "CASE WHEN dp < 0 THEN NULL ELSE dp END"
}


def _usable() -> dict[str, F.Column]:
    number = {c: F.when(~F.isnan(c), F.col(c)) for c in ("snvq", "qual", "raw_vaf")}
    return number | {"mapq": F.when(F.col("mapq") != 255, F.col("mapq")), "dp": F.when(F.col("dp") >= 0, F.col("dp"))}


def loci(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The newest rows that lie on a locus, with unusable values as null."""
    rows = latest(table(spark, folder, "featuremap"), "row_index", "loaded_at", columns)
    rows = rows.withColumns({c: plain(F.col(c)) for c in ("chrom", "ref_base", "alt_base")})
    rows = rows.withColumns({c: v for c, v in _usable().items() if c in columns})
    bases = ["A", "C", "G", "T", "N"]
    return rows.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("ref_base").isin(bases) & F.col("alt_base").isin(bases))


_LOCI_SQL = f"""
    SELECT row_index, observed_at, st, {plain_sql("chrom")} AS chrom, pos, {plain_sql("ref_base")} AS ref_base, {plain_sql("alt_base")} AS alt_base,
           {", ".join(f"{v} AS {c}" for c, v in _USABLE_SQL.items())}
    FROM ({latest_sql("featuremap", "row_index", "loaded_at", SURVIVOR_COLUMNS)})
    WHERE chrom IS NOT NULL AND pos IS NOT NULL AND {plain_sql("ref_base")} IN ('A','C','G','T','N') AND {plain_sql("alt_base")} IN ('A','C','G','T','N')"""
_RANK_SQL = "snvq DESC NULLS LAST, qual DESC NULLS LAST, mapq DESC NULLS LAST, dp DESC NULLS LAST, raw_vaf DESC NULLS LAST, row_index"
_FOUND4_SQL = f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref_base, alt_base ORDER BY {_RANK_SQL}) AS rn FROM ({_LOCI_SQL}))
    SELECT arg_min(row_index, rn) AS survivor_row,
           coalesce(arg_min(row_index, rn) FILTER (WHERE mapq IS NOT NULL), -1) AS mapq_row,
           coalesce(arg_min(row_index, rn) FILTER (WHERE dp IS NOT NULL), -1) AS dp_row
    FROM r GROUP BY chrom, pos, ref_base, alt_base HAVING count(*) > 1"""


@query(_FOUND4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = loci(spark, folder, ["row_index", "loaded_at", *LOCUS, *RANKS])
    row = F.col("row_index")
    fields = [survivors.Field("survivor_row", row, True), survivors.Field("mapq_row", F.when(F.col("mapq").isNotNull(), row), True), survivors.Field("dp_row", F.when(F.col("dp").isNotNull(), row), True)]
    best = survivors.survivors(rows, LOCUS, "row_index", fields, [F.col(c) for c in RANKS])
    missing = {c: F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("mapq_row", "dp_row")}
    return best.where(F.col("n_records") > 1).withColumns(missing).select("survivor_row", "mapq_row", "dp_row")


_NEWEST = "2027-01-01 00:00:00"


@query(f"""
    WITH r AS (SELECT *, CASE st WHEN 'MIXED' THEN 1.0 WHEN 'PLUS' THEN 0.8 WHEN 'MINUS' THEN 0.8 ELSE {OTHER_TRUST} END
                 * coalesce(pow(0.5, (epoch_us(TIMESTAMP '{_NEWEST}') - epoch_us(observed_at)) / 86400000000.0 / {HALF_LIFE_DAYS}), 1.0) AS vote,
                 CASE WHEN observed_at IS NULL OR st IS NULL THEN 1 ELSE 0 END AS unknown FROM ({_LOCI_SQL})),
    l AS (SELECT chrom, pos, ref_base, alt_base, row_index, CASE WHEN unknown = 1 THEN 1.0 ELSE vote END AS vote,
                 unnest([0, 1, 2]) AS field, unnest([round(snvq, 1), CAST(mapq AS DOUBLE), CAST(dp AS DOUBLE)]) AS value FROM r),
    v AS (SELECT chrom, pos, ref_base, alt_base, field, value, round(sum(vote), 9) AS votes, arg_max(row_index, (vote, -row_index)) AS best FROM l WHERE value IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref_base, alt_base, field ORDER BY votes DESC, best) AS rn FROM v),
    n AS (SELECT chrom, pos, ref_base, alt_base, count(*) AS n_records FROM r GROUP BY ALL)
    SELECT n.chrom, n.pos, n.ref_base, n.alt_base, n_records, max(value) FILTER (WHERE field = 0) AS snvq, max(value) FILTER (WHERE field = 1) AS mapq, max(value) FILTER (WHERE field = 2) AS dp
    FROM n LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (chrom, pos, ref_base, alt_base) GROUP BY ALL""")  # fmt: skip
def p4_best_values(spark: SparkSession, folder: str) -> DataFrame:
    """One record per locus whose snvq, mapq and dp have the most trusted and recent votes."""
    rows = loci(spark, folder, SURVIVOR_COLUMNS)
    trust = F.when(F.col("st").isNull(), F.lit(None))
    for tag, weight in TRUST.items():
        trust = trust.when(F.col("st") == tag, weight)
    vote = trust.otherwise(OTHER_TRUST) * survivors.decay(F.col("observed_at"), F.lit(_NEWEST).cast("timestamp"), HALF_LIFE_DAYS)
    fields = [survivors.Field("snvq", F.round("snvq", 1)), *[survivors.Field(c, F.col(c).cast("double")) for c in ("mapq", "dp")]]
    return survivors.survivors(rows, LOCUS, "row_index", fields, [F.coalesce(vote, F.lit(1.0))])


# --- Problem 5: stable sample -------------------------------------------------------------

#: Positions chosen of each block of 1,024.
CHOSEN = 8


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_config").select("run_id", F.coalesce("data_seed", "seed").alias("seed"))


@query(f"""
    WITH s AS (SELECT DISTINCT coalesce(data_seed, seed) AS seed FROM training_config WHERE coalesce(data_seed, seed) IS NOT NULL),
    r AS (SELECT DISTINCT row_index FROM featuremap WHERE row_index IS NOT NULL),
    p AS (SELECT seed, b, b * {stable_sample.BLOCK} + {stable_sample.positions_sql("seed", "b", "j")} AS row_index
          FROM s, (SELECT DISTINCT row_index // {stable_sample.BLOCK} AS b FROM r), (SELECT unnest(range({CHOSEN})) AS j))
    SELECT seed, row_index FROM p JOIN r USING (row_index)""")
def p5_stable_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The members of every seed's sample; a run's sample is that of its seed."""
    return stable_sample.stable_sample(table(spark, folder, "featuremap"), "row_index", _seeds(spark, folder), CHOSEN)


# --- Problem 6: percentiles ---------------------------------------------------------------

ERROR = 0.01
SHARES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
SKETCH_COLUMNS = ["row_index", "loaded_at", "batch_no", "x_prev1", "x_next1", "snvq"]
#: Deliveries that make one combined window.
WINDOW_BATCHES = 7


def snvq_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """One sketch per delivery and flank pair."""
    rows = latest(table(spark, folder, "featuremap"), "row_index", "loaded_at", SKETCH_COLUMNS)
    rows = rows.withColumns({c: plain(F.col(c)) for c in ("x_prev1", "x_next1")})
    return quantile_sketch.sketch(rows, ["batch_no", "x_prev1", "x_next1"], "snvq", ERROR)


_SKETCH_SQL = f"""
    SELECT batch_no, {plain_sql("x_prev1")} AS x_prev1, {plain_sql("x_next1")} AS x_next1, {quantile_sketch.bucket_sql("snvq", ERROR)} AS bucket
    FROM ({latest_sql("featuremap", "row_index", "loaded_at", SKETCH_COLUMNS)})"""
_PERCENTILE_SQL = ", ".join(
    f"round({quantile_sketch.bucket_value_sql(f'q[{i + 1}]', ERROR)}, 6) AS p{round(100 * s, 2):g}" for i, s in enumerate(SHARES)
)


def _percentiles_sql(scope: str) -> str:
    """Ranks the buckets of single rows, without any cumulated counts."""
    positions = ", ".join(f"b[1 + CAST(floor((len(b) - 1) * {s}::DOUBLE) AS BIGINT)]" for s in SHARES)
    return f"""
        SELECT scope, x_prev1, x_next1, n, n_missing, {_PERCENTILE_SQL} FROM (
            SELECT *, [{positions}] AS q FROM (
                SELECT scope, x_prev1, x_next1, count(bucket) AS n, count(*) - count(bucket) AS n_missing, list_sort(list(bucket) FILTER (WHERE bucket IS NOT NULL)) AS b
                FROM (SELECT {scope} AS scope, x_prev1, x_next1, bucket FROM ({_SKETCH_SQL})) GROUP BY ALL))"""


@query(_percentiles_sql(f"unnest(['all', 'batch ' || coalesce(CAST(batch_no AS VARCHAR), '?'), 'window ' || coalesce(CAST(batch_no // {WINDOW_BATCHES} AS VARCHAR), '?')])"))
def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per flank pair over all deliveries, each delivery, and windows of seven, all from one set of sketches."""
    batch = F.coalesce(F.col("batch_no").cast("string"), F.lit("?"))
    window = F.coalesce(F.floor(F.col("batch_no") / WINDOW_BATCHES).cast("string"), F.lit("?"))
    scopes = F.array(F.lit("all"), F.concat(F.lit("batch "), batch), F.concat(F.lit("window "), window))
    sketches = snvq_sketches(spark, folder).select(F.explode(scopes).alias("scope"), "x_prev1", "x_next1", "bucket", "n")
    found = quantile_sketch.percentiles(sketches, ["scope", "x_prev1", "x_next1"], SHARES, ERROR)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c[1:].isdigit()})  # in units of snvq, for the comparison with SQL


# --- Problem 8: containers ----------------------------------------------------------------


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text")


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


@query()
def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@query()
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    used = F.sum("n_tokens").alias("n_tokens")
    filled = _packed(spark, folder).where(F.col("container").isNotNull()).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), used)
    return filled.withColumn("left_over", packing.CAPACITY - F.col("n_tokens"))


# --- Problem 9: leaked evaluation texts ---------------------------------------------------


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return leakage.leaked(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "text")


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder).select("item_id", "doc_id")


@query()
def p9_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with its documents and the closest and longest passage."""
    pairs = _leaked(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("n_words"), F.min("edits").alias("edits"))
    return pairs.join(table(spark, folder, "benchmark").select("item_id", "suite"), "item_id")


# --- Problem 10: residue ------------------------------------------------------------------


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


@query()
def p10_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text")


@query()
def p10_templates(spark: SparkSession, folder: str) -> DataFrame:
    """All mined templates, each classified once."""
    rows = residue.mined(table(spark, folder, "documents"), "doc_id", "text", everything=True)
    return residue.templates(rows).groupBy("merged", "verdict").agg(F.sum("n").alias("n_segments"))


# --- Problem 7: nearest records -----------------------------------------------------------

MAP = ["umap_1", "umap_2"]


def _neighbours(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, folder, "analysis"), "run_id", "row_index", MAP, k)


_KNN_SQL = """
    SELECT a.run_id, a.row_index, b.row_index AS neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d,
           row_number() OVER (PARTITION BY a.run_id, a.row_index ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.row_index) AS rank
    FROM p a JOIN p b ON a.run_id = b.run_id AND a.row_index <> b.row_index"""
_POINTS_SQL = """p AS (SELECT DISTINCT run_id, row_index, CAST(umap_1 AS DOUBLE) AS x, CAST(umap_2 AS DOUBLE) AS y FROM analysis
    WHERE umap_1 IS NOT NULL AND umap_2 IS NOT NULL AND NOT isnan(umap_1) AND NOT isnan(umap_2) AND row_index IS NOT NULL AND run_id IS NOT NULL)"""


@query(f"""WITH {_POINTS_SQL}, n AS (SELECT * FROM ({_KNN_SQL}) WHERE rank <= 3)
    SELECT a.row_index AS row_a, a.neighbour AS row_b FROM n a JOIN n b
    ON a.run_id = b.run_id AND a.row_index = b.neighbour AND a.neighbour = b.row_index WHERE a.row_index < a.neighbour""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    near = _neighbours(spark, folder, 3)
    pair = [F.least("row_index", "neighbour").alias("row_a"), F.greatest("row_index", "neighbour").alias("row_b")]
    both = near.select("run_id", *pair).groupBy("run_id", "row_a", "row_b").count().where(F.col("count") == 2)
    return both.select("row_a", "row_b")


@query(f"WITH {_POINTS_SQL} SELECT run_id, row_index, CAST(rank AS INT) AS rank, neighbour, round(sqrt(d), 6) AS distance FROM ({_KNN_SQL}) WHERE rank <= 10")
def p7_nearest_records(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest records of each, as trustworthiness presupposes."""
    return _neighbours(spark, folder, 10).withColumn("distance", F.round("distance", 6))


# --- Problem 3: similarity groups ---------------------------------------------------------

REACH = 0.2
LEAST_MEMBERS = 5
TYPICAL = 5


def _groups(spark: SparkSession, folder: str) -> clusters.Clustering:
    return clusters.similarity_groups(table(spark, folder, "analysis"), "run_id", "row_index", *MAP, REACH, LEAST_MEMBERS)


#: Spreads the names of records without a smaller neighbour over the links; the least one to arrive names the group.
_NAMED3_SQL = f"""
    WITH RECURSIVE {_POINTS_SQL},
    e AS (SELECT a.run_id, a.row_index AS a, b.row_index AS b FROM p a JOIN p b ON a.run_id = b.run_id AND a.row_index <> b.row_index
          AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {REACH} * {REACH}),
    r AS (SELECT run_id, row_index AS root, row_index AS node FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = p.run_id AND e.a = p.row_index AND e.b < e.a)
          UNION SELECT r.run_id, r.root, e.b FROM r JOIN e ON r.run_id = e.run_id AND r.node = e.a),
    g AS (SELECT run_id, node, min(root) AS row_a FROM r GROUP BY ALL),
    k AS (SELECT run_id, row_a, count(*) AS size FROM g GROUP BY ALL HAVING count(*) >= {LEAST_MEMBERS})"""
_FOUND3_SQL = f"{_NAMED3_SQL} SELECT row_a, node AS row_b FROM g JOIN k USING (run_id, row_a) WHERE node <> row_a"


@query(_FOUND3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest id of a group is that of its smallest cell, which names the group."""
    members = _groups(spark, folder).members
    return members.where(F.col("id") != F.col("cluster")).select(F.col("cluster").alias("row_a"), F.col("id").alias("row_b"))


@query(f"{_NAMED3_SQL} SELECT run_id, row_a AS first_row, size FROM k")
def p3_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).groups.withColumnsRenamed({"grp": "run_id", "cluster": "first_row"})


@query()
def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group with its size and most typical members."""
    return clusters.typical(_groups(spark, folder), TYPICAL).withColumnsRenamed({"grp": "run_id", "cluster": "first_row"})

"""Problems 1, 2, 4, 5 and 6 against brute force and at their edges."""

import hashlib
import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import fixed_sample, proportions, quantile_sketch, stable_sample, survivors
from strandloom.llm.hashing import random_key


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


# --- 1 ---


def test_fixed_sample_is_the_smallest_keys(spark):
    df = spark.range(3_000).unionAll(spark.range(500)).withColumn("key", F.lit("x"))
    keys = {r[0]: r[1] for r in spark.range(3_000).select("id", random_key(5, F.col("id"))).collect()}
    want = sorted(sorted(keys, key=lambda i: (keys[i], i))[:200])
    for parts in (1, 7):
        got = fixed_sample.fixed_size_sample(df.repartition(parts), "id", 200, 5)
        assert got.columns == ["id", "key"] and ids(got) == want


def test_fixed_sample_edges(spark):
    df = spark.createDataFrame([(None, 1), (4, 1), (4, 2), (5, 1)], "id bigint, key int")
    assert ids(fixed_sample.fixed_size_sample(df, "id", 10, 1)) == [4, 5]
    assert len(ids(fixed_sample.fixed_size_sample(df, "id", 1, 1))) == 1
    assert ids(fixed_sample.fixed_size_sample(df, "id", 0, 1)) == []
    assert ids(fixed_sample.fixed_size_sample(df.limit(0), "id", 3, 1)) == []


def test_bounds_are_rarely_wrong_and_retried(spark):
    for size, n in ((1, 10), (50, 100), (1_000, 1_000_000)):
        accept, reject = fixed_sample.bounds(size, n, 1e-6)
        assert 0 <= accept < size / n < reject <= 1
    sample = spark.range(2_000)
    # Bounds this narrow fail and must be widened until the size is right.
    last = fixed_sample.cutoff(sample, "id", 100, 2_000, 9, failure=0.999)
    assert sample.where(fixed_sample.inside("id", 9, last)).count() == 100


def test_every_id_is_equally_likely(spark):
    hits = Counter()
    for seed in range(40):
        hits.update(ids(fixed_sample.fixed_size_sample(spark.range(100), "id", 20, seed)))
    assert sum(hits.values()) == 800 and max(hits.values()) < 22 and len(hits) == 100


def test_pieces_give_the_whole_sample(spark):
    pieces = [spark.range(a, a + 700) for a in (0, 500, 1_000, 4_000)] + [spark.createDataFrame([(None,)], "id bigint")]
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionAll(p)
    assert ids(fixed_sample.sample_pieces(iter(pieces), "id", 60, 3)) == ids(fixed_sample.fixed_size_sample(whole, "id", 60, 3))
    assert ids(fixed_sample.sample_pieces(iter(pieces[:1]), "id", 5_000, 3)) == list(range(700))


# --- 2 ---

CATEGORIES = ["a", "b"]


def drawn(spark, rows, targets):
    r = spark.createDataFrame(rows, "s string, id bigint, a string, b string, weight double")
    t = spark.createDataFrame(targets, "req bigint, s string, n bigint, a string, b string, share double, least int, available int")
    sample, report = proportions.proportional_sample(r, t, "req", "s", "id", CATEGORIES, "n", "share", "least", 3)
    return [tuple(x) for x in sample.select("req", "id", "a", "b").collect()], {(x["req"], x["a"], x["b"]): x.asDict() for x in report.collect()}


@pytest.mark.parametrize("few", [0, 100_000])
def test_shares_minimums_and_gaps(spark, monkeypatch, few):
    monkeypatch.setattr(proportions, "_BROADCAST", few)
    rows = [("s", i, "A" if i % 4 else "C", "G" if i % 2 else "T", 1.0) for i in range(4_000)] + [("s", 9_000, "N", "T", 1.0), ("s", None, "A", "G", 1.0), ("s", 9_001, None, None, 1.0)]
    targets = [(1, "s", 100, "A", "G", 0.5, 2, 0), (1, "s", 100, "C", "T", 0.3, 2, 0), (1, "s", 100, "N", "T", 0.2, 2, 0), (1, "s", 100, "A", "T", 0.0, 3, 0), (2, "s", 10, "A", "G", 1.0, 0, 0), (3, "none", 10, "A", "G", 1.0, 1, 0), (None, "s", 5, "A", "G", 1.0, 1, 0)]
    sample, report = drawn(spark, rows, targets)
    assert (report[1, "N", "T"]["wanted"], report[1, "N", "T"]["drawn"], report[1, "N", "T"]["shortfall"]) == (20, 1, 19)
    assert report[1, "A", "T"]["drawn"] >= 3 and report[1, "A", "G"]["drawn"] >= 50 and report[1, "C", "T"]["drawn"] >= 30
    assert sum(1 for x in sample if x[0] == 1) == 100  # the missing rows are made up for by others
    assert sum(1 for x in sample if x[0] == 2) == 10 and report[3, "A", "G"]["shortfall"] == 10
    assert len(set(sample)) == len(sample) and all(r is not None for r, *_ in sample)


def test_proportions_of_nothing(spark):
    sample, report = drawn(spark, [], [(1, "s", 10, "A", "G", None, None, 0), (2, "s", None, "A", "G", 1.0, 2, 0), (3, "s", 5, None, "G", 1.0, 0, 0)])
    assert sample == [] and report[1, "A", "G"]["shortfall"] == 0 and report[2, "A", "G"]["shortfall"] == 2 and report[3, None, "G"]["shortfall"] == 5
    assert drawn(spark, [("s", 1, "A", "G", 1.0)], []) == ([], {})


def test_raking_meets_feasible_margins():
    rng = np.random.default_rng(0)
    target, available = rng.random(12) * 50, np.full(12, 1_000.0)
    fields = [np.arange(12) % 3, np.arange(12) // 3]
    fitted = proportions.rake(available, target, fields)
    assert np.allclose(np.bincount(fields[0], fitted), np.bincount(fields[0], target), rtol=1e-6)
    capped = proportions.rake(np.array([5.0, 100, 100, 100]), np.array([20.0, 20, 20, 20]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])])
    assert capped[0] <= 5 and capped[1] > 20


def test_rows_within_a_category_are_equally_likely(spark):
    sample, _ = drawn(spark, [("s", i, "A", "G", 1.0) for i in range(1_000)], [(1, "s", 300, "A", "G", 1.0, 0, 0)])
    assert len(sample) == 300 and 400 < np.mean([x[1] for x in sample]) < 600


# --- 4 ---


def test_votes_by_trust_and_age(spark):
    rows = [("l", 1, 5.0, 1.0, None), ("l", 2, 7.0, 0.4, 9.0), ("l", 3, 7.0, 0.4, None), ("m", 4, 1.0, None, None), (None, 5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id bigint, v double, vote double, value double").withColumn("order", F.lit(0)).withColumn("field", F.lit("z"))
    best = survivors.survivors(df, ["g"], "id", [survivors.Field("v", F.col("v")), survivors.Field("w", F.col("value"))], [F.col("vote")])
    assert {r["g"]: (r["n_records"], r["v"], r["w"]) for r in best.collect()} == {"l": (3, 5.0, 9.0), "m": (1, 1.0, None)}
    tie = survivors.survivors(df.where("id IN (2, 3)"), ["g"], "id", [survivors.Field("id_", F.col("id"), True)])
    assert tie.first()["id_"] == 2
    assert survivors.survivors(df.limit(0), ["g"], "id", [survivors.Field("v", F.col("v"))]).count() == 0
    day = spark.sql("SELECT timestamp'2026-01-01' AS a, timestamp'2026-01-31' AS b")
    assert day.select(survivors.decay(F.col("a"), F.col("b"), 30.0)).first()[0] == 0.5


def test_hot_group_of_ranked_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id", (F.col("id") % 1_000).alias("q"))
    best = survivors.survivors(df, ["g"], "id", [survivors.Field("row", F.col("id"), True)], [F.col("q")])
    hot = best.where("g = 'hot'").first()
    assert (hot["n_records"], hot["row"]) == (6_667, 999)


def test_votes_one_after_another(spark):
    """A ranking as votes: summed per value it gives what the single voters of a record id give."""
    rng = np.random.default_rng(8)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [("abc"[i % 3] + str(i % 40), i, pick(None, 1.0, 2.0, 2.5), pick(None, 3.0, 4.0)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id bigint, a double, b double")
    fields = lambda own: [survivors.Field("row", F.col("id"), own), survivors.Field("with_b", F.when(F.col("b").isNotNull(), F.col("id")), own)]
    got = [sorted(map(tuple, survivors.survivors(df, ["g"], "id", fields(own), [F.col("a"), F.col("b")]).collect())) for own in (True, False)]
    best = lambda g, ok: max((r for r in rows if r[0] == g and ok(r)), key=lambda r: (r[2] or 0, r[3] or 0, -r[1]), default=(0, None))[1]
    want = sorted((g, sum(r[0] == g for r in rows), best(g, lambda r: True), best(g, lambda r: r[3] is not None)) for g in {r[0] for r in rows})
    assert got[0] == got[1] == want


# --- 5 ---


def test_positions_are_a_fair_choice(spark):
    drawn = lambda n, k: stable_sample.positions(spark.range(n), F.md5(F.col("id").cast("string")), k)
    chosen = [r["p"] for r in drawn(400, 8).groupBy("id").agg(F.collect_list("position").alias("p")).collect()]
    assert all(len(set(p)) == 8 and 0 <= min(p) and max(p) < stable_sample.BLOCK for p in chosen)
    tenths = Counter(x * 16 // stable_sample.BLOCK for p in chosen for x in p)
    assert len(tenths) == 16 and sum((n - 200) ** 2 / 200 for n in tenths.values()) < 45
    assert ids(drawn(1, stable_sample.BLOCK), "position") == list(range(stable_sample.BLOCK))


def test_members_stay_as_data_grow(spark):
    seeds = spark.createDataFrame([(1,), (2,), (2,), (None,)], "seed int")
    pick = lambda df: {tuple(r) for r in stable_sample.stable_sample(df, "id", seeds, 8).collect()}
    small, large = pick(spark.range(5_000)), pick(spark.range(9_000).repartition(5).union(spark.range(10)))
    assert small < large and {x for x in large if x[1] < 5_000} == small
    assert {s for s, _ in large} == {1, 2} and 8 * 8 <= sum(s == 1 for s, _ in large) <= 9 * 8
    odd = spark.createDataFrame([(None,), (-1,), (-1_500,)], "id bigint")
    assert all(i in (-1, -1_500) for _, i in pick(odd)) and pick(odd.limit(0)) == set() and pick(odd.where("id IS NULL")) == set()


# --- 6 ---


def test_percentiles_within_the_error(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(1, 2, 3_000), -rng.lognormal(0, 1, 500), np.zeros(200), np.full(900, 37.0)])
    df = spark.createDataFrame([("g", i % 3, float(v)) for i, v in enumerate(values)], "g string, day int, v double")
    parts = quantile_sketch.sketch(df, ["g", "day"], "v").withColumn("extra", F.lit(1))
    shares = (0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0)
    row = quantile_sketch.percentiles(parts, ["g"], shares).first()
    ordered = np.sort(values)
    for s, got in zip(shares, row[3:]):
        true = ordered[math.floor(s * (len(ordered) - 1))]
        assert abs(got - true) <= 0.01 * abs(true) + 1e-6
    whole = quantile_sketch.percentiles(quantile_sketch.sketch(df, ["g"], "v"), ["g"], shares).first()
    assert whole == row


def test_percentile_edges(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), ("b", float("inf")), ("b", float("-inf")), ("b", 1.0), (None, 2.0)], "g string, v double").withColumn("n", F.lit(9))
    got = {r["g"]: r for r in quantile_sketch.percentiles(quantile_sketch.sketch(df, ["g"], "v"), ["g"], (0.0, 0.5, 1.0)).collect()}
    assert (got["a"]["n"], got["a"]["n_missing"], got["a"]["p50"]) == (0, 2, None)
    assert (got["b"]["p0"], got["b"]["p100"]) == (float("-inf"), float("inf")) and abs(got["b"]["p50"] - 1) <= 0.01 + 1e-9
    assert abs(got[None]["p50"] - 2) < 0.02
    assert quantile_sketch.percentiles(quantile_sketch.sketch(df.limit(0), ["g"], "v"), ["g"], (0.5,)).count() == 0


@pytest.mark.parametrize("error", [0.1, 0.01, 1e-4, 1e-6])
def test_percentile_guarantee_over_the_range_of_doubles(spark, error):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([10.0 ** rng.uniform(-300, 300, 400), 10.0 ** rng.uniform(-9, -6, 100), [3e-7, 4e-7, 5e-7, 1e-9, 1e300, 1.7976931348623157e308, 2.2250738585072014e-308]])
    values = np.concatenate([sizes, -sizes, [0.0, math.inf, -math.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)
    shares = tuple(float(s) for s in rng.random(60)) + (0.0, 0.5, 1.0)
    row = quantile_sketch.percentiles(quantile_sketch.sketch(df, [], "v", error), [], shares, error).first()
    for s, got in zip(shares, row[2:]):
        true = ordered[math.floor(s * (len(ordered) - 1))]
        assert got == true or abs(got - true) <= error * (1 + 1e-6) * abs(true), (s, got, true)


def test_small_median_is_not_rounded_away(spark):
    df = spark.createDataFrame([(3e-7,), (4e-7,), (5e-7,)], "v double")
    assert abs(quantile_sketch.percentiles(quantile_sketch.sketch(df, [], "v"), [], (0.5,)).first()["p50"] - 4e-7) <= 4e-9 * 1.001
    with pytest.raises(ValueError):
        quantile_sketch.gamma(1e-7)


def test_stable_sample_of_scattered_ids(spark):
    ids = [0, 1, 5, 1_023, 10**8, 10**15, 10**15 + 7, 4 * 10**18, -3]
    df = spark.createDataFrame([(i,) for i in ids], "row bigint")
    seeds = spark.createDataFrame([(i,) for i in range(150)], "seed int")
    got = {(r["seed"], r["row"]) for r in stable_sample.stable_sample(df, "row", seeds, 512).collect()}
    assert len(got) == stable_sample.stable_sample(df.union(df), "row", seeds, 512).count() and {r for _, r in got} == set(ids)
    some = stable_sample.stable_sample(df.where("row < 10"), "row", seeds, 512).collect()
    assert {(r["seed"], r["row"]) for r in some} == {(s, r) for s, r in got if r < 10}
    assert abs(len(got) / (150 * len(ids)) - 0.5) < 0.06


def test_digest_is_taken_once_a_block(spark):
    seeds = spark.createDataFrame([(7,), (2**31 - 1,), (-4,)], "seed int")
    got = stable_sample.stable_sample(spark.range(3_000), "id", seeds, 8)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    want = set()
    for seed, block, j in product((7, 2**31 - 1, -4), range(3), range(8)):
        digest = hashlib.md5(f"{seed}:{block}".encode()).hexdigest()
        k = [int(digest[4 * i : 4 * i + 4], 16) for i in range(6)]
        for i in (0, 2, 4):
            j = (j * (2 * k[i] + 1) + k[i + 1]) % stable_sample.BLOCK
            j ^= (j >> stable_sample.BITS // 2) * (i < 4)
        want |= {(seed, block * stable_sample.BLOCK + j)} if block * stable_sample.BLOCK + j < 3_000 else set()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want

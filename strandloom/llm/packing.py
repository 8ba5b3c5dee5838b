"""Problem 8: filling fixed-capacity containers with documents.

Method: bulk-synchronous best fit. In each round documents and gaps are sorted into
ranges of their size. Within a range a task sweeps from the largest document down to
the smallest, each to its successor, the smallest gap that holds it. What stays without a gap
there is ranked, and so are the gaps left; from the counts per range alone, runs of ranks
are matched with the nearest higher range that has gaps, as many documents to a gap as
surely fit. Ranks settle who goes where, so no gap is promised twice. The gaps are then
updated, and the next round begins, until no document is left.

Containers open as the total size demands: as many as the lower bound asks for, and more
only when a round can place nothing. A document above half the capacity has one of its own at first.

Ranges follow the counts per size, so they do not depend on the partitioning; a size that
has more than ``_RANGE`` documents is salted over several tasks. What reaches the driver are
counts per size (at most twice the capacity) and per task.

A document above the capacity is cut into full pieces and a rest; every other one
stays whole. Defined cases: null and empty texts have no tokens and no container
(null); documents that repeat an id are placed each on its own; an empty table
gives no rows; texts of any length are counted whole; numbers of containers start at 0, and a
few may stay unused.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions, spread

CAPACITY = 2_048
#: The vocabulary of ``public_tokenizers`` that counts where no file is named.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Documents and gaps that one task sweeps.
_RANGE = 20_000


def token_counts(df: DataFrame, text: str, ranks: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` of a public byte-level BPE vocabulary, 0 for null."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(VOCABULARY), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        for part in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return df.withColumn("n_tokens", count(F.col(text)))


def ranges(counts: dict[int, int], wide: int) -> list[tuple[int, int, int, int]]:
    """(size, number of its range, least size of the range, tasks of the range), ranges from the largest size down."""
    out, own, held = [], [], 0
    for size in [*sorted(counts, reverse=True), None]:
        more = counts.get(size, 0)
        if own and (size is None or held + more > wide):
            number = out[-1][1] + 1 if out else 0
            out += [(s, number, own[-1], max(1, -(-held // wide))) for s in own]
            own, held = [], 0
        if size is not None:
            own.append(size)
            held += more
    return out


def sweep(sizes: np.ndarray, gaps: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit within a range: per document, which are sorted from the largest down, the place
    of its gap or -1; and what is left of each gap. Gaps below ``low`` hold no document of the range."""
    order = np.argsort(gaps, kind="stable")
    size, place = gaps[order].tolist(), order.tolist()
    left, target = gaps.copy(), np.full(len(sizes), -1, np.int64)
    for i, s in enumerate(sizes.tolist()):
        at = bisect.bisect_left(size, s)
        if at == len(size):
            continue
        gap, to = size.pop(at), place.pop(at)
        target[i], left[to] = to, gap - s
        if gap - s >= low:
            back = bisect.bisect_left(size, gap - s)
            size.insert(back, gap - s)
            place.insert(back, to)
    return target, left


def runs(cells: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Matches ranks of documents with ranks of gaps in higher ranges.

    ``cells``: (range, salt, documents, greatest of them, gaps, least of them), ranges from the largest sizes
    down. Gives (range, salt, first rank, end rank, range, salt and first rank of the gaps, documents per gap)."""
    out, free, new, last = [], [], [], None
    for number, salt, documents, greatest, gaps, least in sorted(cells):
        if number != last:
            free, new, last = free + new, [], number
        done = 0
        while done < documents and free:
            top = free[-1]
            each = max(1, top["least"] // greatest)
            placed = min(documents - done, each * top["n"])
            out.append((number, salt, done, done + placed, top["number"], top["salt"], top["first"], each))
            taken = -(-placed // each)
            top["first"], top["n"], done = top["first"] + taken, top["n"] - taken, done + placed
            if not top["n"]:
                free.pop()
        if gaps:
            new.append({"number": number, "salt": salt, "first": 0, "n": gaps, "least": least})
    return out


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """``key``, ``piece``, ``n_pieces``, ``from_token``, ``n_tokens``, ``container``."""
    spark = df.sparkSession
    counted = cut_lineage(token_counts(spread(df.select(F.col(key), F.col(text).alias("_text"))), "_text", ranks).select(F.col(key).cast("string").alias("id"), "n_tokens"))  # as text: a null would make numbers inexact in pandas
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    items = counted.withColumn("n_pieces", pieces).select("id", "n_pieces", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    items = items.withColumn("from_token", F.col("piece").cast("bigint") * capacity)
    items = items.withColumn("size", F.least(F.col("n_tokens") - F.col("from_token"), F.lit(capacity)).cast("bigint"))
    fields = ["id", "piece", "n_pieces", "from_token", "size"]
    kinds = dict(items.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in fields), "container bigint", "gap bigint", "number int", "salt int", "rank bigint"])

    def within(part: pd.DataFrame) -> pd.DataFrame:
        of_gap, low = part["gap"].notna().to_numpy(), int(part["low"].iloc[0])
        part = part.reset_index(drop=True)
        spaces = part[of_gap].sort_values("container").index.to_numpy()
        own = part[~of_gap].sort_values(["size", "id", "piece"], ascending=[False, True, True]).index.to_numpy()
        value = part["value"].to_numpy(np.int64)
        names = np.zeros(len(part), np.int64)
        names[spaces] = part["container"].to_numpy()[spaces].astype(np.int64)
        target, left = sweep(value[own], value[spaces], low)
        rank, gap = np.full(len(part), -1, np.int64), np.zeros(len(part), np.int64)
        fits, usable = target >= 0, left >= low
        names[own[fits]] = names[spaces[target[fits]]]
        rank[own[~fits]] = np.arange((~fits).sum())
        rank[spaces[usable]] = np.arange(usable.sum())
        gap[spaces] = left
        nowhere = np.zeros(len(part), bool)
        nowhere[own[~fits]] = True
        part = part.assign(container=pd.arrays.IntegerArray(names, nowhere), gap=pd.arrays.IntegerArray(gap, ~of_gap), rank=rank)
        return part[[*fields, "container", "gap", "number", "salt", "rank"]]

    placed = [items.where("size = 0").select(*fields, F.lit(None).cast("bigint").alias("container"))]
    left = items.where("size > 0").select(*fields)
    gaps = spark.createDataFrame([], "container bigint, gap bigint")
    opened, stuck = 0, False
    while True:
        half = F.count_if(F.col("size") > capacity // 2)
        total, number, large = left.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), half).first()
        if not number:
            break
        free = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
        new = max(0, -(-(total - free) // capacity))
        if stuck or not opened:
            new = max(new, -(-total // capacity), large)
        gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("container"), F.lit(capacity).cast("bigint").alias("gap")))
        opened += new

        both = left.select(*fields, F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("gap"))
        both = both.unionByName(gaps, allowMissingColumns=True).withColumn("value", F.coalesce("gap", "size"))
        counts = {r["value"]: r["count"] for r in both.groupBy("value").count().collect()}  # at most twice the capacity
        table = spark.createDataFrame(ranges(counts, _RANGE), "value bigint, number int, low bigint, salts int")
        cells = both.join(F.broadcast(table), "value")  # a row per size, so at most ``capacity``
        cells = cells.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "container"), F.col("salts")).cast("int"))
        swept = cells.repartition(partitions(spark), "number", "salt").groupBy("number", "salt").applyInPandas(within, schema)
        swept = cut_lineage(swept)
        documents, spaces = swept.where("gap IS NULL"), swept.where("gap IS NOT NULL")
        here = documents.where("container IS NOT NULL").select(*fields, "container")

        per_cell = swept.where("rank >= 0 AND (gap IS NOT NULL OR container IS NULL)").groupBy("number", "salt").agg(
            F.count_if(F.col("gap").isNull()), F.max(F.when(F.col("gap").isNull(), F.col("size"))), F.count("gap"), F.min("gap")
        )
        plan = spark.createDataFrame(
            runs([tuple(r) for r in per_cell.collect()]), "number int, salt int, first bigint, end bigint, to_number int, to_salt int, to_first bigint, each bigint"
        )
        open_ = documents.where("container IS NULL").drop("container", "gap").alias("d")
        match = (F.col("d.number") == F.col("p.number")) & (F.col("d.salt") == F.col("p.salt")) & (F.col("d.rank") >= F.col("p.first")) & (F.col("d.rank") < F.col("p.end"))
        aimed = open_.join(plan.alias("p"), match, "left")
        aim = (F.col("to_first") + F.floor((F.col("d.rank") - F.col("first")) / F.col("each"))).alias("to_rank")
        aimed = aimed.select(*[F.col(f"d.{c}") for c in fields], "to_number", "to_salt", aim)
        named = spaces.where("rank >= 0").select(F.col("number").alias("to_number"), F.col("salt").alias("to_salt"), F.col("rank").alias("to_rank"), "container")
        aimed = cut_lineage(aimed.join(named, ["to_number", "to_salt", "to_rank"], "left").select(*fields, "container"))
        there = aimed.where("container IS NOT NULL")
        taken = there.groupBy("container").agg(F.sum("size").alias("taken"))
        gaps = spaces.select("container", "gap").join(taken, "container", "left").select("container", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0")
        gaps = cut_lineage(gaps)
        placed += [here, there]
        left = aimed.where("container IS NULL").select(*fields)
        stuck = left.count() == number
    return reduce(DataFrame.unionByName, placed).select(F.col("id").cast(df.schema[key].dataType).alias(key), "piece", "n_pieces", "from_token", F.col("size").alias("n_tokens"), "container")

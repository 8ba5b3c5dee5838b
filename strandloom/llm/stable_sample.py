"""Problem 5: a reproducible sample that keeps its members as data grow.

Method: randomised block selection. Sequence numbers are cut into fixed blocks
of ``BLOCK``; a digest of seed and block number predetermines which ``chosen``
positions of a block are in the sample, whether or not rows fill them yet. The
positions are the images of 0, 1, ... under a permutation of the block keyed by the
digest (odd multiples, sums and shifted bits, each of which can be undone), so exactly
``chosen`` of each block are picked and each position is equally likely. A row's membership depends on its
number and the seed only.

The data side is read once for one column and folded, before any shuffle, into
one bit per position (1,024 bits a block). Only blocks that hold rows meet the seeds, in
lists of ``_LISTED`` seeds, by an equi-join on the number of the list and a salt of the block: what
is shuffled is a row per block and list, a small share of the result.

Defined cases: null numbers are in no block; repeated numbers count once;
negative numbers fall into negative blocks; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions

BITS = 10
BLOCK = 1 << BITS
_WORDS = BLOCK // 64
#: Seeds in one list.
_LISTED = 64


def _keys(digest: Column) -> list[Column]:
    """Six numbers of 16 bits from the first 24 digits, read in two halves."""
    # Never null: of nullable keys the planner demands that they be set, below the explosion, and there takes the digest again for each.
    halves = [F.coalesce(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("bigint"), F.lit(0).cast("bigint")) for i in range(2)]
    return [F.shiftright(halves[i // 3], 32 - 16 * (i % 3)).bitwiseAND(F.lit(65_535).cast("bigint")).cast("int").alias(f"_k{i}") for i in range(6)]


def positions(df: DataFrame, digest: Column, chosen: int) -> DataFrame:
    """A row for each of the ``chosen`` positions of each row's block, in column ``position``."""
    keyed = df.withColumn("_digest", digest).select(*df.columns, *_keys(F.col("_digest")))
    x = F.explode(F.sequence(F.lit(0), F.lit(chosen - 1))).alias("_j")
    keyed = keyed.select("*", x)
    place = F.col("_j")
    for i in (0, 2, 4):
        place = (place * (F.col(f"_k{i}") * 2 + 1) + F.col(f"_k{i + 1}")).bitwiseAND(F.lit(BLOCK - 1))
        if i < 4:
            place = place.bitwiseXOR(F.shiftright(place, BITS // 2))
    return keyed.select(*df.columns, place.alias("position"))


def positions_sql(seed: str, block: str, j: str) -> str:
    """The position number ``j`` of a block as SQL text for DuckDB."""
    digest = f"md5(CAST({seed} AS VARCHAR) || ':' || CAST({block} AS VARCHAR))"
    key = [f"CAST(('0x' || substr({digest}, {1 + 4 * i}, 4)) AS BIGINT)" for i in range(6)]
    query = f"SELECT {j} AS x"
    for i in (0, 2, 4):
        query = f"SELECT (x * (2 * {key[i]} + 1) + {key[i + 1]}) % {BLOCK} AS x FROM ({query})"
        if i < 4:
            query = f"SELECT xor(x, x // {1 << BITS // 2}) AS x FROM ({query})"
    return f"(SELECT x FROM ({query}))"


def filled_blocks(df: DataFrame, number: str) -> DataFrame:
    """``block`` and ``filled``, an array of 64-bit words with a bit per position."""
    n = F.col(number)
    offset = n.bitwiseAND(F.lit(BLOCK - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{number}` & 63 AS INT))")
    word = F.shiftright(offset, 6)
    words = [F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{w}") for w in range(_WORDS)]
    blocks = df.where(n.isNotNull()).groupBy(F.shiftright(n, BITS).alias("block")).agg(*words)
    return blocks.select("block", F.array(*[f"_w{w}" for w in range(_WORDS)]).alias("filled"))


def stable_sample(df: DataFrame, number: str, seeds: DataFrame, chosen: int) -> DataFrame:
    """``seed`` and ``number`` of the members of each seed's sample.

    ``seeds`` has one column ``seed``. Each seed meets each block that holds rows
    once, which is in proportion to the result (``chosen`` rows of a full block).
    """
    if not 0 < chosen <= BLOCK:
        raise ValueError(f"chosen must be from 1 to {BLOCK}")
    runs = seeds.select("seed").where(F.col("seed").isNotNull()).distinct()
    lists = max(1, -(-runs.count() // _LISTED))
    salts = partitions(df.sparkSession)
    held = runs.groupBy(F.pmod(F.xxhash64("seed"), F.lit(lists)).alias("_list")).agg(F.collect_list("seed").alias("_seeds"))  # about _LISTED
    held = held.select("_list", "_seeds", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    blocks = filled_blocks(df, number).select("*", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("_salt"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lists - 1).cast("bigint"))).alias("_list"))
    # A number is given as the planner would put the few bytes of the blocks, from which much grows, into one task.
    blocks, held = blocks.repartition(salts, "_list", "_salt"), held.repartition(salts, "_list", "_salt")
    # Far more rows come out than the planner expects of so few lists; they must not be broadcast.
    met = blocks.join(held.hint("shuffle_hash"), ["_list", "_salt"]).select("block", "filled", F.explode("_seeds").alias("seed"))
    drawn = positions(met, F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("block").cast("string"))), chosen)
    there = F.getbit(F.element_at("filled", F.shiftright("position", 6) + 1), F.col("position") % 64) == 1
    return drawn.where(there).select("seed", (F.col("block") * BLOCK + F.col("position")).alias(number))

"""Problem 3: groups of mutually similar records, with their typical members.

Method: power-iteration spectral clustering. Records are gathered in grid cells so
small that all records of a cell are similar; cells are the nodes of a sparse graph,
linked where a record of one is within ``reach`` of a record of the other. The
affinities are normalised to a lazy random walk; several vectors are iterated until
they settle, which they do at one place per group, and k-means on the embedding
they form gives the groups. Members are ranked by their affinity to their own group.

The vectors are distributed over tiles of cells. Where a tile's share has settled, its
clusters become nodes of a coarser graph, and the iteration goes on over wider tiles,
until no link leaves a tile. A task holds a tile: at most ``_TILE`` squared cells, and then
clusters that reach the border of one of ``_WIDER`` squared tiles, whatever the records.

An exact check follows in every tile: a cluster that a link leaves, or in which links do not
lead from one member to all, is mended along its links. Two records are thus in one
group exactly if steps of at most ``reach`` lead from one to the other.

Nothing depends on the number of records in a cell: links are decided on bounding
boxes and the records at their ends, refined sixteenfold per axis only where these leave it open, down to single
coordinates.

Defined cases: a row with a null, NaN or infinite coordinate is left out, as are null
groups and ids; a coordinate beyond ``FARTHEST``, where single-precision numbers are 64 apart, is
similar only to one that equals it; an id repeated within a group counts once, with its
greatest coordinates; equal coordinates are similar; an empty table gives no groups;
groups below ``least`` members are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions

FARTHEST = 1e9
_SPLIT = 16
_TILE = 32
_WIDER = 16
_PLACE = ["ax", "ay", "bx", "by"]
VECTORS = 4
#: Vectors have settled when a turn moves them by less than this.
SETTLED = 1e-10
#: Nodes up to which the walk is squared; turns of squaring, and of single steps for more nodes.
DENSE, DOUBLINGS, STEPS = 1_024, 40, 4_096
#: Side of the boxes in which k-means puts its first centres.
BOX = 1e-6
LLOYD = 2


@dataclass
class Clustering:
    """``members``: grp, id, cluster (smallest id of the group), mended (by the exact check), affinity.
    ``groups``: grp, cluster, size."""

    members: DataFrame
    groups: DataFrame


def _boxes(points: DataFrame, *by: Column) -> DataFrame:
    return points.groupBy("grp", *by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


#: Per cell: the records at its left, right, lower and upper end.
_ENDS = (("x0", "yx0"), ("x1", "yx1"), ("xy0", "y0"), ("xy1", "y1"))


def _cells(points: DataFrame, *by: Column) -> DataFrame:
    """Boxes with the records at their ends."""
    ends = {"yx0": F.min_by("y", "x"), "yx1": F.max_by("y", "x"), "xy0": F.min_by("x", "y"), "xy1": F.max_by("x", "y")}
    return points.groupBy("grp", *by).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *[c.alias(e) for e, c in ends.items()],
    )


def _ends_meet(a: str, b: str, limit: float) -> Column:
    """Whether a record at an end of one cell is within reach of one at an end of the other."""
    def square(p: tuple[str, str], q: tuple[str, str]) -> Column:
        dx, dy = (F.col(f"{a}.{m}") - F.col(f"{b}.{n}") for m, n in zip(p, q))
        return dx * dx + dy * dy

    return F.least(*[square(p, q) for p in _ENDS for q in _ENDS]) <= limit


def _level(axis: str, side: float, level: int) -> Column:
    return F.floor(F.col(axis) / side * float(_SPLIT**level)).cast("bigint")


def _least(a: str, b: str) -> Column:
    gap = lambda v: F.greatest(F.col(f"{b}.{v}0") - F.col(f"{a}.{v}1"), F.col(f"{a}.{v}0") - F.col(f"{b}.{v}1"), F.lit(0.0))
    return gap("x") * gap("x") + gap("y") * gap("y")


def _most(a: str, b: str) -> Column:
    span = lambda v: F.greatest(F.col(f"{a}.{v}1") - F.col(f"{b}.{v}0"), F.col(f"{b}.{v}1") - F.col(f"{a}.{v}0"))
    return span("x") * span("x") + span("y") * span("y")


def _decide(parts: Iterator[pd.DataFrame], limit: float) -> Iterator[pd.DataFrame]:
    """Each pair of lists of boxes: linked, or the pairs of boxes that leave it open."""
    for part in parts:
        rows = []
        for grp, a, b, left, right in zip(part["grp"], part["a"], part["b"], part["left"], part["right"]):
            p, q = left.reshape(-1, 1, 6), right.reshape(1, -1, 6)
            gx = np.maximum(np.maximum(q[..., 0] - p[..., 1], p[..., 0] - q[..., 1]), 0)
            gy = np.maximum(np.maximum(q[..., 2] - p[..., 3], p[..., 2] - q[..., 3]), 0)
            sx = np.maximum(p[..., 1] - q[..., 0], q[..., 1] - p[..., 0])
            sy = np.maximum(p[..., 3] - q[..., 2], q[..., 3] - p[..., 2])
            if (sx * sx + sy * sy <= limit).any():
                rows.append((grp, a, b, True, 0, 0, 0, 0))
                continue
            for i, j in zip(*np.nonzero(gx * gx + gy * gy <= limit)):
                rows.append((grp, a, b, False, *(int(v) for v in (*p[i, 0, 4:], *q[0, j, 4:]))))
        yield pd.DataFrame(rows, columns=["grp", "a", "b", "linked", "ax", "ay", "bx", "by"])


def links(points: DataFrame, cells: DataFrame, side: float, reach: float) -> DataFrame:
    """``grp``, ``a``, ``b``: cells (by their smallest ids) with records within ``reach`` of each other."""
    limit = reach * reach
    steps = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])).alias("step")
    box = ["x0", "x1", "y0", "y1", "yx0", "yx1", "xy0", "xy1"]
    left = cells.select("grp", "low", "cx", "cy", *box, step).withColumns({"tx": F.col("cx") + F.col("step.dx"), "ty": F.col("cy") + F.col("step.dy")})
    right = cells.select("grp", "low", "cx", "cy", *box)
    met = left.alias("l").join(right.alias("r"), (F.col("l.grp") == F.col("r.grp")) & (F.col("tx") == F.col("r.cx")) & (F.col("ty") == F.col("r.cy")))
    pairs = met.where(_least("l", "r") <= limit).select(
        F.col("l.grp").alias("grp"), F.col("l.low").alias("a"), F.col("r.low").alias("b"), ((_most("l", "r") <= limit) | _ends_meet("l", "r", limit)).alias("linked"),
        F.col("l.cx").alias("ax"), F.col("l.cy").alias("ay"), F.col("r.cx").alias("bx"), F.col("r.cy").alias("by"),
    )
    pairs = cut_lineage(pairs)
    found = pairs.where("linked").select("grp", "a", "b")
    level = 0
    while (left_open := pairs.where("not linked")).count():
        level += 1
        keys = left_open.select("grp", F.col("ax").alias("px"), F.col("ay").alias("py")).union(left_open.select("grp", "bx", "by")).distinct()
        near = points.withColumns({"px": _level("x", side, level - 1), "py": _level("y", side, level - 1)}).join(keys, ["grp", "px", "py"], "left_semi")
        near = near.withColumns({"ix": _level("x", side, level), "iy": _level("y", side, level)})
        parts = _boxes(near, F.col("px"), F.col("py"), F.col("ix"), F.col("iy"))
        flat = F.array("x0", "x1", "y0", "y1", F.col("ix").cast("double"), F.col("iy").cast("double"))
        lists = parts.groupBy("grp", "px", "py").agg(F.flatten(F.collect_list(flat)).alias("boxes"))  # at most _SPLIT squared boxes
        both = left_open.select("grp", "a", "b", "ax", "ay", "bx", "by")
        both = both.join(lists.select("grp", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("boxes").alias("left")), ["grp", "ax", "ay"])
        both = both.join(lists.select("grp", F.col("px").alias("bx"), F.col("py").alias("by"), F.col("boxes").alias("right")), ["grp", "bx", "by"])
        tried = both.select("grp", "a", "b", "left", "right").mapInPandas(lambda p: _decide(p, limit), "grp string, a bigint, b bigint, linked boolean, ax bigint, ay bigint, bx bigint, by bigint")
        tried = cut_lineage(tried)
        new = tried.where("linked").select("grp", "a", "b").distinct()
        found = found.unionByName(new)
        pairs = tried.where("not linked").join(new, ["grp", "a", "b"], "left_anti")
    return found


def start_vectors(nodes: np.ndarray) -> np.ndarray:
    """Uniform numbers from the names of the nodes, the same in every run and partitioning."""
    v = nodes.astype(np.uint64)[:, None] + (np.arange(1, VECTORS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return (v ^ (v >> np.uint64(31))) / 2.0**64


def power_iteration(a: np.ndarray, b: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The vectors ``start`` after as many steps of the lazy walk over the links ``a``-``b``
    with affinities ``w`` as they take to settle.

    Few nodes: the walk is squared, so that each turn doubles the steps. Many: step by step."""
    m = len(start)
    if m <= DENSE:
        walk = np.zeros((m, m))
        np.add.at(walk, (a, b), w)
        walk += walk.T
        walk = walk / (2 * walk.sum(1, keepdims=True)) + np.eye(m) / 2
        state = walk @ start
        for _ in range(DOUBLINGS):
            walk = walk @ walk
            walk /= walk.sum(1, keepdims=True)
            last, state = state, walk @ start
            if np.abs(state - last).max() < SETTLED:
                break
        return state
    at, to, p = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    p = p / (2 * np.bincount(at, p, m))[at]
    state = start
    for turn in range(STEPS):
        last = state
        state = state / 2 + np.stack([np.bincount(at, p * v[to], m) for v in state.T], 1)
        if turn % 16 == 15 and np.abs(state - last).max() < SETTLED:
            break
    return state


def k_means(embedding: np.ndarray) -> np.ndarray:
    """The number of each node's cluster. A centre starts in every box of side ``BOX`` that
    holds a node, so there are as many as there are places where the vectors settled."""
    _, first, label = np.unique(np.round(embedding / BOX), axis=0, return_index=True, return_inverse=True)
    label = label.ravel()
    centres = embedding[first]
    for _ in range(LLOYD):
        step = max(1, 4_000_000 // len(centres))
        for i in range(0, len(embedding), step):
            label[i : i + step] = ((embedding[i : i + step, None, :] - centres[None, :, :]) ** 2).sum(-1).argmin(1)
        _, label = np.unique(label, return_inverse=True)
        size = np.bincount(label)
        centres = np.stack([np.bincount(label, v) / size for v in embedding.T], 1)
    return label


def doubtful(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which nodes lie in a cluster that a link leaves, or whose links do not reach all of it from its first node."""
    across = label[a] != label[b]
    _, first = np.unique(label, return_index=True)
    reached = np.zeros(len(label), bool)
    reached[first] = True
    p, q = a[~across], b[~across]
    while True:
        new = np.concatenate([q[reached[p] & ~reached[q]], p[reached[q] & ~reached[p]]])
        if not len(new):
            break
        reached[new] = True
    bad = np.zeros(int(label.max()) + 1, bool)
    bad[label[a[across]]] = bad[label[b[across]]] = True
    bad[label[~reached]] = True
    return bad[label]


def mended(label: np.ndarray, a: np.ndarray, b: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """Doubtful clusters cut where no link holds them together, and joined where one does."""
    parent = np.arange(len(label))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i in np.flatnonzero(doubt[a]):
        ra, rb = root(a[i]), root(b[i])
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    own = np.array([root(v) for v in np.flatnonzero(doubt)], dtype=label.dtype)
    out = label + len(label)
    out[doubt] = own
    return out


def settle(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, repair: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For linked ``nodes`` (links by place) the least node of each one's cluster, and which were mended."""
    label = k_means(power_iteration(a, b, w, start_vectors(nodes)))
    doubt = doubtful(label, a, b) if repair else np.zeros(len(nodes), bool)
    if doubt.any():
        label = mended(label, a, b, doubt)
    _, label = np.unique(label, return_inverse=True)
    least = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    return least[label], doubt


def _tile(part: pd.DataFrame, repair: bool) -> pd.DataFrame:
    nodes, ends = np.unique(part[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    cluster, doubt = settle(nodes, ends[:, 0], ends[:, 1], part["w"].to_numpy(float), repair)
    return pd.DataFrame({"grp": part["grp"].iloc[0], "node": nodes, "part": cluster, "mended": doubt})


def spectral_parts(ends: DataFrame, repair: bool = True) -> DataFrame:
    """``grp``, ``low``, ``part`` (the least node of its cluster) and ``mended`` of every linked node.

    ``ends`` has the links ``a``-``b`` with affinity ``w`` and the cells of both ends. The
    vectors are spread over tiles of cells; each task iterates its share until it settles,
    and a settled cluster goes on as one node, linked to others by the affinities summed
    between them, over tiles ``_WIDER`` times as wide, until no link leaves a tile. Tiles
    of the next level are shifted by half their side, so that in the end one holds all."""
    spark = ends.sparkSession
    tile = lambda c: F.floor(F.col(c) / _TILE).cast("bigint")
    level = ends.select("grp", "a", "b", "w", *[tile(c).alias(c) for c in _PLACE])
    parts = None
    while True:
        within = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        # Heavy work on few rows: the planner would put it into two tasks.
        inside = level.where(within).repartition(partitions(spark), "grp", "ax", "ay")
        made = inside.groupBy("grp", "ax", "ay").applyInPandas(lambda p: _tile(p, repair), "grp string, node bigint, part bigint, mended boolean")
        made = cut_lineage(made)
        if parts is None:
            parts = made.withColumnRenamed("node", "low")
        else:
            upper = made.select("grp", F.col("node").alias("part"), F.col("part").alias("_up"), F.col("mended").alias("_mended"))
            parts = parts.join(upper, ["grp", "part"], "full").select(
                "grp", F.coalesce("low", "part").alias("low"), F.coalesce("_up", "part").alias("part"), (F.coalesce("mended", F.lit(False)) | F.coalesce("_mended", F.lit(False))).alias("mended")
            )
        crossing = level.where(~within)
        for e in "ab":
            crossing = crossing.join(made.select("grp", F.col("node").alias(e), F.col("part").alias(f"p{e}")), ["grp", e], "left")
        crossing = crossing.select("grp", F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "w", *[F.floor((F.col(c) + _WIDER // 2) / _WIDER).cast("bigint").alias(c) for c in _PLACE])
        level = cut_lineage(crossing.groupBy("grp", "a", "b", *_PLACE).agg(F.sum("w").alias("w")))
        if level.isEmpty():
            return parts


def similarity_groups(df: DataFrame, group: str, key: str, x: str, y: str, reach: float, least: int, repair: bool = True) -> Clustering:
    """``repair=False`` leaves the clusters of the embedding as they are."""
    value = lambda c: F.col(c).cast("double")
    usable = F.col(group).isNotNull() & F.col(key).isNotNull()
    for c in (x, y):
        usable &= value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))
    points = df.where(usable).select(F.col(group).cast("string").alias("grp"), F.col(key).alias("id"), (value(x) + 0.0).alias("x"), (value(y) + 0.0).alias("y"))
    points = points.groupBy("grp", "id").agg(F.max(F.struct("x", "y")).alias("v")).select("grp", "id", "v.x", "v.y")
    # Far coordinates become part of the group's name; within such a group they are all the same.
    far = {c: F.abs(c) > FARTHEST for c in "xy"}
    names = [F.when(far[c], F.col(c).cast("string")).otherwise("") for c in "xy"]
    points = cut_lineage(points.select(F.concat_ws("|", *names, "grp").alias("grp"), "id", *[F.when(far[c], 0.0).otherwise(F.col(c)).alias(c) for c in "xy"]))

    side = reach / math.sqrt(2) * (1 - 1e-9)
    here = {"cx": _level("x", side, 0), "cy": _level("y", side, 0)}
    cells = cut_lineage(_cells(points.withColumns(here), F.col("cx"), F.col("cy")))
    ends = links(points, cells, side, reach)
    for e in "ab":
        ends = ends.join(cells.select("grp", F.col("low").alias(e), F.col("cx").alias(f"{e}x"), F.col("cy").alias(f"{e}y"), F.col("n").alias(f"n{e}"), F.col("mx").alias(f"x{e}"), F.col("my").alias(f"y{e}")), ["grp", e])
    square = F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)
    weight = F.sqrt(F.col("na").cast("double") * F.col("nb")) * F.exp(-square / (2 * reach * reach))
    ends = cut_lineage(ends.select("grp", "a", "b", *_PLACE, weight.alias("w")))

    parts = spectral_parts(ends, repair)
    degree = ends.select("grp", F.explode(F.array("a", "b")).alias("low"), "w").groupBy("grp", "low").agg(F.sum("w").alias("degree"))
    nodes = cells.select("grp", "low", "cx", "cy", "n", "mx", "my").join(parts, ["grp", "low"], "left").join(degree, ["grp", "low"], "left")
    nodes = cut_lineage(nodes.select(
        "grp", "low", "cx", "cy", "n", "mx", "my", (F.coalesce("degree", F.lit(0.0)) + F.col("n")).alias("degree"),
        F.coalesce("part", "low").alias("cluster"), F.coalesce("mended", F.lit(False)).alias("mended"),
    ))
    sizes = nodes.groupBy("grp", "cluster").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    kept = nodes.join(sizes, ["grp", "cluster"])
    of = points.withColumns(here).join(kept, ["grp", "cx", "cy"])
    square = F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)
    affinity = F.col("degree") / F.sqrt(F.col("n")) * F.exp(-square / (2 * reach * reach))
    own = F.regexp_replace("grp", r"^[^|]*\|[^|]*\|", "").alias("grp")
    return Clustering(of.select(own, "id", "cluster", "mended", affinity.alias("affinity")), sizes.select(own, "cluster", "size"))


def typical(clustering: Clustering, count: int) -> DataFrame:
    """Each group with its size and its ``count`` members of the greatest affinity."""
    by = Window.partitionBy("grp", "cluster").orderBy(F.col("affinity").desc(), "id")
    top = clustering.members.withColumn("place", F.row_number().over(by)).where(F.col("place") <= count)
    lists = top.groupBy("grp", "cluster").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("top"))
    return clustering.groups.join(lists, ["grp", "cluster"]).select("grp", "cluster", "size", F.array_join(F.transform("top", lambda t: t["id"].cast("string")), " ").alias("typical"))

"""Problem 7: the k most similar vectors for every vector.

Method: a hierarchical navigable small-world graph per shard, stored as flat
neighbour arrays, with shard results merged. Shards are ranges of a space-filling
order within a group, of about ``SHARD`` vectors each, so a group of any size is
spread over many shards. A vector first searches its own shard; the distance of its
k-th neighbour there bounds what can still be nearer, so it is sent only to shards
whose box comes closer than that. These are found by descent through a tree of boxes (``_FAN``
consecutive shards make a box of the next level), by equi-joins on its nodes; a shard
asks with the reach of all its vectors but the ``_APART`` farthest, which ask for themselves, so
one outlier does not open every shard. A shard that many others ask is searched by several tasks. Every search ends with an exact check: all vectors
of the shard within the distance that the graph found are compared, which makes the
result exact (``exact=False`` leaves the graph's answer as it is).

Equal vectors are one node that carries its k + 1 smallest ids: a vector that a
third of all rows share is one node, and its rows take their result from it.

Similar means near in Euclidean distance, computed in double precision; at equal
distance the smaller id is nearer. Defined cases: a row with a null, NaN or infinite
coordinate is left out; an id repeated within a group counts once, with its greatest
coordinates; a group of n ids gives at most n - 1 neighbours each; an empty table
gives no rows; null groups and ids are left out.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARD = 4_096
LINKS = 8
BEAM_BUILD = 24
BEAM = 24
_WAVE = 512
_BRUTE = 512
#: Boxes in a box of the next level of the tree over shards.
_FAN = 32
#: Vectors of a shard with the greatest radii, which look for other shards on their own.
_APART = 8
#: Shards in one list of destinations, and shards whose vectors one task takes.
_LISTED, _ASKED = 256, 64


def _squares(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the points numbered ``a`` and ``b``, broadcast."""
    return _square(points[a] - points[b])


def _square(gap: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", gap, gap)


def _spread_out(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, distance: np.ndarray, links: int) -> np.ndarray:
    """The links of each node ``of``: nearest candidates first, leaving out one that is
    nearer to a chosen link than to the node; places left over go to the nearest. -1 pads."""
    rows, width = candidates.shape
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    chosen = np.full((rows, links), -1, np.int32)
    count = np.zeros(rows, np.int64)
    taken = ~np.isfinite(distance)
    step = max(1, 4_000_000 // (width * width * points.shape[1]))
    for a in range(0, rows, step):
        own = points[candidates[a : a + step]]
        # Whether candidate j is nearer to candidate c than to the node.
        near = _square(own[:, :, None, :] - own[:, None, :, :]) < distance[a : a + step, None, :]
        shut = taken[a : a + step].copy()
        for c in range(width):
            at = np.flatnonzero(~shut[:, c] & (count[a : a + step] < links))
            chosen[a + at, count[a + at]] = candidates[a + at, c]
            count[a + at] += 1
            taken[a + at, c] = True
            shut[at] |= near[at, c]
    for c in range(width):
        at = np.flatnonzero(~taken[:, c] & (count < links))
        chosen[at, count[at]] = candidates[at, c]
        count[at] += 1
    return chosen


class Layer:
    """One level of the graph: a row of ``neighbours`` per node, -1 padded."""

    def __init__(self, points: np.ndarray, links: int):
        self.points, self.links = points, links
        self.neighbours = np.full((len(points), links), -1, np.int32)

    def search(self, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: node numbers and squared
        distances, nearest first, padded with -1 and infinity."""
        n = len(queries)
        nodes = np.full((n, beam), -1, np.int64)
        distance = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        nodes[:, 0], done[:, 0] = start, False
        distance[:, 0] = _square(self.points[start] - queries)
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], np.inf, distance[active])
            pick = open_.argmin(axis=1)
            live = np.isfinite(open_[np.arange(len(active)), pick])
            active, pick = active[live], pick[live]
            if not len(active):
                break
            done[active, pick] = True
            near = self.neighbours[nodes[active, pick]].astype(np.int64)
            seen = (near[:, :, None] == nodes[active][:, None, :]).any(-1) | (near < 0)
            d = _square(self.points[np.maximum(near, 0)] - queries[active][:, None, :])
            d = np.where(seen, np.inf, d)
            useful = (d < distance[active, -1][:, None]).any(axis=1)
            if not useful.any():
                continue
            at = active[useful]
            all_d = np.concatenate([distance[at], d[useful]], 1)
            all_n = np.concatenate([nodes[at], near[useful]], 1)
            all_f = np.concatenate([done[at], np.zeros_like(seen[useful])], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            distance[at] = np.take_along_axis(all_d, keep, 1)
            nodes[at] = np.where(np.isfinite(distance[at]), np.take_along_axis(all_n, keep, 1), -1)
            done[at] = np.take_along_axis(all_f, keep, 1) | ~np.isfinite(distance[at])
        return nodes, distance

    def connect(self, new: np.ndarray, candidates: np.ndarray, distance: np.ndarray) -> None:
        """Link ``new`` nodes to the best of their candidates, and those back to them."""
        self.neighbours[new] = _spread_out(self.points, new, candidates, distance, self.links)
        source = np.repeat(new, self.links)
        target = self.neighbours[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, number = np.unique(target, return_index=True, return_counts=True)
        width = int(number.max())
        back = np.full((len(nodes), width), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), number)
        back[row, np.arange(len(target)) - first[row]] = source
        old = self.neighbours[nodes].astype(np.int64)
        back[(back[:, :, None] == old[:, None, :]).any(-1)] = -1
        both = np.concatenate([old, back], 1)
        d = np.where(both >= 0, _squares(self.points, nodes[:, None], np.maximum(both, 0)), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        both, d = np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1)
        size = np.isfinite(d).sum(1)
        self.neighbours[nodes] = both[:, : self.links]
        # Those with too many are thinned out, with others of about as many.
        below = self.links
        while below < int(size.max()):
            above = below + self.links // 2
            at = np.flatnonzero((size > below) & (size <= above))
            if len(at):
                self.neighbours[nodes[at]] = _spread_out(self.points, nodes[at], np.maximum(both[at, :above], 0), d[at, :above], self.links)
            below = above


class Graph:
    """A hierarchical navigable small-world graph over the rows of ``points``.

    Nodes are kept in an order in which every upper layer is a prefix."""

    def __init__(self, points: np.ndarray, links: int = LINKS, seed: int = 0):
        n = len(points)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.points = np.ascontiguousarray(points[self.order], dtype=float)
        sizes, size = [n], int((level >= 1).sum())
        while size > 32:
            sizes.append(size)
            size = int((level >= len(sizes)).sum())
        self.layers: list[Layer] = []
        for place in range(len(sizes) - 1, -1, -1):
            layer = Layer(self.points[: sizes[place]], 2 * links if place == 0 else links)
            self._build(layer)
            self.layers.append(layer)

    def _start(self, queries: np.ndarray) -> np.ndarray:
        """The nearest node found on the layers above; they are done."""
        at = np.zeros(len(queries), np.int64)
        for layer in self.layers:
            at = layer.search(queries, at, 4)[0][:, 0]
        return at

    def _build(self, layer: Layer) -> None:
        n = len(layer.points)
        done = min(n, max(_BRUTE, len(self.layers[-1].points) if self.layers else 0))
        if done > 4 * _BRUTE:
            done = _BRUTE
        self._among(layer, np.arange(done))
        while done < n:
            new = np.arange(done, min(n, done + min(_WAVE, done)))
            queries = layer.points[new]
            start = self._start(queries) if self.layers and len(self.layers[-1].points) <= done else np.zeros(len(new), np.int64)
            nodes, distance = layer.search(queries, start, BEAM_BUILD)
            own = _square(queries[:, None, :] - queries[None, :, :])
            np.fill_diagonal(own, np.inf)
            width = min(layer.links, len(new) - 1)
            if width > 0:
                best = np.argpartition(own, width - 1, axis=1)[:, :width]
                nodes = np.concatenate([nodes, new[best]], 1)
                distance = np.concatenate([distance, np.take_along_axis(own, best, 1)], 1)
            layer.connect(new, np.maximum(nodes, 0), distance)
            done += len(new)

    @staticmethod
    def _among(layer: Layer, nodes: np.ndarray) -> None:
        if len(nodes) < 2:
            return
        p = layer.points[nodes]
        d = _square(p[:, None, :] - p[None, :, :])
        np.fill_diagonal(d, np.inf)
        width = min(3 * layer.links, len(nodes) - 1)
        best = np.argpartition(d, width - 1, axis=1)[:, :width]
        layer.connect(nodes, nodes[best], np.take_along_axis(d, best, 1))

    def search(self, queries: np.ndarray, count: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        beam = max(beam, count + 8)
        at = np.zeros(len(queries), np.int64)
        for layer in self.layers[:-1]:
            at = layer.search(queries, at, 4)[0][:, 0]
        nodes, distance = self.layers[-1].search(queries, at, beam)
        return nodes[:, :count], distance[:, :count]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"points": self.points} | {f"layer{i}": layer.neighbours for i, layer in enumerate(self.layers)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.points, graph.layers = arrays["points"], []
        for i in range(sum(k.startswith("layer") for k in arrays)):
            flat = arrays[f"layer{i}"]
            layer = Layer.__new__(Layer)
            layer.points, layer.links, layer.neighbours = graph.points[: len(flat)], flat.shape[1], flat
            graph.layers.append(layer)
        return graph


class Shard:
    """A graph whose nodes carry ids; ``ids`` has the smallest ids per node, -1 padded."""

    def __init__(self, graph: Graph, ids: np.ndarray):
        self.graph, self.ids = graph, ids

    def nearest(self, queries: np.ndarray, count: int, radius: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, squared distance, id) of the nodes among each query's ``count`` nearest and within ``radius``."""
        nodes, distance = self.graph.search(queries, min(count, len(self.ids)))
        who = np.repeat(np.arange(len(queries)), nodes.shape[1])
        node, d = nodes.ravel(), distance.ravel()
        if exact:
            full = np.full(len(queries), np.inf) if nodes.shape[1] < count else distance[:, -1]
            who, node, d = self._within(queries, np.minimum(full, radius))
        keep = (node >= 0) & (d <= radius[who])
        who, node, d = who[keep], node[keep], d[keep]
        order = np.lexsort((self.ids[node, 0], d, who))
        who, node, d = who[order], node[order], d[order]
        first = np.searchsorted(who, who)
        top = np.arange(len(who)) - first < count
        who, node, d = who[top], node[top], d[top]
        ids = self.ids[node]
        there = ids >= 0
        return np.repeat(who, there.sum(1)), np.repeat(d, there.sum(1)), ids[there]

    def _within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All nodes within the squared ``radius`` of each query, by a sweep along the first axis."""
        points = self.graph.points
        order = np.argsort(points[:, 0], kind="stable")
        axis = points[order, 0]
        reach = np.sqrt(radius) * (1 + 1e-9) + 1e-300
        first = np.searchsorted(axis, queries[:, 0] - reach)
        number = np.searchsorted(axis, queries[:, 0] + reach, "right") - first
        out = []
        step = max(1, 2_000_000 // max(1, int(number.max(initial=1))))
        for a in range(0, len(queries), step):
            n = number[a : a + step]
            who = np.repeat(np.arange(a, a + len(n)), n)
            node = order[np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a : a + step], n)]
            d = _square(points[node] - queries[who])
            near = d <= radius[who]
            out.append((who[near], node[near], d[near]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def pack(self, **more: np.ndarray) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, ids=self.ids, **self.graph.arrays(), **more)
        return buffer.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Shard, dict[str, np.ndarray]]:
        arrays = dict(np.load(io.BytesIO(data)))
        return cls(Graph.of(arrays), arrays.pop("ids")), arrays


def space_filling(vectors: np.ndarray) -> np.ndarray:
    """A Morton code of the bits of each float, in the order of signed 64-bit numbers."""
    bits = vectors.astype(np.float32).view(np.int32).astype(np.int64)
    ordered = np.where(bits < 0, ~bits & 0xFFFFFFFF, bits | 0x80000000).astype(np.uint64)
    width = vectors.shape[1]
    depth = min(32, 64 // width)
    code = np.zeros(len(vectors), np.uint64)
    for level in range(depth):
        for axis in range(width):
            code = (code << np.uint64(1)) | ((ordered[:, axis] >> np.uint64(31 - level)) & np.uint64(1))
    return (code ^ np.uint64(1 << 63)).view(np.int64) if depth * width == 64 else code.view(np.int64)


def nearest_vectors(df: DataFrame, group: str, key: str, coordinates: Sequence[str], k: int, exact: bool = True) -> DataFrame:
    """``group``, ``key``, ``rank`` (from 1), ``neighbour`` and ``distance``."""
    spark = df.sparkSession
    axes = [f"_x{i}" for i in range(len(coordinates))]
    values = [F.col(c).cast("double") for c in coordinates]
    usable = F.col(group).isNotNull() & F.col(key).isNotNull()
    for v in values:
        usable &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.where(usable).select(F.col(group).cast("string").alias("grp"), F.col(key).alias("id"), *[(v + 0.0).alias(a) for v, a in zip(values, axes)])
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.groupBy("grp", "id").agg(F.max(F.struct(*axes)).alias("v")).select("grp", "id", *[F.col(f"v.{a}") for a in axes])

    # The smallest id names a node. A minimum and a join, not a window: rows of a vector that many share stay spread.
    placed = rows.join(rows.groupBy("grp", *axes).agg(F.min("id").alias("low")), ["grp", *axes]).select("grp", "id", "low")
    same = Window.partitionBy("grp", *axes).orderBy("id")
    nodes = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    nodes = nodes.groupBy("grp", *axes).agg(F.sort_array(F.collect_list("id")).alias("ids"))

    @F.pandas_udf("bigint")
    def code(*parts: pd.Series) -> pd.Series:
        return pd.Series(space_filling(np.stack([p.to_numpy(float) for p in parts], 1)))

    nodes = nodes.withColumn("code", code(*axes)).repartitionByRange(shards, "grp", "code")

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One range: about SHARD nodes, of one group or of several small ones.
        whole = list(parts)
        if not whole or not sum(map(len, whole)):
            return
        whole = pd.concat(whole)
        shard = TaskContext.get().partitionId()
        for grp, part in whole.groupby("grp", sort=True):
            part = part.sort_values([*axes])
            points = part[axes].to_numpy(float)
            graph = Graph(points)
            ids = np.full((len(part), k + 1), -1, np.int64)
            for i, own in enumerate(part["ids"]):
                ids[i, : len(own)] = own
            made = Shard(graph, ids[graph.order])
            who, d, near = made.nearest(graph.points, k + 1, np.full(len(points), np.inf), exact)
            order = np.lexsort((near, d, who))
            who, d, near = who[order], d[order], near[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            # The k + 1 nearest entries of a node, itself among them, bound what can still be nearer.
            radius = np.full(len(points), np.inf)
            radius[who[place == k]] = d[place == k]
            top = place <= k
            data = made.pack(radius=radius, who=who[top], distance=d[top], near=near[top])
            by_radius = np.argsort(-radius, kind="stable")
            far, rest = by_radius[:_APART], by_radius[_APART:]
            asks = [{"lower": graph.points[i].tolist(), "upper": graph.points[i].tolist(), "reach": float(radius[i])} for i in far]
            if len(rest):
                asks.append({"lower": graph.points[rest].min(0).tolist(), "upper": graph.points[rest].max(0).tolist(), "reach": float(radius[rest].max())})
            yield pd.DataFrame({"grp": [grp], "shard": [shard], "lower": [points.min(0)], "upper": [points.max(0)], "asks": [asks], "graph": [data]})

    ask = "array<struct<lower: array<double>, upper: array<double>, reach: double>>"
    index = cut_lineage(nodes.mapInPandas(build, f"grp string, shard int, lower array<double>, upper array<double>, asks {ask}, graph binary"))

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for grp, data in zip(part["grp"], part["graph"]):
                shard, more = Shard.unpack(data)
                yield pd.DataFrame({"grp": grp, "low": shard.ids[more["who"], 0], "distance": more["distance"], "neighbour": more["near"]})

    entry = "grp string, low bigint, distance double, neighbour bigint"
    d = range(len(axes))
    boxes = index.select("grp", F.col("shard").cast("bigint").alias("node"), *[F.col("lower")[i].alias(f"l{i}") for i in d], *[F.col("upper")[i].alias(f"u{i}") for i in d])
    tree = [boxes]
    for _ in range(max(1, math.ceil(math.log(shards + 1, _FAN)))):
        wider = [F.min(f"l{i}").alias(f"l{i}") for i in d] + [F.max(f"u{i}").alias(f"u{i}") for i in d]
        tree.append(tree[-1].groupBy("grp", F.floor(F.col("node") / _FAN).cast("bigint").alias("node")).agg(*wider))
    gap = sum(F.pow(F.greatest(F.col("ask.lower")[i] - F.col(f"u{i}"), F.col(f"l{i}") - F.col("ask.upper")[i], F.lit(0.0)), 2) for i in d)
    seekers = index.select("grp", "shard", F.explode("asks").alias("ask"))
    seekers = seekers.join(tree[-1].select("grp", F.col("node").alias("at")), "grp")  # the topmost boxes: at most ``_FAN`` of a group
    for level in reversed(tree[:-1]):
        below = level.withColumn("at", F.floor(F.col("node") / _FAN).cast("bigint"))
        seekers = seekers.join(below, ["grp", "at"]).where(gap <= F.col("ask.reach")).select("grp", "shard", "ask", F.col("node").alias("at"))
    close = seekers.where(F.col("shard") != F.col("at")).select("grp", F.col("shard"), F.col("at").cast("int").alias("other")).distinct()
    close = cut_lineage(close)
    asked = close.groupBy("grp", "other").agg(F.ceil(F.count(F.lit(1)) / _ASKED).cast("int").alias("parts"))
    place = index.select("grp", F.col("shard").alias("other"), "lower", "upper").join(asked, ["grp", "other"])
    close = close.join(place, ["grp", "other"]).groupBy("grp", "shard", F.floor(F.col("other") / _LISTED).alias("_list")).agg(
        F.collect_list(F.struct(F.col("other").alias("shard"), "lower", "upper", "parts")).alias("others")
    )

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for grp, own, data, others in zip(part["grp"], part["shard"], part["graph"], part["others"]):
                shard, more = Shard.unpack(data)
                points, names, radius = shard.graph.points, shard.ids[:, 0], more["radius"]
                for other in others:
                    lower, upper = np.array(other["lower"]), np.array(other["upper"])
                    away = np.maximum(np.maximum(lower - points, points - upper), 0)
                    to = np.flatnonzero((away**2).sum(1) <= radius)
                    if len(to):
                        part_of = np.int32(own % other["parts"])
                        yield pd.DataFrame({"grp": grp, "shard": np.int32(other["shard"]), "part": part_of, "low": names[to], "point": list(points[to]), "radius": radius[to]})

    sent = index.select("grp", "shard", "graph").join(close, ["grp", "shard"]).mapInPandas(route, "grp string, shard int, part int, low bigint, point array<double>, radius double")

    def foreign(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(stored):
            return pd.DataFrame(columns=["grp", "low", "distance", "neighbour"])
        shard, _ = Shard.unpack(stored["graph"].iloc[0])
        who, d, near = shard.nearest(np.stack(queries["point"].to_list()), k + 1, queries["radius"].to_numpy(float), exact)
        return pd.DataFrame({"grp": stored["grp"].iloc[0], "low": queries["low"].to_numpy()[who], "distance": d, "neighbour": near})

    graphs = index.select("grp", "shard", "graph").join(asked.withColumnRenamed("other", "shard"), ["grp", "shard"])
    graphs = graphs.select("grp", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "graph")
    more = sent.groupBy("grp", "shard", "part").cogroup(graphs.groupBy("grp", "shard", "part")).applyInPandas(foreign, entry)
    by_node = Window.partitionBy("grp", "low").orderBy("distance", "neighbour")
    entries = index.mapInPandas(own, entry).unionByName(more).withColumn("_n", F.row_number().over(by_node)).where(F.col("_n") <= k + 1)
    lists = entries.groupBy("grp", "low").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))

    result = placed.join(lists, ["grp", "low"])
    others = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("id")), 1, k)
    result = result.select("grp", "id", F.posexplode(others).alias("rank", "e"))
    return result.select(F.col("grp").alias(group), F.col("id").alias(key), (F.col("rank") + 1).alias("rank"), F.col("e.neighbour").alias("neighbour"), F.sqrt("e.distance").alias("distance"))

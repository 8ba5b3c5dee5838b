"""Problems 3 and 7 against brute force and at their edges."""

from collections import Counter, defaultdict

import numpy as np

from strandloom.llm import clusters, neighbours

SCHEMA = "run string, row bigint, x double, y double, grp int, low int, id int"


def frame(spark, points):
    return spark.createDataFrame([(r, i, float(x) if x is not None else None, float(y), 1, 2, 3) for r, i, x, y in points], SCHEMA)


def brute_groups(points, reach, least):
    by, out = defaultdict(dict), set()
    for run, row, x, y in points:
        if run is not None and row is not None and x is not None and np.isfinite([x, y]).all():
            by[run][row] = (x, y)
    for rows in by.values():
        names = sorted(rows)
        p = np.array([rows[n] for n in names])
        near = ((p[:, None] - p[None]) ** 2).sum(-1) <= reach * reach
        left = set(range(len(names)))
        while left:
            stack, group = [left.pop()], []
            while stack:
                i = stack.pop()
                group.append(names[i])
                new = [j for j in list(left) if near[i, j]]
                left -= set(new)
                stack += new
            if len(group) >= least:
                out |= {(min(group), g) for g in group if g != min(group)}
    return out


def groups(spark, points, reach=0.2, least=5):
    made = clusters.similarity_groups(frame(spark, points), "run", "row", "x", "y", reach, least)
    return made, {(r["cluster"], r["id"]) for r in made.members.collect() if r["cluster"] != r["id"]}


def test_groups_equal_single_linkage(spark):
    rng = np.random.default_rng(5)
    points = [("a", i, *p) for i, p in enumerate(np.vstack([rng.normal(size=(300, 2)), rng.normal(size=(200, 2)) * 0.05 + 4, rng.random((200, 2)) * 12]))]
    points += [("a", 1_000 + i, -20 + 0.19 * i, 3.0) for i in range(150)]  # a chain over several tiles
    points += [("b", 5_000 + i, *p) for i, p in enumerate(rng.normal(size=(150, 2)) * 2)]
    points += [("a", 3, *points[3][2:])] * 3 + [("a", 7_000, float("nan"), 0.0), ("a", 7_001, None, 0.0), (None, 1, 0.0, 0.0), ("a", None, 0.0, 0.0), ("a", 7_002, float("inf"), 0.0), ("a", 7_003, 1e12, 0.0)]
    made, got = groups(spark, points)
    assert got == brute_groups(points[:-1], 0.2, 5)
    described = {(r["grp"], r["cluster"]): r for r in clusters.typical(made, 3).collect()}
    sizes = {(r["grp"], r["cluster"]): r["size"] for r in made.groups.collect()}
    assert set(described) == set(sizes) and all(len(r["typical"].split()) == 3 for r in described.values())


def test_links_decided_between_dense_cells(spark):
    # Two dense blobs whose nearest points are just within or just beyond reach.
    rng = np.random.default_rng(2)
    for gap, joined in ((0.1999, True), (0.2003, False)):
        left = [("r", i, -abs(x) * 0.05, y * 0.02) for i, (x, y) in enumerate(rng.random((300, 2)))]
        right = [("r", 1_000 + i, gap + abs(x) * 0.05, y * 0.02) for i, (x, y) in enumerate(rng.random((300, 2)))]
        points = [*left, *right, ("r", 5_000, 0.0, 0.01), ("r", 5_001, gap, 0.01)]
        _, got = groups(spark, points)
        assert got == brute_groups(points, 0.2, 5) and ({a for a, _ in got} == {0}) == joined


def test_hot_point_and_empty(spark):
    points = [("r", i, 1.0, 1.0) for i in range(3_000)] + [("r", 9_000 + i, 5.0 + i, 0.0) for i in range(4)]
    made, got = groups(spark, points)
    assert len(got) == 2_999 and made.groups.count() == 1
    made, got = groups(spark, [("r", 1, 0.0, 0.0)])
    assert got == set()
    made = clusters.similarity_groups(frame(spark, points).limit(0), "run", "row", "x", "y", 0.2, 5)
    assert made.members.count() == 0 and clusters.typical(made, 3).count() == 0


def test_far_coordinates_are_similar_only_to_their_equals(spark):
    far = [("r|1", i, 1e12, 0.1 * i) for i in range(6)] + [("r|1", 10 + i, 1e12 + 1, 0.0) for i in range(5)] + [("r|1", 20 + i, -1e300, 1e300) for i in range(5)] + [("r|1", 30 + i, 0.0, 0.0) for i in range(5)]
    made, got = groups(spark, far)
    assert got == {(0, i) for i in range(1, 6)} | {(b, b + i) for b in (10, 20, 30) for i in range(1, 5)}
    assert {r["grp"] for r in made.groups.collect()} == {"r|1"} and made.members.count() == 21


def pair_shares(got, true):
    """Precision and recall over pairs of rows in one group."""
    pairs = lambda labels: sum(n * (n - 1) // 2 for n in Counter(labels).values())
    both = pairs((got[k], true[k]) for k in true)
    return both / max(1, pairs(got.values())), both / max(1, pairs(true.values()))


def test_clusters_of_the_embedding_alone(spark):
    rng = np.random.default_rng(6)
    centres = rng.random((60, 2)) * 40
    points = [("a", i, *p) for i, p in enumerate(np.vstack([c + rng.normal(size=(40, 2)) * 0.2 for c in centres]))]
    points += [("a", 5_000 + i, -20 + 0.19 * i, 3.0) for i in range(300)]
    label = lambda repair: {(r["grp"], r["id"]): r["cluster"] for r in clusters.similarity_groups(frame(spark, points), "run", "row", "x", "y", 0.2, 1, repair).members.collect()}
    precision, recall = pair_shares(label(False), label(True))
    assert precision >= 0.9 and recall >= 0.9
    assert not clusters.similarity_groups(frame(spark, points), "run", "row", "x", "y", 0.2, 1).members.where("mended").count()


def two_chains(length=40):
    a = np.array([*range(length - 1), *range(length, 2 * length - 1)])
    return np.arange(10, 10 + 2 * length), a, a + 1, np.ones(len(a))


def test_k_means_decides_what_reaches_the_repair(monkeypatch):
    nodes, a, b, w = two_chains()
    least, doubt = clusters.settle(nodes, a, b, w)
    assert not doubt.any() and set(least[:40]) == {10} and set(least[40:]) == {50}
    for wrong in (np.zeros(80, int), np.arange(80)):
        monkeypatch.setattr(clusters, "k_means", lambda e, wrong=wrong: wrong)
        again, doubt = clusters.settle(nodes, a, b, w)
        assert doubt.any() and (again == least).all()
        assert (clusters.settle(nodes, a, b, w, repair=False)[0] != least).any()


def test_steps_settle_where_squaring_is_too_wide(monkeypatch):
    nodes, a, b, w = two_chains(20)
    monkeypatch.setattr(clusters, "DENSE", 8)
    state = clusters.power_iteration(a, b, w, clusters.start_vectors(nodes))
    assert np.ptp(state[:20], axis=0).max() < 1e-6 and np.ptp(state[20:], axis=0).max() < 1e-6 and np.abs(state[0] - state[20]).max() > 1e-3


def brute_nearest(points, k):
    by, out = defaultdict(dict), {}
    for run, row, x, y in points:
        if run is not None and row is not None and x is not None and np.isfinite([x, y]).all():
            by[run][row] = (x, y)
    for run, rows in by.items():
        names = np.array(sorted(rows))
        p = np.array([rows[n] for n in names])
        for i, n in enumerate(names):
            d = ((p - p[i]) ** 2).sum(1)
            d[i] = np.inf
            order = np.lexsort((names, d))[: min(k, len(names) - 1)]
            out[run, int(n)] = [int(m) for m in names[order]]
    return out


def nearest(spark, points, k, **more):
    got = defaultdict(dict)
    for r in neighbours.nearest_vectors(frame(spark, points), "run", "row", ["x", "y"], k, **more).collect():
        got[r["run"], r["row"]][r["rank"]] = r["neighbour"]
    return {key: [v[i] for i in sorted(v)] for key, v in got.items()}


def test_nearest_equal_brute_force_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 150)
    rng = np.random.default_rng(4)
    points = [("a", i, *np.round(p, 1)) for i, p in enumerate(rng.normal(size=(900, 2)))]  # many ties and equal points
    points += [("a", 2_000 + i, *p) for i, p in enumerate(rng.normal(size=(300, 2)) * 50)]
    points += [("b", 5_000 + i, *p) for i, p in enumerate(rng.normal(size=(3, 2)))] + [("c", 1, 0.0, 0.0)]
    points += [points[0], ("a", 9_000, float("nan"), 0.0), ("a", 9_001, None, 0.0), (None, 5, 0.0, 0.0), ("a", None, 0.0, 0.0), ("a", 9_002, float("inf"), 1.0)]
    want = {key: v for key, v in brute_nearest(points, 5).items() if v}
    assert nearest(spark, points, 5) == want


def test_outliers_and_asked_shards(spark, monkeypatch):
    """Few vectors per shard, a deep tree, outliers, and a shard that all others ask."""
    for name, value in (("SHARD", 40), ("_FAN", 3), ("_APART", 2), ("_LISTED", 4), ("_ASKED", 2)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(11)
    points = [("a", i, *p) for i, p in enumerate(rng.normal(size=(500, 2)))]
    points += [("a", 1_000 + i, 1e4 * np.cos(i), 1e4 * np.sin(i)) for i in range(40)] + [("b", 3_000 + i, *p) for i, p in enumerate(rng.random((50, 2)))]
    assert nearest(spark, points, 3) == brute_nearest(points, 3)


def test_hot_location_and_empty(spark):
    points = [("a", i, 1.0, 2.0) for i in range(2_000)] + [("a", 5_000 + i, 1.0 + i, 2.0) for i in range(1, 5)]
    got = nearest(spark, points, 3)
    assert got == brute_nearest(points, 3)
    assert neighbours.nearest_vectors(frame(spark, points).limit(0), "run", "row", ["x", "y"], 3).count() == 0


def test_recall_of_the_graph_alone():
    rng = np.random.default_rng(0)
    for d, beam in ((2, 24), (16, 64)):
        graph = neighbours.Graph(rng.normal(size=(3_000, d)))
        found, _ = graph.search(graph.points, 11, beam)
        squares = (graph.points**2).sum(1)
        true = np.argsort(squares[:, None] + squares[None] - 2 * graph.points @ graph.points.T, axis=1)[:, :11]
        assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(found, true)]) > 0.95
        back, _ = neighbours.Shard.unpack(neighbours.Shard(graph, np.arange(3_000)[:, None]).pack())
        assert (back.graph.search(graph.points[:50], 11, beam)[0] == found[:50]).all()


def test_order_follows_space():
    p = np.array([[0.0, 0.0], [0.001, 0.001], [5.0, 5.0], [-5.0, 5.0], [1e30, -1e30]])
    code = neighbours.space_filling(p)
    assert len(set(code.tolist())) == 5 and code[1] - code[0] < code[2] - code[0]

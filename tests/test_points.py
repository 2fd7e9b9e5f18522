"""Point-cloud operators on small frames with known results, their errors, and odd input."""

import math

import pytest

from pointloom.operators import cluster, interpolate, metrics, neighbors, sampling
from pointloom.sources import frames

P, Q = "cloud_id long, point_id long, x double, y double, z double", "cloud_id long, query_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def make(spark):
    def run(rows, schema=P):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return run


def cloud(points, number=0):
    return [(number, i, *map(float, p)) for i, p in enumerate(points)]


LINE = [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def arrays(df):
    return {(r.cloud_id, r.query_id): (list(r.idx), [round(d, 9) for d in r.dist2]) for r in df.collect()}


def test_dense_ball(make):
    p, q = make(cloud(LINE) + cloud(LINE, 1)), make([(0, 0, 0.0, 0.0, 0.0), (1, 0, 3.0, 0.0, 0.0)], Q)
    assert arrays(neighbors.ball_query_layout(p, q, 1.01, 2, "DENSE")) == {(0, 0): ([0, 1], [0, 1]), (1, 0): ([2, 2], [1, -1])}
    corner = [(0, 0, 0), (1, 0, 0), (1, 1, 0)]
    p = make(cloud(corner))
    assert arrays(neighbors.ball_query_layout(p, p.withColumnRenamed("point_id", "query_id"), 1.01, 3)) == {(0, 0): ([0, 1, 0], [0, 1, -1]), (0, 1): ([1, 0, 2], [0, 1, 1]), (0, 2): ([2, 1, 2], [0, 1, -1])}


def test_partial_ball_and_bounds(make):
    p = make(cloud([(10, 0, 0), (0.1, 0, 0), (10, 0, 0), (10.1, 0, 0)])).withColumnRenamed("cloud_id", "b")
    q = make([(0, 0, 0.0, 0.0, 0.0)], Q).withColumnRenamed("cloud_id", "b")
    named = dict(mode="partial_dense", point_batch="b", query_batch="b")
    found = neighbors.ball_query_layout(p, q, 1.0, 2, **named).collect()[0]
    assert (list(found.idx), [round(d, 9) for d in found.dist2]) == ([1, -1], [0.01, -1])
    p = make([(0, 0, 10.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 2.0, 0.0, 0.0)])
    q = make([(0, 0, 0.0, 0.0, 0.0)], Q)
    ids = lambda bound: [r.point_id for r in neighbors.ball_query(p, q, 2.0, 4, bound=bound).orderBy("rank").collect()]
    assert (ids("inclusive"), ids("strict")) == ([1, 2], [1])


@pytest.mark.parametrize(("how", "says"), [(dict(mode=None), "mode"), (dict(mode="odd"), "unknown mode"), (dict(mode="partial_dense"), "batch columns"), (dict(mode="partial_dense", point_batch="cloud_id"), "batch columns"), (dict(mode="dense", point_batch="cloud_id"), "takes no batch")])
def test_layout_errors(make, how, says):
    p = make(cloud(LINE))
    with pytest.raises(ValueError, match=says):
        neighbors.ball_query_layout(p, p.withColumnRenamed("point_id", "query_id"), 1.0, 2, **how)


def test_other_errors(make):
    p, q = make(cloud(LINE) + cloud(LINE, 1)), make([(0, 0, 0.0, 0.0, 0.0)], Q)
    for call, says in (
        (lambda: neighbors.ball_query(p, q, 1.0, 2, strict_clouds=True), "different clouds"),
        (lambda: neighbors.ball_query_layout(make(cloud(LINE) + cloud(LINE[:2], 1)), q, 1.0, 2), "different size"),
        (lambda: neighbors.ball_query(p, q, -1.0), "negative"),
        (lambda: neighbors.ball_query(p, q, 1.0, bound="odd"), "bound"),
        (lambda: neighbors.ball_query(p, q, 1.0, order="odd"), "order"),
        (lambda: neighbors.ball_query(p, q, 1.0, metric="l3"), "metric"),
        (lambda: neighbors.ball_query(p.drop("z"), q, 1.0), "missing columns: z"),
        (lambda: neighbors.padded(p, q, 1, "odd"), "layout"),
        (lambda: neighbors.knn(p, q, 5), "fewer than k"),
        (lambda: neighbors.knn(p, make([(7, 0, 0.0, 0.0, 0.0)], Q), 1), "fewer than k"),
        (lambda: neighbors.knn(p, q, 0), "less than 1"),
        (lambda: sampling.furthest_point_sample(p, 4), "fewer than 4"),
        (lambda: sampling.furthest_point_sample(p, 0), "less than 1"),
        (lambda: sampling.furthest_point_sample(p, 2, start=9), "no point 9"),
        (lambda: sampling.furthest_point_sample(p, 2, start=1, random_seed=1), "at random"),
    ):
        with pytest.raises(ValueError, match=says):
            call()


def test_knn(make):
    p, q = make(cloud(LINE)), make([(0, 0, 0.0, 0.0, 0.0)], Q)
    for small in (100, 0):
        got = lambda k: [(r.point_id, r.dist2) for r in neighbors.knn(p, q, k, small=small).orderBy("rank").collect()]
        assert got(3) == [(0, 0.0), (1, 1.0), (2, 4.0)] and got(2) == [(0, 0.0), (1, 1.0)]


def brute(p, q, k, radius=None):
    out = set()
    for c, i, *a in q:
        near = sorted((sum((u - v) ** 2 for u, v in zip(a, b, strict=True)), j) for d, j, *b in p if d == c)
        near = [x for x in near if radius is None or x[0] < radius * radius][:k]
        out |= {(c, i, r, j, round(d, 9)) for r, (d, j) in enumerate(near)}
    return out


def test_crowded_and_far(make):
    """A cloud with a very dense place, ties, repeated points, and queries far outside."""
    import random

    rng = random.Random(2)
    p = [(0, i, *(rng.gauss(0, 1e-3 if i % 3 else 1.0) for _ in range(3))) for i in range(900)] + [(0, 900 + i, 0.5, 0.5, 0.5) for i in range(20)] + [(1, i, float(i), 0.0, 0.0) for i in range(30)]
    q = [(0, i, *p[i][2:]) for i in range(0, 900, 45)] + [(0, 1000, 500.0, 0.0, 0.0), (0, 1001, 0.5, 0.5, 0.5), (1, 0, 3.5, 0.0, 0.0)]
    got = {(r.cloud_id, r.query_id, r.rank, r.point_id, round(r.dist2, 9)) for r in neighbors.knn(make(p), make(q, Q), 4, small=0).collect()}
    assert got == brute(p, q, 4)
    for most in (3, 40):
        got = {(r.cloud_id, r.query_id, r.rank, r.point_id, round(r.dist2, 9)) for r in neighbors.ball_query(make(p), make(q, Q), 0.6, most, small=10).collect()}
        assert got == brute(p, q, most, 0.6)


def test_furthest_points(make):
    p = make(cloud(LINE) + cloud([(-1, 1, 0), (0, 0, 10), (0, 0, 2)], 1))
    for huge in (100, 0):
        rows = sampling.furthest_point_sample(p, 2, huge=huge).orderBy("cloud_id", "rank").collect()
        assert [(r.cloud_id, r.point_id) for r in rows] == [(0, 0), (0, 2), (1, 0), (1, 1)]
    many = make([(0, i, math.sin(i * 7.0), math.cos(i * 3.0), i % 5 / 5) for i in range(60)])
    whole = lambda **how: [r.point_id for r in sampling.furthest_point_sample(many, 20, **how).orderBy("rank").collect()]
    assert whole() == whole(huge=0) and len(set(whole())) == 20
    assert whole(random_seed=5) == whole(random_seed=5, huge=0) and len({whole(random_seed=s)[0] for s in range(6)}) > 1
    assert whole(start=17)[0] == 17


def test_growth(make):
    p = [(0, i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 10))] + [(1, 4 + i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 10))]
    grouped = lambda df: [sorted(r.point_id for r in rows) for rows in [[r for r in df if r.cluster_id == k] for k in sorted({r.cluster_id for r in df})]]
    grow = lambda least: grouped(cluster.grow_proximity(make(p), radius=2.0, min_cluster_size=least).collect())
    assert grow(1) == [[0, 1, 2], [3], [4, 5, 6], [7]] and grow(3) == [[0, 1, 2], [4, 5, 6]]
    labels = dict(enumerate((0, 0, 1, 1, 0, 1, 1, 10)))
    labelled = make([(*r, labels[r[1]]) for r in p], P + ", label int")
    assert grouped(cluster.region_grow(labelled, radius=2.0, min_cluster_size=1).collect()) == [[0, 1], [4], [2], [3], [5, 6], [7]]


def test_capped_growth_is_a_walk_from_ascending_seeds(spark):
    """Random directed graphs, against a plain walk."""
    import random

    rng = random.Random(6)
    for n, out in ((60, 1), (60, 2), (200, 1)):
        edges = [(i, rng.randrange(n)) for i in range(n) for _ in range(out)]
        seed = {}
        for i in range(n):
            todo = [] if i in seed else [i]
            while todo:
                at = todo.pop()
                if at not in seed:
                    seed[at] = i
                    todo += [b for a, b in edges if a == at]
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
        found = cluster.least_reaching(nodes, spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in found.collect()} == seed


def test_long_chain_and_large_star(spark):
    n = 3000
    nodes = spark.range(2 * n).withColumnRenamed("id", "node")
    edges = spark.range(1, n).selectExpr("id AS a", "id - 1 AS b").unionByName(spark.range(n + 1, 2 * n).selectExpr(f"{n}L AS a", "id AS b"))
    roots = cluster.components(nodes, edges).groupBy("root").count().collect()
    assert sorted((r.root, r["count"]) for r in roots) == [(0, n), (n, n)]


def test_iou(make):
    gt = [(0, i, v) for i, v in enumerate((1, 2, 1, 2, 2, 3, 0))]
    own = [(k, 0, i) for k, ids in enumerate(((0, 2), (1, 4), (3, 5))) for i in ids]
    frame = lambda rows, kind: make(rows, kind)
    gt, own = frame(gt, "cloud_id long, point_id long, instance_id long"), frame(own, "proposal_id long, cloud_id long, point_id long")
    matrix = {(r.proposal_id, r.gt_col): round(r.iou, 6) for r in metrics.instance_iou(own, gt).collect()}
    want = [[1, 0, 0], [0, 2 / 3, 0], [0, 1 / 4, 1 / 2]]
    assert matrix == {(i, j): round(v, 6) for i, row in enumerate(want) for j, v in enumerate(row)}
    assert {(r.proposal_id, r.gt_col): round(r.iou, 6) for r in metrics.instance_iou(own, gt, sparse=True).collect()} == {k: v for k, v in matrix.items() if v}
    two = frame([(0, 0, 0), (0, 1, 1)], "proposal_id long, cloud_id long, point_id long")
    with pytest.raises(ValueError, match="more than one cloud"):
        metrics.instance_iou(two, gt)


def test_chamfer(make):
    a, b = make(cloud([(0, 0, 0), (1, 1, 1), (2, 0, 1)])), make(cloud([(1, 0, 0), (1, 2, 1)]))
    assert metrics.chamfer_dist(a, b).first().chamfer == pytest.approx(7 / 3)
    assert metrics.chamfer_dist(a, b, ignore_zeros=True).first().chamfer == pytest.approx(3.0)


def test_odd_points(make):
    """Nulls, NaN, infinity, repeats, clashing columns, and nothing at all."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, None, 0.0, 0.0), (0, 3, nan, 0.0, 0.0), (0, 4, inf, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)]
    p = make(rows).selectExpr("*", "1 AS rank", "2 AS dist2", "'x' AS cx", "3 AS w", "4 AS near", "5 AS n")
    q = p.withColumnRenamed("point_id", "query_id")
    found = neighbors.ball_query(p, q.where("query_id < 2").dropDuplicates(["query_id"]), 2.0, 8).collect()
    assert sorted((r.query_id, r["rank"], r.point_id) for r in found) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 1), (1, 2, 0)]
    assert {r.point_id for r in cluster.grow_proximity(p.where("cloud_id = 0"), radius=2.0, min_cluster_size=1).collect()} == {0, 1}
    none, ask = make([]), make([], Q)
    assert neighbors.ball_query(none, ask, 1.0, 3).collect() == [] and neighbors.knn(none, ask, 3).collect() == []
    assert neighbors.padded(neighbors.ball_query(none, ask, 1.0), ask).collect() == []
    assert sampling.furthest_point_sample(none, 3).collect() == [] and cluster.grow_proximity(none).collect() == []
    assert metrics.chamfer_points(none, none).collect() == [] and neighbors.batch_offsets(none).collect() == []


def test_width_without_nsample(make):
    p, q = make(cloud(LINE)), make([(0, 0, 0.0, 0.0, 0.0), (0, 1, 9.0, 0.0, 0.0)], Q)
    assert arrays(neighbors.padded(neighbors.ball_query(p, q, 1.5), q)) == {(0, 0): ([0, 1], [0, 1]), (0, 1): ([0, 0], [-1, -1])}
    assert arrays(neighbors.padded(neighbors.ball_query(p, q.where("query_id = 1"), 1.5), q, layout="partial")) == {(0, 0): ([], []), (0, 1): ([], [])}


def test_gathering(make):
    features = make([(0, i, c, 10.0 * i + c) for i in range(3) for c in range(2)], "cloud_id long, point_id long, channel long, value double")
    groups = make([(0, 0, 0, 2), (0, 0, 1, 0), (0, 1, 0, 1), (0, 1, 1, 1)], "cloud_id long, group_id long, rank long, point_id long")
    got = {(r.group_id, r["rank"], r.channel): r.value for r in interpolate.grouping(features, groups).collect()}
    assert got == {(g, r, c): 10.0 * i + c for g, r, i in ((0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 1)) for c in range(2)}
    with pytest.raises(ValueError, match="missing columns"):
        frames.points(features)

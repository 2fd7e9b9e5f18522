"""Searches by blocks: against plain joins, with clouds whole and split, and without pairs in a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import blocks, interpolate, metrics, neighbors

P, Q = "cloud_id long, point_id long, x double, y double, z double", "cloud_id long, query_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def frames(spark):
    """Two clouds: one with a dense place, a place of 40 equal points and a far one; one of ten points on a lattice."""
    rng = random.Random(4)
    p = [(0, i, *(rng.gauss(0, 1e-2 if i % 2 else 1.0) for _ in range(3))) for i in range(400)] + [(0, 400 + i, 0.25, 0.25, 0.25) for i in range(40)] + [(0, 440, 90.0, 0.0, 0.0)]
    p += [(1, i, float(i % 3), float(i % 2), 0.0) for i in range(10)]
    q = [(0, i, *(rng.gauss(0, 1.0) for _ in range(3))) for i in range(50)] + [(0, 50, 0.25, 0.25, 0.25), (0, 51, -300.0, 0.0, 0.0), (1, 0, 1.0, 0.0, 0.0)]
    return spark.createDataFrame(p, P), spark.createDataFrame(q, Q)


def rows(df):
    return sorted(tuple(r) for r in df.select("cloud_id", "query_id", "rank", "point_id", "dist2").collect())


@pytest.mark.parametrize("small", [1000, 0])
def test_every_order_against_the_join(frames, small):
    p, q = frames
    orders = {"distance": [F.col("dist2"), F.col("point_id")], "index": [F.col("point_id")], "hash": [F.xxhash64(F.lit(-5), "query_id", "point_id"), F.col("point_id")]}
    for metric, bound in (("l2", "strict"), ("l1", "inclusive")):
        pairs = neighbors.within(p, q, 1.0, bound, metric)
        for order, by in orders.items():
            for most in (None, 4):
                got = neighbors.ball_query(p, q, 1.0, most, order, bound, metric, seed=-5, small=small)
                assert rows(got) == rows(neighbors._ranked(pairs, by, most)), (metric, order, most)


def test_repeated_and_crowded_queries(frames, spark):
    p, q = frames
    twice = q.unionByName(q.withColumn("x", F.col("x") + 1.0))
    pairs = neighbors.within(p, twice, 1.0)
    for small in (1000, 0):
        assert rows(neighbors.ball_query(p, twice, 1.0, 5, small=small)) == rows(neighbors._ranked(pairs, [F.col("dist2"), F.col("point_id")], 5))
    a, b, columns = blocks._sides(p, q, ["cloud_id"], 1.0)
    a, b = (df.withColumns({"__bucket": F.lit(0).cast("long"), "__no": F.lit(None).cast("int")}) for df in (a, b))
    copies = blocks.dealt(a, b, 1, ["cloud_id"], 20, columns)
    assert {(r["__bucket"], r["__kind"]): r["count"] for r in copies.groupBy("__bucket", "__kind").count().collect() if r["__kind"] == 0} == {(i, 0): 451 for i in (1, 2, 3)}
    assert copies.where("__kind = 1").count() == 53


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("search", [lambda p, q: neighbors.knn(p, q, 3), lambda p, q: neighbors.ball_query(p, q, 1.0), lambda p, q: neighbors.ball_query(p, q, 1.0, 8), lambda p, q: neighbors.ball_query(p, q, 1.0, 8, "index"), lambda p, q: neighbors.ball_query(p, q, 1.0, None, "hash"), lambda p, q: metrics.chamfer_points(p, q.withColumnRenamed("query_id", "point_id"))])
def test_no_pairs_are_shuffled(frames, search):
    """Points and queries meet in a task: no join makes pairs, no window sorts them."""
    text = plan(search(*frames))
    assert "Join" not in text and "Window" not in text


def test_neighbours_are_searched_once(frames):
    """Where neighbours are read several times, they are written and not searched again."""
    p, q = frames
    b = q.withColumnRenamed("query_id", "point_id")
    assert "MapInArrow" not in plan(metrics.chamfer_grad(p, b))
    features = p.select("cloud_id", "point_id", F.lit(0).cast("long").alias("channel"), F.col("x").alias("value"))
    weights = interpolate.inverse_distance_weights(neighbors.three_nn(q, p))
    assert "MapInArrow" not in plan(interpolate.three_interpolate(features, weights, strict=True))

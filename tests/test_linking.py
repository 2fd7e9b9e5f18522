"""Growth inside tasks and over blocks, against brute force."""

import random

import pytest

from pointloom.operators import cluster

P = "cloud_id long, point_id long, x double, y double, z double"


def grown(points, radius, most):
    """Seed of each point: a walk from ascending seeds along lists of the nearest points (all, without ``most``)."""
    seed = {}
    for c in {p[0] for p in points}:
        own = sorted(p[1:] for p in points if p[0] == c)
        lists = {i: [j for d, j in sorted((sum((u - v) ** 2 for u, v in zip(a, b, strict=True)), j) for j, *b in own) if d < radius * radius][:most] for i, *a in own}
        for i in lists:
            todo = [] if (c, i) in seed else [i]
            while todo:
                at = todo.pop()
                if (c, at) not in seed:
                    seed[c, at] = i
                    todo += lists[at]
    return seed


@pytest.mark.parametrize("whole", [6_000_000, 0])
@pytest.mark.parametrize("most", [None, 3])
def test_growth_whole_and_split(spark, whole, most):
    rng = random.Random(8)
    points = [(c, i, *(rng.gauss(0, 1.0) for _ in range(3))) for c in range(2) for i in range(60 + 40 * c)]
    points += [(2, i, i * 0.4, 0.0, 0.0) for i in range(50)]
    found = cluster._grown(spark.createDataFrame(points, P), ["cloud_id"], most, 0.5, "strict", whole=whole)
    assert {(r.cloud_id, r.point_id): r.seed for r in found.collect()} == grown(points, 0.5, most)


@pytest.mark.parametrize("most", [None, 3])
def test_small_clouds_grow_without_rounds(spark, most):
    """A cloud that fits is solved in its task: no join of nodes with edges."""
    points = spark.createDataFrame([(0, i, i * 0.4, 0.0, 0.0) for i in range(300)], P)
    found = cluster._grown(points, ["cloud_id"], most, 0.5, "strict")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.seed for r in found.collect()} == {0}

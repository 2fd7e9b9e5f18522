"""Instance overlap and Chamfer distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.lineage import checkpoint
from pointloom.operators.neighbors import knn
from pointloom.operators.ordering import with_sum_before
from pointloom.sources.frames import points as as_points


def instance_iou(proposals: DataFrame, gt: DataFrame, eps: float = 0.0, sparse: bool = False) -> DataFrame:
    """proposal_id, gt_col, cloud_id, instance_id, iou of each proposal with the instances of its own cloud.

    ``proposals`` has proposal_id, cloud_id, point_id (repeats count); ``gt`` has cloud_id, point_id, instance_id with 0 for
    background. Instances of a cloud are 1 to its largest id, gaps included; gt_col counts on over the clouds.
    Instances of other clouds, which a matrix would show as 0, have no row; with ``sparse`` only pairs that share points do,
    so that rows follow the overlaps and not the instances. A proposal over two clouds raises ValueError.
    """
    spread = proposals.groupBy("proposal_id").agg(F.min("cloud_id").alias("cloud_id"), F.max("cloud_id").alias("other"), F.count("*").alias("size"))
    if not spread.where("cloud_id <> other").isEmpty():
        raise ValueError("a proposal lies in more than one cloud")
    top = gt.groupBy("cloud_id").agg(F.max("instance_id").alias("top"))
    spine = with_sum_before(top, ["cloud_id"], F.col("top"), "before").where("top > 0").select("cloud_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("instance_id"), "before")
    spine = spine.select("cloud_id", "instance_id", (F.col("before") + F.col("instance_id") - 1).cast("long").alias("gt_col"))
    sizes = gt.where("instance_id > 0").groupBy("cloud_id", "instance_id").agg(F.count("*").alias("gt_size"))
    shared = proposals.join(gt.where("instance_id > 0"), ["cloud_id", "point_id"]).groupBy("proposal_id", "cloud_id", "instance_id").agg(F.count("*").alias("n"))
    if sparse:
        before = with_sum_before(top, ["cloud_id"], F.col("top"), "before").select("cloud_id", "before")
        spine = shared.join(before, "cloud_id").select("proposal_id", "cloud_id", "instance_id", (F.col("before") + F.col("instance_id") - 1).cast("long").alias("gt_col"))
    out = spread.select("proposal_id", "cloud_id", "size").join(spine, ["proposal_id", "cloud_id"] if sparse else "cloud_id").join(sizes, ["cloud_id", "instance_id"], "left").join(shared, ["proposal_id", "cloud_id", "instance_id"], "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    union = F.col("size") + F.coalesce("gt_size", F.lit(0)) - n + F.lit(eps)
    return out.select("proposal_id", "gt_col", "cloud_id", "instance_id", F.when(n > 0, n / union).otherwise(0.0).alias("iou"))


def drop_zero_points(points: DataFrame, origin_only: bool = False) -> DataFrame:
    """Points whose coordinates don't add up to 0 (or, with ``origin_only``, that aren't the origin)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.where(~((x == 0) & (y == 0) & (z == 0)) if origin_only else x + y + z != 0)


def chamfer_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (1 for a, 2 for b), cloud_id, point_id, match_id and dist2 to the nearest point of the other side."""
    one = lambda p, q, side: knn(q, p.withColumnRenamed("point_id", "query_id"), 1).select(F.lit(side).cast("long").alias("side"), "cloud_id", F.col("query_id").alias("point_id"), F.col("point_id").alias("match_id"), "dist2")
    a, b = as_points(a), as_points(b)
    return one(a, b, 1).unionByName(one(b, a, 2))


def chamfer_dist(a: DataFrame, b: DataFrame, ignore_zeros: bool = False, per_cloud: bool = False) -> DataFrame:
    """chamfer: the mean nearest dist2 over all points of a plus that over all points of b (or by cloud)."""
    if ignore_zeros:
        a, b = drop_zero_points(a), drop_zero_points(b)
    near = chamfer_points(a, b)
    both = [F.avg(F.when(F.col("side") == s, F.col("dist2"))) for s in (1, 2)]
    return near.groupBy(*["cloud_id"] * per_cloud).agg((both[0] + both[1]).alias("chamfer"))


def chamfer_grad(a: DataFrame, b: DataFrame, grads: DataFrame | None = None) -> DataFrame:
    """side, cloud_id, point_id, gx, gy, gz: gradient of the weighted sum of nearest squared distances.

    ``grads`` has side, cloud_id, point_id, g; by default each point weighs one over its side's number of points, as in
    the mean.
    """
    a, b = as_points(a), as_points(b)
    near = checkpoint(chamfer_points(a, b))  # read several times below
    if grads is None:
        share = near.groupBy("side").agg((F.lit(1.0) / F.count("*")).alias("g"))
        near = near.join(F.broadcast(share), "side")
    else:
        near = near.join(grads, ["side", "cloud_id", "point_id"])
    at = a.withColumn("side", F.lit(1).cast("long")).unionByName(b.withColumn("side", F.lit(2).cast("long")))
    own = near.join(at, ["side", "cloud_id", "point_id"])
    other = at.select((3 - F.col("side")).alias("side"), "cloud_id", F.col("point_id").alias("match_id"), *(F.col(c).alias(f"m{c}") for c in "xyz"))
    pull = own.join(other, ["side", "cloud_id", "match_id"]).select("side", "cloud_id", "point_id", "match_id", *((2 * F.col("g") * (F.col(c) - F.col(f"m{c}"))).alias(f"g{c}") for c in "xyz"))
    back = pull.select((3 - F.col("side")).alias("side"), "cloud_id", F.col("match_id").alias("point_id"), *((-F.col(f"g{c}")).alias(f"g{c}") for c in "xyz"))
    return pull.drop("match_id").unionByName(back).groupBy("side", "cloud_id", "point_id").agg(*(F.sum(f"g{c}").alias(f"g{c}") for c in "xyz"))

"""Grouping, inverse-distance weights, feature interpolation and its gradient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.operators.lineage import checkpoint


def inverse_distance_weights(nearest: DataFrame, eps: float = 1e-8) -> DataFrame:
    """cloud_id, query_id, rank, point_id, weight from neighbours with dist; weights of a query sum to one."""
    w = 1 / (F.col("dist") + F.lit(eps))
    out = nearest.select("cloud_id", "query_id", "rank", "point_id", w.alias("w"))
    return out.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("cloud_id", "query_id"))).drop("w")


def grouping(features: DataFrame, groups: DataFrame) -> DataFrame:
    """Features of the points of each group: cloud_id, group_id, rank, channel, value."""
    return groups.join(features, ["cloud_id", "point_id"]).select("cloud_id", "group_id", "rank", "channel", "value")


def three_interpolate(features: DataFrame, weights: DataFrame, strict: bool = False) -> DataFrame:
    """Weighted sum of the neighbours' features: cloud_id, query_id, channel, value (any number of neighbours).

    With ``strict`` a weight whose point has no feature raises ValueError.
    """
    if strict:
        weights = checkpoint(weights)  # read twice
    if strict and not weights.join(features.select("cloud_id", "point_id").distinct(), ["cloud_id", "point_id"], "left_anti").isEmpty():
        raise ValueError("a weight names a point without features")
    return weights.join(features, ["cloud_id", "point_id"]).groupBy("cloud_id", "query_id", "channel").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def three_interpolate_grad(grad_out: DataFrame, weights: DataFrame, points: DataFrame) -> DataFrame:
    """Gradient to the features of all points: cloud_id, point_id, channel, grad; 0 where no weight names the point."""
    got = grad_out.join(weights, ["cloud_id", "query_id"]).groupBy("cloud_id", "point_id", "channel").agg(F.sum(F.col("grad") * F.col("weight")).alias("grad"))
    channels = grad_out.select("cloud_id", "channel").distinct()
    every = points.select("cloud_id", "point_id").join(channels, "cloud_id")
    return every.join(got, ["cloud_id", "point_id", "channel"], "left").withColumn("grad", F.coalesce("grad", F.lit(0.0)))

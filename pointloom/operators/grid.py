"""Trilinear gridding and cubic feature sampling, with gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.metrics import drop_zero_points
from pointloom.sources.frames import points as as_points


def rescaled(points: DataFrame, factor: float, shift: float = 0.0) -> DataFrame:
    """Coordinates times a factor plus a shift."""
    return points.withColumns({c: F.col(c) * F.lit(float(factor)) + F.lit(float(shift)) if shift else F.col(c) * F.lit(float(factor)) for c in "xyz"})


def _bounds(c: str) -> tuple[Column, Column]:
    low, high = F.floor(c).cast("long"), F.ceil(c).cast("long")
    return low, F.when(high == low, low + 1).otherwise(high)


def gridding_points(points: DataFrame, scale: int, drop_zeros: bool = True) -> DataFrame:
    """cloud_id, point_id, corner (0-7, x slowest, lower first), vertex, wx, wy, wz of the eight vertices around a point.

    Vertices number (x + scale) * L * L + (y + scale) * L + (z + scale), L = 2 * scale. A vertex off the grid is left out
    where its weight is 0 and an error where it isn't.
    """
    p = rescaled(as_points(points), scale)
    if drop_zeros:
        p = drop_zero_points(p)
    side = 2 * scale
    corners = []
    for corner in range(8):
        at = [_bounds(c)[corner >> (2 - k) & 1] for k, c in enumerate("xyz")]
        weights = [1 - F.abs(F.col(c) - v) for c, v in zip("xyz", at, strict=True)]
        inside = (at[0] >= -scale) & (at[0] < scale) & (at[1] >= -scale) & (at[1] < scale) & (at[2] >= -scale) & (at[2] < scale)
        vertex = F.when(inside, (at[0] + scale) * (side * side) + (at[1] + scale) * side + (at[2] + scale)).when(weights[0] * weights[1] * weights[2] != 0, F.raise_error(F.lit("a point lies off the grid")).cast("long"))
        corners.append(F.struct(F.lit(corner).cast("long").alias("corner"), vertex.alias("vertex"), *(w.alias(f"w{c}") for c, w in zip("xyz", weights, strict=True))))
    return p.select("cloud_id", "point_id", F.inline(F.array(*corners))).where("vertex is not null")


def gridding(points: DataFrame, scale: int, drop_zeros: bool = True) -> DataFrame:
    """cloud_id, vertex, weight: each point's trilinear weights added up; a vertex without weight has no row."""
    return gridding_points(points, scale, drop_zeros).groupBy("cloud_id", "vertex").agg(F.sum(F.col("wx") * F.col("wy") * F.col("wz")).alias("weight"))


def gridding_grad(points: DataFrame, grad_grid: DataFrame, scale: int, drop_zeros: bool = True) -> DataFrame:
    """cloud_id, point_id, gx, gy, gz to the unscaled points, from (cloud_id, vertex, grad); a missing vertex counts as 0."""
    each = gridding_points(points, scale, drop_zeros).join(grad_grid, ["cloud_id", "vertex"], "left").withColumn("g", F.coalesce("grad", F.lit(0.0)))
    sign = {c: F.when(F.shiftright("corner", 2 - k).bitwiseAND(1) == 1, 1.0).otherwise(-1.0) for k, c in enumerate("xyz")}
    rest = {c: [F.col(f"w{o}") for o in "xyz" if o != c] for c in "xyz"}
    return each.groupBy("cloud_id", "point_id").agg(*((F.sum(sign[c] * F.col("g") * rest[c][0] * rest[c][1]) * float(scale)).alias(f"g{c}") for c in "xyz"))


def cubic_vertices(points: DataFrame, size: int, neighborhood: int = 1) -> DataFrame:
    """cloud_id, point_id, slot, vertex of the (2 * neighborhood) ** 3 vertices around each point; -1 off the cube.

    Points in [-1, 1) are stretched to [0, size); slots count x slowest, lower first.
    """
    half = size / 2
    p = rescaled(as_points(points), half, half)
    n = 2 * neighborhood
    low = {c: F.floor(c).cast("long") - (neighborhood - 1) for c in "xyz"}
    p = p.select("cloud_id", "point_id", *(v.alias(f"l{c}") for c, v in low.items()))
    p = p.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1)))).withColumn("slot", F.col("slot").cast("long"))
    at = [F.col(f"l{c}") + F.floor(F.col("slot") / (n ** (2 - k))).cast("long") % n for k, c in enumerate("xyz")]
    inside = (at[0] >= 0) & (at[0] < size) & (at[1] >= 0) & (at[1] < size) & (at[2] >= 0) & (at[2] < size)
    return p.select("cloud_id", "point_id", "slot", F.when(inside, (at[0] * size + at[1]) * size + at[2]).otherwise(-1).alias("vertex"))


def cubic_feature_sampling(points: DataFrame, voxels: DataFrame, size: int, neighborhood: int = 1) -> DataFrame:
    """cloud_id, point_id, slot, channel, value: voxel features (cloud_id, vertex, channel, value) at each point's vertices; 0 off the cube."""
    channels = voxels.select("cloud_id", "channel").distinct()
    spine = cubic_vertices(points, size, neighborhood).join(channels, "cloud_id")
    return spine.join(voxels, ["cloud_id", "vertex", "channel"], "left").select("cloud_id", "point_id", "slot", "channel", F.coalesce("value", F.lit(0.0)).alias("value"))


def cubic_feature_sampling_grad(vertices: DataFrame, grad: DataFrame) -> DataFrame:
    """cloud_id, vertex, channel, grad to the voxels, from (cloud_id, point_id, slot, channel, grad); points get none."""
    on = vertices.where("vertex >= 0").join(grad, ["cloud_id", "point_id", "slot"])
    return on.groupBy("cloud_id", "vertex", "channel").agg(F.sum("grad").alias("grad"))

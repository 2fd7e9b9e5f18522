"""Radius and nearest-neighbour joins.

Neighbours are an edge list: cloud_id, query_id, rank (from 0), point_id, dist2. Searches meet points and queries in blocks
(see ``blocks``): whole small clouds, or parts of large ones, so that a cloud of any size spreads over tasks and pairs that
aren't asked for are neither made nor shuffled. ``within`` is the plain equi-join on grid cells as wide as the radius.

Points without finite coordinates are nobody's neighbours and ask for none; ties go to the smaller point_id; repeated
points count as often as they stand there; other columns are not read; without points or queries there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.functions.geometry import around, cell, dist2
from pointloom.operators import blocks
from pointloom.operators.ordering import with_sum_before
from pointloom.sources.frames import points as as_points
from pointloom.sources.frames import require

_CELL = ("cx", "cy", "cz")


def same_clouds(points: DataFrame, queries: DataFrame) -> None:
    """ValueError where the clouds of points and queries aren't the same."""
    a, b = (df.select("cloud_id").distinct() for df in (points, queries))
    if not a.join(b, "cloud_id", "left_anti").isEmpty() or not b.join(a, "cloud_id", "left_anti").isEmpty():
        raise ValueError("points and queries have different clouds")


def checked(radius: float, bound: str) -> None:
    """ValueError for a negative radius or an unknown bound."""
    if radius < 0:
        raise ValueError("the radius is negative")
    if bound not in ("strict", "inclusive"):
        raise ValueError(f"unknown bound {bound!r}")


def within(points: DataFrame, queries: DataFrame, radius: float, bound: str = "strict", metric: str = "l2") -> DataFrame:
    """cloud_id, query_id, point_id, dist2 of all pairs closer than the radius (up to it with bound="inclusive")."""
    checked(radius, bound)
    p, q = as_points(points), as_points(queries, "query_id")
    width = radius * (1 + 1e-9) or 1.0
    home = [cell(F.col(c), width) for c in "xyz"]
    p = p.withColumns(dict(zip(_CELL, home, strict=True)))
    q = q.withColumn("near", F.explode(around(home))).select("cloud_id", "query_id", "x", "y", "z", "near.*")
    d, limit = dist2("q", "p", metric), F.lit(radius * radius if metric == "l2" else radius)
    pairs = q.alias("q").join(p.alias("p"), ["cloud_id", *_CELL]).where(d < limit if bound == "strict" else d <= limit)
    return pairs.select("cloud_id", "query_id", "point_id", d.alias("dist2"))


def _ranked(pairs: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    by = Window.partitionBy("cloud_id", "query_id").orderBy(*order)
    out = pairs.withColumn("rank", F.row_number().over(by).cast("long") - 1)
    return (out if most is None else out.where(F.col("rank") < most)).select("cloud_id", "query_id", "rank", "point_id", "dist2")


def ball_query(points: DataFrame, queries: DataFrame, radius: float, nsample: int | None = None, order: str = "distance", bound: str = "strict", metric: str = "l2", seed: int = 0, strict_clouds: bool = False, small: int = 20_000) -> DataFrame:
    """Up to ``nsample`` points (all, if None or not positive) around each query, ranked.

    order: "distance" (then point_id), "index" (point_id) or "hash" (a seeded shuffle). Queries without a hit have no row.
    """
    orders = {"distance": [F.col("dist2"), F.col("point_id")], "index": [F.col("point_id")], "hash": [F.xxhash64(F.lit(seed), "query_id", "point_id"), F.col("point_id")]}
    if order not in orders:
        raise ValueError(f"unknown order {order!r}")
    if strict_clouds:
        same_clouds(points, queries)
    checked(radius, bound)
    dist2("q", "p", metric)  # an unknown metric is an error
    most = nsample if nsample and nsample > 0 else None
    p, q = as_points(points), as_points(queries, "query_id")
    limit, strict = radius * radius if metric == "l2" else radius, bound == "strict"
    if most and order == "distance":
        return blocks.listed(blocks.nearest(p, q, ["cloud_id"], most, metric, limit, strict, small), ["cloud_id"])
    longs = {p.schema["point_id"].dataType.typeName(), q.schema["query_id"].dataType.typeName()} == {"long"} and -(1 << 31) <= seed < 1 << 31
    if (order == "hash" and not longs) or blocks.repeated(q, ["cloud_id"]):  # repeated queries are ranked as one
        return _ranked(within(points, queries, radius, bound, metric), orders[order], most)
    return blocks.ranked_within(p, q, ["cloud_id"], limit, strict, metric, order, most, seed, small)


def ball_query_layout(points: DataFrame, queries: DataFrame, radius: float, nsample: int, mode: str | None = "dense", order: str = "distance", point_batch: str | None = None, query_batch: str | None = None) -> DataFrame:
    """``ball_query`` padded as a layout asks: "dense" or "partial_dense", in any case.

    "partial_dense" needs the batch columns of points and queries named, holding the same clouds. "dense" takes none, as
    all clouds have as many points there. ValueError otherwise, and for a mode that is missing or unknown.
    """
    if mode is None:
        raise ValueError("a mode is needed: dense or partial_dense")
    name = mode.lower()
    if name not in ("dense", "partial_dense"):
        raise ValueError(f"unknown mode {mode!r}: it is dense or partial_dense")
    batches = (point_batch, query_batch)
    if name == "partial_dense":
        if None in batches:
            raise ValueError("partial_dense needs the batch columns of points and queries")
        points, queries = (require(df, batch, i, "x", "y", "z").withColumnRenamed(batch, "cloud_id") for df, batch, i in ((points, point_batch, "point_id"), (queries, query_batch, "query_id")))
    elif batches != (None, None):
        raise ValueError("dense takes no batch columns")
    elif points.groupBy("cloud_id").count().select("count").distinct().count() > 1:
        raise ValueError("clouds of different size are not dense")
    found = ball_query(points, queries, radius, nsample, order, strict_clouds=True)
    return padded(found, queries, nsample, "dense" if name == "dense" else "partial")


def padded(neighbors: DataFrame, queries: DataFrame, nsample: int | None = None, layout: str = "dense") -> DataFrame:
    """cloud_id, query_id, idx and dist2 arrays of one width for all queries.

    "dense" fills idx with the first hit (0 without any) and dist2 with -1; "partial" fills both with -1. Without
    ``nsample`` the width is the largest number of hits, and at least 1 for "dense".
    """
    if layout not in ("dense", "partial"):
        raise ValueError(f"unknown layout {layout!r}")
    if nsample is None or nsample <= 0:
        width = F.greatest(F.coalesce(neighbors.agg(F.max("rank") + 1).scalar(), F.lit(0)), F.lit(1 if layout == "dense" else 0)).cast("int")
    else:
        width = F.lit(nsample)
    hits = neighbors.where(F.col("rank") < width).groupBy("cloud_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "point_id", "dist2"))).alias("h"))
    fill = F.coalesce(F.get("h", F.lit(0))["point_id"], F.lit(0)) if layout == "dense" else F.lit(-1)
    at = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    out = queries.select("cloud_id", "query_id").join(hits, ["cloud_id", "query_id"], "left").withColumn("at", at)
    idx = F.transform("at", lambda i: F.coalesce(F.get("h", i)["point_id"], fill.cast("long")))
    return out.select("cloud_id", "query_id", idx.alias("idx"), F.transform("at", lambda i: F.coalesce(F.get("h", i)["dist2"], F.lit(-1.0))).alias("dist2"))


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", small: int = 20_000) -> DataFrame:
    """The ``k`` nearest points of each query, ranked by (dist2, point_id); ValueError if a queried cloud has fewer.

    Clouds of up to ``small`` points are searched whole, each in one task; larger ones are split (see ``blocks``).
    """
    if k < 1:
        raise ValueError("k is less than 1")
    dist2("q", "p", metric)  # an unknown metric is an error
    p, q = as_points(points), as_points(queries, "query_id")
    sizes = blocks.sizes(p, q, ["cloud_id"])
    worst = sizes.where("m > 0").agg(F.min("n")).first()[0]
    if worst is not None and worst < k:
        raise ValueError(f"a cloud has {worst} points, fewer than k = {k}")
    return blocks.listed(blocks.nearest(p, q, ["cloud_id"], k, metric, float("inf"), False, small, sizes), ["cloud_id"])


def three_nn(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """The three nearest known points of each unknown one, with Euclidean distances (dist)."""
    return knn(known, unknown, 3).withColumn("dist", F.sqrt("dist2")).drop("dist2")


def degree(df: DataFrame) -> DataFrame:
    """Number of rows of each cloud."""
    return df.groupBy("cloud_id").agg(F.count("*").alias("degree"))


def batch_offsets(df: DataFrame) -> DataFrame:
    """First position of each cloud's rows when clouds stand in ascending order."""
    return with_sum_before(degree(df), ["cloud_id"], F.col("degree"), "start")


def dense_cloud_ids(df: DataFrame) -> DataFrame:
    """Each cloud's number when clouds are counted from 0 in ascending order."""
    return with_sum_before(df.select("cloud_id").distinct(), ["cloud_id"], F.lit(1), "dense_id")

"""Furthest-point sampling: sequential by nature, so one cloud to a grouped function, or a driver loop for huge clouds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.lineage import checkpoint
from pointloom.sources.frames import points as as_points

_MOST_BROADCAST = 100_000


def furthest_point_sample(points: DataFrame, npoint: int, start: int | None = None, skip_near_origin: bool = False, huge: int = 2_000_000, random_seed: int | None = None) -> DataFrame:
    """cloud_id, rank, point_id: greedily the point furthest from those taken so far; ties go to the smallest id.

    Starts at the smallest point_id, or at ``start``, or, with ``random_seed``, at a point that a seeded hash picks in each
    cloud. Points without finite coordinates are left out, repeats count, an empty frame gives no row. With ``skip_near_origin`` points whose squared norm is 1e-3 or less
    are never taken after the first. ValueError if a cloud has fewer than ``npoint`` points or not the start. Clouds of
    more than ``huge`` points are sampled by distributed aggregations, one for each pick.
    """
    p = as_points(points)
    if npoint < 1:
        raise ValueError("npoint is less than 1")
    sizes = p.groupBy("cloud_id").agg(F.count("*").alias("n"), F.max(F.col("point_id") == start).alias("has") if start is not None else F.lit(True).alias("has"))
    sizes = checkpoint(sizes)
    low = sizes.agg(F.min("n"), F.min("has")).first()
    if low[0] is not None and low[0] < npoint:
        raise ValueError(f"a cloud has {low[0]} points, fewer than {npoint}")
    if low[1] is False:
        raise ValueError(f"a cloud has no point {start}")

    if start is not None and random_seed is not None:
        raise ValueError("a start is given and to be picked at random")
    p = p.withColumn("first", F.xxhash64(F.lit(random_seed), "cloud_id", "point_id") if random_seed is not None else (F.when(F.col("point_id") == start, 0).otherwise(1) if start is not None else F.lit(0)).cast("long"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        xyz, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["point_id"].to_numpy()
        at = int(pdf["first"].to_numpy().argmin())
        allowed = (xyz * xyz).sum(1) > 1e-3 if skip_near_origin else np.ones(len(ids), bool)
        best, taken = np.full(len(ids), np.inf), [at]
        for _ in range(npoint - 1):
            dx, dy, dz = (xyz[:, k] - xyz[at, k] for k in range(3))
            best = np.minimum(best, dx * dx + dy * dy + dz * dz)
            at = int(np.where(allowed, best, -1.0).argmax()) if allowed.any() else 0
            taken.append(at)
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "rank": np.arange(npoint), "point_id": ids[taken]})

    large = checkpoint(sizes.where(F.col("n") > huge).select("cloud_id"))
    few = large.count()
    if not few:
        return p.groupBy("cloud_id").applyInPandas(pick, "cloud_id long, rank long, point_id long")
    side = F.broadcast(large) if few <= _MOST_BROADCAST else large
    out = p.join(side, "cloud_id", "left_anti").groupBy("cloud_id").applyInPandas(pick, "cloud_id long, rank long, point_id long")
    return out.unionByName(_distributed(p.join(side, "cloud_id", "left_semi"), npoint, skip_near_origin, few <= _MOST_BROADCAST))


def _distributed(p: DataFrame, npoint: int, skip_near_origin: bool, small: bool, every: int = 16) -> DataFrame:
    """The same, for all given clouds at once: each round one aggregation finds the picks.

    Distances are kept up to ``every`` picks ago; those to the picks since are worked out anew, so that the clouds are
    written once in so many rounds. Picks are one row for each cloud, broadcast where clouds are few (``small``).
    """
    whole = F.struct("point_id", "x", "y", "z")
    p = checkpoint(p.withColumn("best", F.lit(float("inf"))))
    taken = checkpoint(p.groupBy("cloud_id").agg(F.min_by(whole, F.struct("first", "point_id")).alias("t"), F.min_by(whole, "point_id").alias("z")))
    zero = taken.select("cloud_id", "z")
    picks = [taken.select("cloud_id", F.lit(0).cast("long").alias("rank"), "t")]

    def nearest(recent: list[DataFrame]) -> DataFrame:
        t = recent[0]
        for more in recent[1:]:
            t = t.unionByName(more)
        t = t.groupBy("cloud_id").agg(F.collect_list("t").alias("recent"))
        away = F.transform("recent", lambda o: (F.col("x") - o["x"]) * (F.col("x") - o["x"]) + (F.col("y") - o["y"]) * (F.col("y") - o["y"]) + (F.col("z") - o["z"]) * (F.col("z") - o["z"]))
        return p.join(F.broadcast(t) if small else t, "cloud_id").withColumn("best", F.least("best", F.array_min(away))).drop("recent")

    since = [picks[0]]
    for rank in range(1, npoint):
        now = nearest(since)
        if len(since) == every:
            now = p = checkpoint(now)
            since = []
        allowed = now.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") > 1e-3) if skip_near_origin else now
        best = allowed.groupBy("cloud_id").agg(F.max_by(whole, F.struct("best", -F.col("point_id"))).alias("t"))
        own = checkpoint(zero.join(best, "cloud_id", "left").select("cloud_id", F.lit(rank).cast("long").alias("rank"), F.coalesce("t", "z").alias("t")))
        picks.append(own)
        since.append(own)
    out = picks[0]
    for more in picks[1:]:
        out = out.unionByName(more)
    return out.select("cloud_id", "rank", "t.point_id")

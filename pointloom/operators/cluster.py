"""Proximity clustering: connected components of the radius graph, or forward growth over a capped neighbour list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pointloom.operators import blocks, linking
from pointloom.operators.lineage import checkpoint
from pointloom.operators.neighbors import checked
from pointloom.operators.ordering import with_sum_before
from pointloom.sources.frames import points as as_points

_SALTS = 16


def least_reaching(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) with the smallest node from which the node is reachable along the edges (a to b), itself included.

    Each round hands labels on along the edges of the nodes whose label fell, and then follows labels once (pointer
    jumping), until nothing changes. Edges are dealt out once; where labels are followed, only roots whose own label
    fell are joined, each to as many salts, so that a root with many members isn't one task's work.
    """
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = checkpoint(edges.where("a <> b").select("a", "b").repartition(parts, "a"))
    labels = checkpoint(nodes.select("node", F.col("node").alias("root")))
    fell = labels
    for _ in range(most_rounds):
        least = out.join(fell.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        step = checkpoint(labels.join(least, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was")))
        heads = step.groupBy("root").agg(F.lit(1).alias("there"))
        moved = heads.join(step.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("root", "next", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        after = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(moved, ["root", "salt"], "left")
        after = checkpoint(after.select("node", F.coalesce("next", "root").alias("root"), "was"))
        labels, fell = after.select("node", "root"), after.where("root <> was").select("node", "root")
        if fell.isEmpty():
            return labels
    raise RuntimeError("the labels don't settle")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) with the smallest node reachable over the undirected edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return least_reaching(nodes, both, most_rounds)


def _least(rows: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """keys, point_id, seed for nodes (keys, point_id) of clouds too large for a task, with edges of structs of both."""
    nodes = rows.select(F.struct(*keys, "point_id").alias("node")).distinct()
    found = least_reaching(nodes, edges)
    return found.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.point_id").alias("point_id"), F.col("root.point_id").alias("seed"))


def _grown(part: DataFrame, keys: list[str], nsample: int | None, radius: float, bound: str, whole: int = 6_000_000) -> DataFrame:
    """keys, point_id, seed (smallest point of the cluster) with clouds told apart by ``keys``.

    Growth from ascending seeds leaves each point to the smallest point that reaches it along the lists: had a smaller
    seed taken any point on the way, it would have gone on to this one. So both kinds are least labels along edges.
    Clouds whose lists have up to ``whole`` entries (some 500,000 points where all neighbours count) are solved in a task
    each; larger ones by rounds, from their lists or from the stars that blocks with a rim as wide as the radius leave.
    """
    checked(radius, bound)
    limit, strict = radius * radius, bound == "strict"
    most = nsample if nsample and nsample > 0 else None
    q = part.withColumnRenamed("point_id", "query_id")
    counted = blocks.sizes(part, q, keys)
    fits = whole // (most or 12)
    kinds = blocks._type(part, *keys)
    one = part.schema["point_id"].dataType
    ends = [StructField("point_id", one), StructField("seed", one)]
    if most:
        near = blocks.nearest(part, q, keys, most, "l2", limit, strict, 20_000, counted)
        large = counted.where(F.col("n") > fits).select(*keys)
        some = not large.isEmpty()
        if some:
            near = checkpoint(near)
        deal = blocks.plan(counted.where(F.col("n") <= fits), [], keys, F.lit(False), fits)
        own = near.join(large, keys, "left_anti") if some else near
        own = deal.bucketed(own.withColumnRenamed("query_id", blocks._Q).withColumn(blocks._KIND, F.lit(0)))
        schema = StructType([*kinds, *ends])
        out = blocks.gathered(own.select(blocks._BUCKET, blocks._KIND, *keys, blocks._Q, "near"), deal.buckets, keys).mapInArrow(linking.walked_clouds(keys, blocks._arrow(schema)), schema)
        if some:
            rest = near.join(large, keys, "left_semi")
            edges = rest.select(F.struct(*keys, F.col("query_id").alias("point_id")).alias("a"), *keys, F.explode("near.point_id").alias("point_id")).select("a", F.struct(*keys, "point_id").alias("b"))
            out = out.unionByName(_least(rest.withColumnRenamed("query_id", "point_id"), keys, edges))
        return out
    p, _, columns = blocks._sides(part, q, keys, limit)
    deal = blocks.plan(counted, [p], keys, F.col("n") > fits, fits)
    p = deal.bucketed(p).select(*columns)
    if deal.tree is not None:
        p = blocks._placed(p, deal.tree, deal.few, (limit, "l2"))
    schema = StructType([*kinds, *ends, StructField(blocks._NO, IntegerType())])
    out = blocks.gathered(p, deal.buckets, keys).mapInArrow(linking.linked_clouds(keys, blocks._P, radius, strict, blocks._arrow(schema)), schema)
    if deal.tree is None:
        return out.drop(blocks._NO)
    out = checkpoint(out)
    star = out.where(F.col(blocks._NO).isNotNull())
    edges = star.select(F.struct(*keys, "point_id").alias("a"), F.struct(*keys, F.col("seed").alias("point_id")).alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return out.where(F.col(blocks._NO).isNull()).drop(blocks._NO).unionByName(_least(star, keys, edges))


def _numbered(found: DataFrame, group: list[str], order: list[str], least: int) -> DataFrame:
    """Clusters of at least ``least`` members, numbered from 0 in the given order; numbers are made from one row a cluster."""
    found = checkpoint(found)  # read twice below
    size = found.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = with_sum_before(size.drop("n"), order, F.lit(1), "cluster_id")
    return found.join(numbered, group)


def grow_proximity(points: DataFrame, nsample: int | None = 16, radius: float = 0.02, min_cluster_size: int = 32, bound: str = "strict") -> DataFrame:
    """cluster_id, cloud_id, point_id of clusters grown through neighbours within the radius.

    With ``nsample`` each point lists its nearest neighbours only, and growth follows the lists from ascending seeds;
    with None all neighbours count and clusters are connected components. Clusters are numbered by cloud and seed.
    Points without finite coordinates belong to none; a repeated point_id of a cloud is one point; no points, no rows.
    """
    found = _grown(as_points(points), ["cloud_id"], nsample, radius, bound)
    return _numbered(found, ["cloud_id", "seed"], ["cloud_id", "seed"], min_cluster_size).select("cluster_id", "cloud_id", "point_id")


def region_grow(points: DataFrame, ignore_labels: list[int] | tuple = (), nsample: int | None = 16, radius: float = 0.02, min_cluster_size: int = 32, bound: str = "strict") -> DataFrame:
    """The same within each label (column label), ignored labels left out: cluster_id, label, cloud_id, point_id.

    Clusters are numbered by label and then by their smallest point.
    """
    p = as_points(points, "point_id", "label")
    if ignore_labels:
        p = p.where(~F.col("label").isin(*ignore_labels))
    found = _grown(p, ["label", "cloud_id"], nsample, radius, bound)
    return _numbered(found, ["label", "cloud_id", "seed"], ["label", "seed", "cloud_id"], min_cluster_size).select("cluster_id", "label", "cloud_id", "point_id")

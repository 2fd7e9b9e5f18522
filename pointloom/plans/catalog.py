"""Queries of the point-cloud operators over the tables and their SQL, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import cluster, grid, interpolate, metrics, neighbors, sampling
from pointloom.sources import frames

R = 0.2


def _rounded(df, *columns):
    """Sums depend on their order in the last bits; -0 becomes 0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _split(spark, d):
    """Support points and queries: every point of the first three dimensions, asked for by every point of the next three."""
    return frames.embedding_points(spark, d), frames.embedding_points(spark, d, first=3).withColumnRenamed("point_id", "query_id")


def _ball(**how):
    return lambda spark, d: neighbors.ball_query(*_split(spark, d), **{"radius": R, "nsample": 8, **how})


def _padded(layout):
    def run(spark, d):
        p, q = _split(spark, d)
        out = neighbors.padded(neighbors.ball_query(p, q, 0.1, 4), q, 4, layout)
        return out.select("cloud_id", "query_id", F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"), *(F.get("dist2", F.lit(i)).alias(f"d{i}") for i in range(4)))

    return run


def _weights(spark, d):
    p, q = _split(spark, d)
    return interpolate.inverse_distance_weights(neighbors.three_nn(q, p))


def _interpolated(spark, d):
    return interpolate.three_interpolate(frames.embedding_features(spark, d), _weights(spark, d), strict=True)


def _interpolated_grad(spark, d):
    p, q = _split(spark, d)
    grad = q.select("cloud_id", "query_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("channel")).withColumn("grad", (F.col("query_id") % 7 + F.col("channel")).cast("double"))
    return interpolate.three_interpolate_grad(grad, _weights(spark, d), p)


def _grouped(spark, d):
    p, q = _split(spark, d)
    groups = neighbors.ball_query(p, q, R, 8).withColumnRenamed("query_id", "group_id")
    return interpolate.grouping(frames.embedding_features(spark, d), groups)


def _labelled(spark, d):
    return frames.embedding_points(spark, d).withColumn("label", F.col("point_id") % 2)


def _scaled(spark, d):
    """Clouds small enough for the default radius."""
    return frames.embedding_points(spark, d).withColumns({c: F.col(c) / 10 for c in "xyz"})


def _iou(eps):
    def run(spark, d):
        p = frames.embedding_points(spark, d).select("cloud_id", "point_id")
        return metrics.instance_iou(p.withColumn("proposal_id", F.col("cloud_id") * 7 + F.col("point_id") % 7), p.withColumn("instance_id", F.col("point_id") % 4), eps)

    return run


def _sides(spark, d):
    """Two clouds of each label: all points of the first three dimensions and of the next three."""
    return frames.embedding_points(spark, d), frames.embedding_points(spark, d, first=3)


def _voxels(spark, d):
    g = grid.gridding(frames.embedding_points(spark, d), 4)
    return g.select("cloud_id", "vertex", F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("channel"), (F.col("weight") * (c + 1)).alias("value")) for c in (0, 1)])))


def _cubic(n):
    return lambda spark, d: _rounded(grid.cubic_feature_sampling(frames.embedding_points(spark, d), _voxels(spark, d), 8, n), "value")


def _cubic_grad(spark, d):
    v = grid.cubic_vertices(frames.embedding_points(spark, d), 8, 1)
    g = v.select("cloud_id", "point_id", "slot", F.lit(0).cast("long").alias("channel"), ((F.col("point_id") % 5) + F.col("slot")).cast("double").alias("grad"))
    return grid.cubic_feature_sampling_grad(v, g)


def _grad_grid(spark, d):
    return grid.gridding(frames.embedding_points(spark, d), 8).select("cloud_id", "vertex", (F.col("vertex") % 7 - 3).cast("double").alias("grad"))


QUERIES = {
    "ball_dense": _ball(),
    "ball_partial": _ball(radius=0.3, nsample=16, strict_clouds=True),
    "ball_inclusive": _ball(bound="inclusive", nsample=5),
    "ball_index_order": _ball(order="index"),
    "ball_unlimited": _ball(nsample=None),
    "ball_l1": _ball(metric="l1", nsample=6),
    "ball_hash_order": lambda spark, d: _ball(order="hash", nsample=None, seed=3)(spark, d).groupBy("cloud_id", "query_id").agg(F.count("*").alias("hits"), F.max("rank").alias("last_rank")),
    "ball_padded": _padded("dense"),
    "ball_padded_partial": _padded("partial"),
    "ball_single_cloud": lambda spark, d: neighbors.ball_query(*(x.withColumn("cloud_id", F.lit(0).cast("long")) for x in _split(spark, d)), radius=0.1, nsample=8),
    "knn_k5": lambda spark, d: neighbors.knn(*_split(spark, d), 5),
    "knn_cells": lambda spark, d: neighbors.knn(*_split(spark, d), 5, small=0),
    "knn_events": lambda spark, d: neighbors.knn(frames.event_points(spark, d), frames.event_points(spark, d).withColumnRenamed("point_id", "query_id"), 3),
    "three_nn": lambda spark, d: neighbors.three_nn(*reversed(_split(spark, d))),
    "idw_weights": lambda spark, d: _rounded(_weights(spark, d), "weight"),
    "three_interpolate": lambda spark, d: _rounded(_interpolated(spark, d), "value"),
    "three_interpolate_grad": lambda spark, d: _rounded(_interpolated_grad(spark, d), "grad"),
    "grouping": _grouped,
    "fps_cloud": lambda spark, d: sampling.furthest_point_sample(frames.embedding_points(spark, d), 8),
    "fps_skip_origin": lambda spark, d: sampling.furthest_point_sample(frames.embedding_points(spark, d), 8, skip_near_origin=True),
    "fps_distributed": lambda spark, d: sampling.furthest_point_sample(frames.embedding_points(spark, d), 4, huge=0),
    "grow_proximity": lambda spark, d: cluster.grow_proximity(frames.embedding_points(spark, d), None, 0.12, 2),
    "region_grow": lambda spark, d: cluster.region_grow(_labelled(spark, d), (), None, 0.12, 1),
    "region_grow_ignore": lambda spark, d: cluster.region_grow(_labelled(spark, d), (1,), None, 0.15, 3),
    "region_grow_capped": lambda spark, d: cluster.region_grow(_labelled(spark, d), (), 4, 0.15, 2),
    "grow_proximity_capped": lambda spark, d: cluster.grow_proximity(frames.embedding_points(spark, d), 3, 0.15, 2),
    "grow_proximity_default": lambda spark, d: cluster.grow_proximity(_scaled(spark, d), min_cluster_size=2),
    "instance_iou": lambda spark, d: _rounded(_iou(0.0)(spark, d), "iou"),
    "instance_iou_eps": lambda spark, d: _rounded(_iou(1e-5)(spark, d), "iou"),
    "chamfer": lambda spark, d: _rounded(metrics.chamfer_dist(*_sides(spark, d)), "chamfer"),
    "chamfer_clouds": lambda spark, d: _rounded(metrics.chamfer_dist(*_sides(spark, d), per_cloud=True), "chamfer"),
    "chamfer_ignore_zeros": lambda spark, d: _rounded(metrics.chamfer_dist(*(x.withColumn("z", F.when(F.col("point_id") % 9 < 2, -F.col("x") - F.col("y")).otherwise(F.col("z"))) for x in _sides(spark, d)), ignore_zeros=True), "chamfer"),
    "chamfer_points": lambda spark, d: metrics.chamfer_points(*_sides(spark, d)),
    "chamfer_grad": lambda spark, d: _rounded(metrics.chamfer_grad(*_sides(spark, d)), "gx", "gy", "gz"),
    "zero_point_filter": lambda spark, d: metrics.drop_zero_points(frames.embedding_points(spark, d).withColumn("z", F.when(F.col("point_id") % 3 == 0, F.lit(0.0) - (F.col("x") + F.col("y"))).otherwise(F.col("z")))),
    "rescale": lambda spark, d: grid.rescaled(frames.embedding_points(spark, d), 4.0, 4.0),
    "gridding": lambda spark, d: _rounded(grid.gridding(frames.embedding_points(spark, d), 8), "weight"),
    "gridding_points": lambda spark, d: grid.gridding_points(frames.embedding_points(spark, d), 8),
    "gridding_grad": lambda spark, d: _rounded(grid.gridding_grad(frames.embedding_points(spark, d), _grad_grid(spark, d), 8), "gx", "gy", "gz"),
    "cubic_ns1": _cubic(1),
    "cubic_ns2": _cubic(2),
    "cubic_vertices": lambda spark, d: grid.cubic_vertices(frames.embedding_points(spark, d), 8, 2),
    "cubic_grad": _cubic_grad,
    "degree": lambda spark, d: neighbors.degree(frames.event_points(spark, d)),
    "batch_offsets": lambda spark, d: neighbors.batch_offsets(frames.event_points(spark, d)),
    "dense_batch_ids": lambda spark, d: neighbors.dense_cloud_ids(frames.event_points(spark, d).withColumn("cloud_id", F.col("cloud_id") * 3 + 1)),
}

_P = "p AS (SELECT CAST(label AS BIGINT) AS cloud_id, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_P2 = _P.replace("p AS", "p2 AS").replace("[3]", "[6]").replace("[2]", "[5]").replace("[1]", "[4]")
_S = f"{_P}, {_P2}, s AS (SELECT * FROM p), q AS (SELECT cloud_id, point_id AS query_id, x, y, z FROM p2)"
_E = "e AS (SELECT CAST(user_id AS BIGINT) AS cloud_id, event_id AS point_id, CAST(value / 600 AS DOUBLE) AS x, hour(ts) / CAST(24 AS DOUBLE) AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS z FROM events)"
_F = "f AS (SELECT CAST(label AS BIGINT) AS cloud_id, vec_id AS point_id, CAST(c AS BIGINT) AS channel, CAST(embedding[c + 4] AS DOUBLE) AS value FROM embeddings, range(8) AS r(c))"


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")


def _round(x: str) -> str:
    return f"round({x}, 6) + CAST(0 AS DOUBLE)"


def _double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _hits(radius: float, test: str = "<", on: str = "USING (cloud_id)", cloud: str = "q.cloud_id", d: str | None = None, limit: float | None = None) -> str:
    d = d or _d2("q", "s")
    return f"h AS (SELECT {cloud} AS cloud_id, q.query_id, s.point_id, {d} AS dist2 FROM q JOIN s {on} WHERE {d} {test} {_double(radius * radius if limit is None else limit)})"


def _rank(source: str, order: str, most: int | None) -> str:
    own = f"SELECT cloud_id, query_id, CAST(row_number() OVER (PARTITION BY cloud_id, query_id ORDER BY {order}) - 1 AS BIGINT) AS rank, point_id, dist2 FROM {source}"
    return f"SELECT * FROM ({own})" + ("" if most is None else f" WHERE rank < {most}")


def _ball_sql(radius: float = R, most: int | None = 8, order: str = "dist2, point_id", **how) -> str:
    return f"WITH {_S}, {_hits(radius, **how)} {_rank('h', order, most)}"


_ALL = f"h AS (SELECT q.cloud_id, q.query_id, s.point_id, {_d2('q', 's')} AS dist2 FROM q JOIN s USING (cloud_id))"
_W3 = f"{_S}, {_ALL}, n AS ({_rank('h', 'dist2, point_id', 3)}), i AS (SELECT cloud_id, query_id, rank, point_id, 1 / (sqrt(dist2) + {_double(1e-8)}) AS w FROM n), w AS (SELECT cloud_id, query_id, rank, point_id, w / sum(w) OVER (PARTITION BY cloud_id, query_id) AS weight FROM i)"


def _padded_sql(fill: str) -> str:
    n = f"n AS ({_rank('h', 'dist2, point_id', 4)})"
    idx = "|| ',' ||".join(f"CAST(COALESCE(max(CASE WHEN rank = {i} THEN point_id END), {fill}) AS VARCHAR)" for i in range(4))
    ds = ", ".join(f"COALESCE(max(CASE WHEN rank = {i} THEN dist2 END), CAST(-1 AS DOUBLE)) AS d{i}" for i in range(4))
    return f"WITH {_S}, {_hits(0.1)}, {n} SELECT q.cloud_id, q.query_id, {idx} AS idx, {ds} FROM q LEFT JOIN n ON q.cloud_id = n.cloud_id AND q.query_id = n.query_id GROUP BY q.cloud_id, q.query_id"


def _fps_sql(picks: int, skip: bool) -> str:
    allowed = "(x * x + y * y + z * z > CAST('0.001' AS DOUBLE))" if skip else "TRUE"
    order = f"PARTITION BY cloud_id ORDER BY {allowed} DESC, m DESC, point_id"
    d = " + ".join(f"({c} - n{c}) * ({c} - n{c})" for c in "xyz")
    return f"""WITH RECURSIVE {_P}, t AS (
  SELECT 0 AS step, cloud_id, point_id, x, y, z, CAST('inf' AS DOUBLE) AS m, min(point_id) OVER (PARTITION BY cloud_id) AS sel,
    arg_min(x, point_id) OVER (PARTITION BY cloud_id) AS nx, arg_min(y, point_id) OVER (PARTITION BY cloud_id) AS ny, arg_min(z, point_id) OVER (PARTITION BY cloud_id) AS nz FROM p
  UNION ALL
  SELECT step + 1, cloud_id, point_id, x, y, z, m, first_value(point_id) OVER w, first_value(x) OVER w, first_value(y) OVER w, first_value(z) OVER w
  FROM (SELECT step, cloud_id, point_id, x, y, z, least(m, {d}) AS m FROM t WHERE step < {picks - 1}) WINDOW w AS ({order}))
SELECT DISTINCT cloud_id, CAST(step AS BIGINT) AS rank, sel AS point_id FROM t"""


def _grow_sql(radius: float, least: int, ignore: str = "FALSE", label: str = "point_id % 2", with_label: bool = True, most: int | None = None, points: str = "p") -> str:
    order = "label, seed, cloud_id" if with_label else "cloud_id, seed"
    names = "cluster_id, label, cloud_id, point_id" if with_label else "cluster_id, cloud_id, point_id"
    nearest = f"row_number() OVER (PARTITION BY a.point_id ORDER BY {_d2('a', 'b')}, b.point_id)"
    capped = "" if most is None else f" QUALIFY {nearest} <= {most}"
    return f"""WITH RECURSIVE {_P}, l AS (SELECT *, {label} AS label FROM {points} WHERE NOT ({ignore})),
edge AS (SELECT a.point_id AS a, b.point_id AS b FROM l a JOIN l b ON a.cloud_id = b.cloud_id AND a.label = b.label WHERE {_d2('a', 'b')} < {_double(radius * radius)}{capped}),
reach AS (SELECT point_id AS a, point_id AS b FROM l UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
c AS (SELECT b AS point_id, min(a) AS seed FROM reach GROUP BY b),
m AS (SELECT l.label, l.cloud_id, l.point_id, c.seed, count(*) OVER (PARTITION BY c.seed) AS n FROM l JOIN c USING (point_id))
SELECT {names} FROM (SELECT CAST(dense_rank() OVER (ORDER BY {order}) - 1 AS BIGINT) AS cluster_id, label, cloud_id, point_id FROM m WHERE n >= {least})"""


def _iou_sql(eps: float) -> str:
    return f"""WITH {_P}, g AS (SELECT cloud_id, point_id, point_id % 4 AS inst, cloud_id * 7 + point_id % 7 AS proposal_id FROM p),
top AS (SELECT cloud_id, max(inst) AS top FROM g GROUP BY cloud_id),
off AS (SELECT cloud_id, top, sum(top) OVER (ORDER BY cloud_id) - top AS before FROM top),
sp AS (SELECT cloud_id, i AS instance_id, CAST(before + i - 1 AS BIGINT) AS gt_col FROM off, range(1, 100) AS r(i) WHERE i <= top),
gs AS (SELECT cloud_id, inst AS instance_id, count(*) AS gn FROM g WHERE inst > 0 GROUP BY ALL),
ps AS (SELECT proposal_id, cloud_id, count(*) AS pn FROM g GROUP BY ALL),
sh AS (SELECT proposal_id, inst AS instance_id, count(*) AS n FROM g WHERE inst > 0 GROUP BY ALL)
SELECT ps.proposal_id, sp.gt_col, ps.cloud_id, sp.instance_id, {_round(f'CASE WHEN COALESCE(n, 0) > 0 THEN n / (pn + COALESCE(gn, 0) - n + {_double(eps)}) ELSE CAST(0 AS DOUBLE) END')} AS iou
FROM ps JOIN sp USING (cloud_id) LEFT JOIN gs ON gs.cloud_id = sp.cloud_id AND gs.instance_id = sp.instance_id LEFT JOIN sh ON sh.proposal_id = ps.proposal_id AND sh.instance_id = sp.instance_id"""


def _chamfer_cte(a: str = "SELECT * FROM p", b: str = "SELECT * FROM p2") -> str:
    one = lambda side, u, v: f"SELECT {side} AS side, {u}.cloud_id, {u}.point_id, {v}.point_id AS match_id, {_d2(u, v)} AS dist2, row_number() OVER (PARTITION BY {u}.cloud_id, {u}.point_id ORDER BY {_d2(u, v)}, {v}.point_id) AS rn FROM {u} JOIN {v} USING (cloud_id)"
    return f"{_P}, {_P2}, a AS ({a}), b AS ({b}), cp AS (SELECT CAST(side AS BIGINT) AS side, cloud_id, point_id, match_id, dist2 FROM ({one(1, 'a', 'b')} UNION ALL {one(2, 'b', 'a')}) WHERE rn = 1)"


_CHAMFER = "avg(CASE WHEN side = 1 THEN dist2 END) + avg(CASE WHEN side = 2 THEN dist2 END)"
_ZEROED = "SELECT * FROM (SELECT cloud_id, point_id, x, y, CASE WHEN point_id % 9 < 2 THEN -x - y ELSE z END AS z FROM {}) WHERE x + y + z <> 0"


def _corner_cte(scale: int) -> str:
    side = 2 * scale
    axis = lambda c, bit: f"CASE WHEN (k // {bit}) % 2 = 0 THEN CAST(floor({c}) AS BIGINT) WHEN ceil({c}) = floor({c}) THEN CAST(floor({c}) AS BIGINT) + 1 ELSE CAST(ceil({c}) AS BIGINT) END"
    return f"""{_P}, u AS (SELECT cloud_id, point_id, x * {_double(float(scale))} AS x, y * {_double(float(scale))} AS y, z * {_double(float(scale))} AS z FROM p), v AS (SELECT * FROM u WHERE x + y + z <> 0),
c AS (SELECT cloud_id, point_id, k, x, y, z, {axis('x', 4)} AS ax, {axis('y', 2)} AS ay, {axis('z', 1)} AS az FROM v, range(8) AS r(k)),
gp AS (SELECT cloud_id, point_id, CAST(k AS BIGINT) AS corner, (ax + {scale}) * {side * side} + (ay + {scale}) * {side} + (az + {scale}) AS vertex, 1 - abs(x - ax) AS wx, 1 - abs(y - ay) AS wy, 1 - abs(z - az) AS wz FROM c),
gr AS (SELECT cloud_id, vertex, sum(wx * wy * wz) AS weight FROM gp GROUP BY cloud_id, vertex)"""


def _cubic_cte(n: int) -> str:
    w, m = 2 * n, 8
    low = lambda c: f"CAST(floor({c} * CAST(4 AS DOUBLE) + CAST(4 AS DOUBLE)) AS BIGINT) - {n - 1}"
    return f"""{_corner_cte(4)}, vox AS (SELECT cloud_id, vertex, ch AS channel, weight * (ch + 1) AS value FROM gr, range(2) AS r(ch)),
lo AS (SELECT cloud_id, point_id, {low('x')} AS lx, {low('y')} AS ly, {low('z')} AS lz FROM p),
near AS (SELECT cloud_id, point_id, slot, lx + slot // {w * w} AS ix, ly + (slot // {w}) % {w} AS iy, lz + slot % {w} AS iz FROM lo, range({w**3}) AS r(slot)),
cv AS (SELECT cloud_id, point_id, CAST(slot AS BIGINT) AS slot, CASE WHEN ix >= 0 AND ix < {m} AND iy >= 0 AND iy < {m} AND iz >= 0 AND iz < {m} THEN (ix * {m} + iy) * {m} + iz ELSE -1 END AS vertex FROM near)"""


def _cubic_sql(n: int) -> str:
    return f"WITH {_cubic_cte(n)} SELECT cv.cloud_id, cv.point_id, cv.slot, CAST(ch.channel AS BIGINT) AS channel, {_round('COALESCE(vox.value, CAST(0 AS DOUBLE))')} AS value FROM cv JOIN (SELECT DISTINCT cloud_id, channel FROM vox) ch ON ch.cloud_id = cv.cloud_id LEFT JOIN vox ON vox.cloud_id = cv.cloud_id AND vox.vertex = cv.vertex AND vox.channel = ch.channel"


_KNN = f"WITH {_S}, {_ALL} {_rank('h', 'dist2, point_id', 5)}"
_SIGN = {"x": "corner // 4", "y": "corner // 2", "z": "corner"}
_REST = {"x": "wy * wz", "y": "wx * wz", "z": "wx * wy"}
_L1 = " + ".join(f"abs(q.{c} - s.{c})" for c in "xyz")

ORACLES = {
    "ball_dense": _ball_sql(),
    "ball_partial": _ball_sql(0.3, 16),
    "ball_inclusive": _ball_sql(most=5, test="<="),
    "ball_index_order": _ball_sql(order="point_id"),
    "ball_unlimited": _ball_sql(most=None),
    "ball_l1": _ball_sql(most=6, d=_L1, limit=R),
    "ball_hash_order": f"WITH {_S}, {_hits(R)} SELECT cloud_id, query_id, count(*) AS hits, count(*) - 1 AS last_rank FROM h GROUP BY cloud_id, query_id",
    "ball_padded": _padded_sql("max(CASE WHEN rank = 0 THEN point_id END), 0"),
    "ball_padded_partial": _padded_sql("-1"),
    "ball_single_cloud": _ball_sql(0.1, on="ON TRUE", cloud="CAST(0 AS BIGINT)"),
    "knn_k5": _KNN,
    "knn_cells": _KNN,
    "knn_events": f"WITH {_E}, h AS (SELECT q.cloud_id, q.point_id AS query_id, s.point_id, {_d2('q', 's')} AS dist2 FROM e q JOIN e s USING (cloud_id)) {_rank('h', 'dist2, point_id', 3)}",
    "three_nn": f"WITH {_S}, {_ALL}, n AS ({_rank('h', 'dist2, point_id', 3)}) SELECT cloud_id, query_id, rank, point_id, sqrt(dist2) AS dist FROM n",
    "idw_weights": f"WITH {_W3} SELECT cloud_id, query_id, rank, point_id, {_round('weight')} AS weight FROM w",
    "three_interpolate": f"WITH {_W3}, {_F} SELECT w.cloud_id, w.query_id, f.channel, {_round('sum(f.value * w.weight)')} AS value FROM w JOIN f USING (cloud_id, point_id) GROUP BY ALL",
    "three_interpolate_grad": f"WITH {_W3}, g AS (SELECT w.cloud_id, w.point_id, c AS channel, sum((w.query_id % 7 + c) * w.weight) AS grad FROM w, range(2) AS r(c) GROUP BY ALL) SELECT s.cloud_id, s.point_id, c AS channel, {_round('COALESCE(g.grad, CAST(0 AS DOUBLE))')} AS grad FROM s CROSS JOIN range(2) AS r(c) LEFT JOIN g ON g.cloud_id = s.cloud_id AND g.point_id = s.point_id AND g.channel = c",
    "grouping": f"WITH {_S}, {_F}, {_hits(R)}, n AS ({_rank('h', 'dist2, point_id', 8)}) SELECT n.cloud_id, n.query_id AS group_id, n.rank, f.channel, f.value FROM n JOIN f USING (cloud_id, point_id)",
    "fps_cloud": _fps_sql(8, False),
    "fps_skip_origin": _fps_sql(8, True),
    "fps_distributed": _fps_sql(4, False),
    "grow_proximity": _grow_sql(0.12, 2, label="0", with_label=False),
    "region_grow": _grow_sql(0.12, 1),
    "region_grow_ignore": _grow_sql(0.15, 3, ignore="point_id % 2 = 1"),
    "region_grow_capped": _grow_sql(0.15, 2, most=4),
    "grow_proximity_capped": _grow_sql(0.15, 2, label="0", with_label=False, most=3),
    "grow_proximity_default": _grow_sql(0.02, 2, label="0", with_label=False, most=16, points="(SELECT cloud_id, point_id, x / CAST(10 AS DOUBLE) AS x, y / CAST(10 AS DOUBLE) AS y, z / CAST(10 AS DOUBLE) AS z FROM p)"),
    "instance_iou": _iou_sql(0.0),
    "instance_iou_eps": _iou_sql(1e-5),
    "chamfer": f"WITH {_chamfer_cte()} SELECT {_round(_CHAMFER)} AS chamfer FROM cp",
    "chamfer_clouds": f"WITH {_chamfer_cte()} SELECT cloud_id, {_round(_CHAMFER)} AS chamfer FROM cp GROUP BY cloud_id",
    "chamfer_ignore_zeros": f"WITH {_chamfer_cte(_ZEROED.format('p'), _ZEROED.format('p2'))} SELECT {_round(_CHAMFER)} AS chamfer FROM cp",
    "chamfer_points": f"WITH {_chamfer_cte()} SELECT * FROM cp",
    "chamfer_grad": f"WITH {_chamfer_cte()}, g AS (SELECT side, 1 / CAST(count(*) AS DOUBLE) AS g FROM cp GROUP BY side), t AS (SELECT CAST(1 AS BIGINT) AS side, * FROM a UNION ALL SELECT 2, * FROM b), u AS (SELECT cp.side, cp.cloud_id, cp.point_id, cp.match_id, {', '.join(f'2 * g.g * (o.{c} - m.{c}) AS g{c}' for c in 'xyz')} FROM cp JOIN g USING (side) JOIN t o ON o.side = cp.side AND o.cloud_id = cp.cloud_id AND o.point_id = cp.point_id JOIN t m ON m.side = 3 - cp.side AND m.cloud_id = cp.cloud_id AND m.point_id = cp.match_id), v AS (SELECT side, cloud_id, point_id, gx, gy, gz FROM u UNION ALL SELECT 3 - side, cloud_id, match_id, -gx, -gy, -gz FROM u) SELECT side, cloud_id, point_id, {', '.join(_round(f'sum(g{c})') + f' AS g{c}' for c in 'xyz')} FROM v GROUP BY side, cloud_id, point_id",
    "zero_point_filter": f"WITH {_P}, m AS (SELECT cloud_id, point_id, x, y, CASE WHEN point_id % 3 = 0 THEN CAST(0 AS DOUBLE) - (x + y) ELSE z END AS z FROM p) SELECT * FROM m WHERE x + y + z <> 0",
    "rescale": f"WITH {_P} SELECT cloud_id, point_id, {', '.join(f'{c} * CAST(4 AS DOUBLE) + CAST(4 AS DOUBLE) AS {c}' for c in 'xyz')} FROM p",
    "gridding": f"WITH {_corner_cte(8)} SELECT cloud_id, vertex, {_round('weight')} AS weight FROM gr",
    "gridding_points": f"WITH {_corner_cte(8)} SELECT * FROM gp",
    "gridding_grad": f"WITH {_corner_cte(8)} SELECT cloud_id, point_id, {', '.join(_round(f'sum((CASE WHEN ({_SIGN[c]}) % 2 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) * (vertex % 7 - 3) * {_REST[c]}) * CAST(8 AS DOUBLE)') + f' AS g{c}' for c in 'xyz')} FROM gp GROUP BY cloud_id, point_id",
    "cubic_ns1": _cubic_sql(1),
    "cubic_ns2": _cubic_sql(2),
    "cubic_vertices": f"WITH {_cubic_cte(2)} SELECT * FROM cv",
    "cubic_grad": f"WITH {_cubic_cte(1)} SELECT cloud_id, vertex, CAST(0 AS BIGINT) AS channel, CAST(sum(point_id % 5 + slot) AS DOUBLE) AS grad FROM cv WHERE vertex >= 0 GROUP BY cloud_id, vertex",
    "degree": f"WITH {_E} SELECT cloud_id, count(*) AS degree FROM e GROUP BY cloud_id",
    "batch_offsets": f"WITH {_E}, d AS (SELECT cloud_id, count(*) AS degree FROM e GROUP BY cloud_id) SELECT cloud_id, degree, CAST(sum(degree) OVER (ORDER BY cloud_id) - degree AS BIGINT) AS start FROM d",
    "dense_batch_ids": f"WITH {_E} SELECT cloud_id, CAST(row_number() OVER (ORDER BY cloud_id) - 1 AS BIGINT) AS dense_id FROM (SELECT DISTINCT cloud_id * 3 + 1 AS cloud_id FROM e)",
}

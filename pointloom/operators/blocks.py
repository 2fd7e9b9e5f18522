"""Exact searches by blocks: points and queries are dealt out once and met in a task, so that no pairs are shuffled.

Small clouds are dealt out whole, several to a block. Larger ones are split by a tree of planes made from a hashed sample
of their points (it only balances blocks; results don't depend on it). Nearest points are found in a query's own block
first; the query then visits the blocks that reach into the ball of its k-th neighbour. Where all points within a radius
are asked for, points are copied to each block whose region they reach. Queries of a crowded block are dealt to copies of
it. In a block, points lie in small leaves, and leaves that are too far are skipped. Bounds are worked out by the same rounded operations as distances, so that no tie is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from pointloom.operators.lineage import checkpoint

_LEAF, _GROUP, _BLOCK, _TOGETHER = 32, 64, 16_384, 40_000
_MOST_BROADCAST, _HITS = 100_000, 1 << 20
_BUCKET, _KIND, _P, _Q, _NO, _BOUND = "__bucket", "__kind", "__p", "__q", "__no", "__bound"


def _sum(parts: list[np.ndarray], metric: str) -> np.ndarray:
    """Distance from differences, added up in the order of ``geometry.dist2``."""
    x, y, z = (np.abs(p) for p in parts) if metric == "l1" else (p * p for p in parts)
    return x + y + z


@dataclass
class Tree:
    """Planes that split the large clouds; nodes of all clouds in common arrays, leaves numbered from 0."""

    axis: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    roots: np.ndarray
    leaves: int
    crowded: bool

    @classmethod
    def of(cls, samples: list[np.ndarray], counts: list[int], small: int) -> Tree:
        """From a sample and the number of points of each cloud; blocks are of some 16,384 points, or a quarter of a cloud."""
        rows, roots, leaves, crowded = [], [], 0, False
        for sample, n in zip(samples, counts, strict=True):
            most, share = min(_BLOCK, max(1, -(-n // 4))), n / max(1, len(sample))
            roots.append(len(rows))
            rows.append([-1, 0.0, -1, -1, -1, [-np.inf] * 3, [np.inf] * 3])
            todo = [(roots[-1], sample)]
            while todo:
                node, own = todo.pop()
                width = np.ptp(own, axis=0) if len(own) else np.zeros(3)
                axis = int(width.argmax())
                if len(own) * share <= most or not width[axis] > 0:
                    crowded |= len(own) * share > 4 * max(most, small)
                    rows[node][4], leaves = leaves, leaves + 1
                    continue
                x = own[:, axis]
                at = np.partition(x, len(x) // 2)[len(x) // 2]
                at = at if at > x.min() else x[x > at].min()
                low = x < at
                for side, part in ((2, own[low]), (3, own[~low])):
                    lo, hi = list(rows[node][5]), list(rows[node][6])
                    (hi if side == 2 else lo)[axis] = at
                    rows[node][side] = len(rows)
                    todo.append((len(rows), part))
                    rows.append([-1, 0.0, -1, -1, -1, lo, hi])
                rows[node][:2] = axis, at
        kinds = (np.int8, float, np.int64, np.int64, np.int64, float, float)
        return cls(*(np.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), np.array(roots, np.int64), leaves, crowded)

    def home(self, no: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """The leaf that each place lies in."""
        node = self.roots[no]
        while (inner := np.flatnonzero(self.axis[node] >= 0)).size:
            here = node[inner]
            node[inner] = np.where(xyz[inner, self.axis[here]] < self.at[here], self.left[here], self.right[here])
        return self.leaf[node]

    def reached(self, no: np.ndarray, xyz: np.ndarray, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf) of all leaves whose region is no further than each place's bound, ordered by place."""
        who, node, out = np.arange(len(no)), self.roots[no], []
        while len(who):
            gap = [np.maximum(np.maximum(self.lo[node, k] - xyz[who, k], xyz[who, k] - self.hi[node, k]), 0.0) for k in range(3)]
            near = _sum(gap, metric) <= bound[who]
            who, node = who[near], node[near]
            ends = self.axis[node] < 0
            out.append((who[ends], self.leaf[node[ends]]))
            who, node = who[~ends], node[~ends]
            who, node = np.concatenate([who, who]), np.concatenate([self.left[node], self.right[node]])
        place, leaf = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(place, kind="stable")
        return place[order], leaf[order]


def _halved(xyz: np.ndarray, size: int) -> np.ndarray:
    """An order in which each ``size`` rows lie together: rows halved along their widest axis, over and over."""
    todo, out = [np.arange(len(xyz))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        half = -(-len(own) // (2 * size)) * size
        here = xyz[own]
        by = np.argpartition(here[:, int((here.max(0) - here.min(0)).argmax())], half - 1)
        todo += [own[by[half:]], own[by[:half]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * _P2
    v = (v ^ (v >> np.uint64(29))) * _P3
    return v ^ (v >> np.uint64(32))


def _hash_part(v: np.ndarray) -> np.ndarray:
    return _turn(v.astype(np.int64).view(np.uint64) * _P2, 31) * _P1


def _hash_long(part: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long (by its ``_hash_part``) on top of a seed."""
    return _mixed(_turn((seed + _P5 + np.uint64(8)) ^ part, 27) * _P1 + _P4)


def _hash_int(v: int) -> np.ndarray:
    """Spark's xxhash64 of an int on top of its usual seed of 42."""
    h = (np.array([42], np.uint64) + _P5 + np.uint64(4)) ^ (np.array([v & 0xFFFFFFFF], np.uint64) * _P1)
    return _mixed(_turn(h, 23) * _P2 + _P3)


class Unit:
    """The points of one cloud in a block, ordered by their ids; positions count from ``base``."""

    def __init__(self, xyz: np.ndarray, base: int, most: int | None):
        n, self.base, self.own = len(xyz), base, xyz
        pos = np.arange(n)
        if n <= 2 * _LEAF:
            self.xyz, self.pos = xyz[None], pos[None]
            self.leaf_lo, self.leaf_hi = xyz.min(0)[None], xyz.max(0)[None]
            return
        if most is not None and n > most:  # of points in one place only the first ones can be among the nearest
            by = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0]))
            same = np.r_[False, (xyz[by[1:]] == xyz[by[:-1]]).all(1)]
            starts = np.maximum.accumulate(np.where(same, 0, pos))
            pos = np.sort(by[pos - starts < most])
            xyz = xyz[pos]
        along = _halved(xyz, _LEAF)
        pad = -len(xyz) % _LEAF
        self.xyz = np.concatenate([xyz[along], np.full((pad, 3), np.nan)]).reshape(-1, _LEAF, 3)
        self.pos = np.concatenate([pos[along], np.full(pad, -1)]).reshape(-1, _LEAF)
        self.leaf_lo, self.leaf_hi = np.fmin.reduce(self.xyz, axis=1), np.fmax.reduce(self.xyz, axis=1)

    def far(self, lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
        """Least distance of each leaf (columns) to boxes."""
        return _sum([np.maximum(np.maximum(self.leaf_lo[None, :, k] - hi[:, k, None], lo[:, k, None] - self.leaf_hi[None, :, k]), 0.0) for k in range(3)], metric)


def _firsts(row: np.ndarray) -> np.ndarray:
    """Number of each entry within its run of equal ones."""
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], at, 0)) if len(row) else at


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _nearest(unit: Unit, q: np.ndarray, bound: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, position, distance) of the nearest ``most`` points, by query and rank."""
    k, leaves, size = spec.most, *unit.pos.shape
    enough = 1 + (k - 1) // size
    step = max(16, (1 << 18) // (leaves + enough * size))
    for a in range(0, len(q), step):
        own, cut = q[a : a + step], bound[a : a + step]
        if enough >= leaves:
            who, leaf = np.divmod(np.arange(len(own) * leaves), leaves)
        else:
            far = unit.far(own, own, spec.metric)
            first = far.argmin(1)[:, None] if enough == 1 else np.argpartition(far, enough - 1, axis=1)[:, :enough]
            d = _sum([own[:, i, None, None] - unit.xyz[first, :, i] for i in range(3)], spec.metric)
            cut = np.fmin(cut, _kth(d.reshape(len(own), -1), k))
            who, leaf = np.nonzero(far <= cut[:, None])
        found = []
        for s in range(0, len(who), 4096):
            i, j = who[s : s + 4096], leaf[s : s + 4096]
            d = _sum([own[i, c, None] - unit.xyz[j, :, c] for c in range(3)], spec.metric)
            if enough >= leaves == 1:
                cut[i] = np.fmin(cut[i], _kth(d, k))
            hit = d <= cut[i, None]
            if spec.strict:
                hit &= d < spec.limit
            r, c = np.nonzero(hit)
            found.append((i[r], unit.pos[j[r], c], d[r, c]))
        row, pos, d = (np.concatenate([f[i] for f in found]) if found else np.empty(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((pos, d, row))
        order = order[_firsts(row[order]) < k]
        yield row[order] + a, pos[order], d[order]


def _all_within(unit: Unit, q: np.ndarray, ids: np.ndarray, seeds: np.ndarray | None, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, position, distance) of all points within the radius, or the first ``most`` of them, by query and rank."""
    left = np.arange(len(q))
    if spec.order == "index" and spec.most is not None and len(unit.own) > 1024:  # most queries find enough among the first points
        first = unit.own[:512]
        for a in range(0, len(q), 256):
            d = _sum([q[a : a + 256, k, None] - first[None, :, k] for k in range(3)], spec.metric)
            hit = spec.inside(d)
            full = hit.sum(1) >= spec.most
            row, pos = np.nonzero(hit & full[:, None])
            keep = _firsts(row) < spec.most
            yield row[keep] + a, pos[keep], d[row[keep], pos[keep]]
            left[a : a + 256][full] = -1
        left = left[left >= 0]
    along = left[_halved(q[left], _GROUP)]
    for g in range(0, len(along), _GROUP):
        group = along[g : g + _GROUP]
        near = np.flatnonzero(unit.far(q[group].min(0)[None], q[group].max(0)[None], spec.metric)[0] <= spec.limit)
        if not len(near):
            continue
        pos = unit.pos[near].reshape(-1)
        by = np.argsort(pos)
        pos, p = pos[by], unit.xyz[near].reshape(-1, 3)[by].T.copy()
        step = max(1, (_HITS >> 2) // len(pos))
        for a in range(0, len(group), step):
            rows = group[a : a + step]
            d = _sum([q[rows, k, None] - p[None, k] for k in range(3)], spec.metric)
            i, j = np.nonzero(spec.inside(d))
            d, at = d[i, j], pos[j]
            if spec.order != "index":
                key = d if spec.order == "distance" else _hash_long(_hash_part(ids[at]), seeds[rows[i]]).view(np.int64)
                if len(i) < 200 * len(rows):
                    order = np.lexsort((key, i))  # stable: equal ones stay in the order of positions
                else:
                    ends = np.searchsorted(i, np.arange(len(rows) + 1))
                    order = np.concatenate([s + _sorted(key[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)])
                i, d, at = i[order], d[order], at[order]
            if spec.most is not None:
                keep = _firsts(i) < spec.most
                i, d, at = i[keep], d[keep], at[keep]
            yield rows[i], at, d


def _sorted(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    held = key[order]
    return order if (held[1:] != held[:-1]).all() else np.argsort(key, kind="stable")


@dataclass
class Spec:
    """What is searched for; goes to the tasks."""

    keys: list[str]
    most: int | None
    metric: str
    limit: float
    strict: bool
    order: str = "distance"
    seed: int = 0
    tree: Tree | None = None
    schema: pa.Schema | None = field(default=None)

    def inside(self, d: np.ndarray) -> np.ndarray:
        return d < self.limit if self.strict else d <= self.limit


def _xyz(table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in "xyz"], axis=1)


def runs(table: pa.Table, columns: list[str]) -> list[tuple[int, int, tuple]]:
    """(start, end, values) of runs of equal values of the columns."""
    n = table.num_rows
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    cols = [table.column(c).combine_chunks() for c in columns]
    for c in cols:
        if n > 1:
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    values = zip(*(c.take(pa.array(at)).to_pylist() for c in cols), strict=True)
    return list(zip(at.tolist(), [*at[1:].tolist(), n], values, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(bucket, kind, rows) of the runs within each batch of rows sorted by bucket and kind."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for a, b, (bucket, kind) in runs(table, [_BUCKET, _KIND]):
            yield bucket, kind, table.slice(a, b - a)


class _Bucket:
    """The points of a bucket, by cloud and id."""

    def __init__(self, held: list[pa.Table], spec: Spec):
        self.ids, self.numbers, self.units = None, None, {}
        if not held:
            return
        whole = pa.concat_tables(held).combine_chunks()
        clouds = runs(whole, spec.keys)
        codes = np.repeat(np.arange(len(clouds)), [b - a for a, b, _ in clouds])
        order = pc.sort_indices(pa.table({"c": codes, "i": whole.column(_P)}), sort_keys=[("c", "ascending"), ("i", "ascending")], null_placement="at_start")
        self.ids, xyz = whole.column(_P).combine_chunks().take(order), _xyz(whole)[order.to_numpy()]
        if spec.order == "hash":
            self.numbers = self.ids.to_numpy(zero_copy_only=False)
        self.units = {values: (xyz[a:b], a) for a, b, values in clouds}

    def unit(self, values: tuple, spec: Spec) -> Unit | None:
        unit = self.units.get(values)
        if isinstance(unit, tuple):
            unit = self.units[values] = Unit(*unit, spec.most if spec.order == "distance" else None)
        return unit


def _met(spec: Spec):
    """A function over sorted rows: loads a bucket's points, then answers its queries as they come."""

    def run(batches):
        bucket, held, points = None, [], None
        for own, kind, table in _blocks(batches):
            if own != bucket:
                bucket, held, points = own, [], None
            if kind == 0:
                held.append(table)
                continue
            if points is None:
                points, held = _Bucket(held, spec), []
            yield from _near(points, table, spec) if spec.most is not None and spec.order == "distance" else _hits(points, table, spec)

    return run


def _together(found: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(f) for f in zip(*found, strict=True)]


def _hits(points: _Bucket, table: pa.Table, spec: Spec) -> Iterator[pa.RecordBatch]:
    """Rows of ``ranked_within``: some hundred thousand at once."""
    q, ids = _xyz(table), table.column(_Q).combine_chunks()
    keys = [table.column(k).combine_chunks() for k in spec.keys]
    seeds = _hash_long(_hash_part(ids.to_numpy(zero_copy_only=False)), _hash_int(spec.seed)) if spec.order == "hash" else None

    def rows(found):
        row, pos, rank, d = _together(found)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), ids.take(at), pa.array(rank), points.ids.take(pa.array(pos)), pa.array(d)], schema=spec.schema)

    found, size = [], 0
    for a, b, values in runs(table, spec.keys):
        unit = points.unit(values, spec)
        if unit is None:
            continue
        own = points.numbers[unit.base : unit.base + len(unit.own)] if spec.order == "hash" else None
        for row, pos, d in _all_within(unit, q[a:b], own, None if seeds is None else seeds[a:b], spec):
            if len(row):
                found.append((row + a, pos + unit.base, _firsts(row), d))
                size += len(row)
            if size >= _HITS >> 2:
                yield rows(found)
                found, size = [], 0
    if size:
        yield rows(found)


def _near(points: _Bucket, table: pa.Table, spec: Spec) -> Iterator[pa.RecordBatch]:
    """Rows of ``nearest``, with the other leaves to visit where clouds are split."""
    q, ids, bound = _xyz(table), table.column(_Q).combine_chunks(), table.column(_BOUND).to_numpy().copy()
    keys = [table.column(k).combine_chunks() for k in spec.keys]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for a, b, values in runs(table, spec.keys):
        unit = points.unit(values, spec)
        if unit is not None:
            found += [(row + a, pos + unit.base, d) for row, pos, d in _nearest(unit, q[a:b], bound[a:b].copy(), spec)]
    row, pos, d = _together(found)
    many = np.bincount(row, minlength=len(q))
    ends = np.r_[0, np.cumsum(many)]
    kind = spec.schema.field("near").type
    met = pa.nulls(0, kind.value_type[1].type) if points.ids is None else points.ids.take(pa.array(pos))
    columns = [*keys, ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(d), met], fields=list(kind.value_type)), type=kind)]
    if spec.tree is not None:
        full = many >= spec.most
        bound[full] = d[ends[1:][full] - 1]
        large = np.flatnonzero(pc.is_valid(table.column(_NO)).to_numpy())
        no = table.column(_NO).combine_chunks().take(pa.array(large)).to_numpy(zero_copy_only=False).astype(np.int64)
        place, leaf = spec.tree.reached(no, q[large], bound[large], spec.metric)
        other = leaf != spec.tree.home(no, q[large])[place]
        place, leaf = large[place[other]], leaf[other]
        visits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(place, minlength=len(q)))].astype(np.int32)), pa.array(leaf.astype(np.int64)))
        columns += [*(table.column(c).combine_chunks() for c in "xyz"), table.column(_NO).combine_chunks(), pa.array(bound), visits.cast(spec.schema.field("visits").type)]
    yield pa.RecordBatch.from_arrays(columns, schema=spec.schema)


def _placed(df: DataFrame, tree: Tree, few: int, reach: tuple[float, str] | None = None) -> DataFrame:
    """Moves rows of large clouds (with a number) to the buckets of their leaves; with ``reach`` to each leaf that near."""
    names = df.columns

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            no = table.column(_NO)
            large = np.flatnonzero(pc.is_valid(no).to_numpy())
            rest = table.filter(pc.is_null(no))
            if rest.num_rows:
                yield from rest.to_batches()
            if not len(large):
                continue
            own = table.take(pa.array(large)).combine_chunks()
            number, xyz = own.column(_NO).to_numpy().astype(np.int64), _xyz(own)
            for s in range(0, len(number), 4096):
                e = slice(s, s + 4096)
                if reach is None:
                    part, leaf = own.slice(s, 4096), tree.home(number[e], xyz[e])
                else:
                    place, leaf = tree.reached(number[e], xyz[e], np.full(len(number[e]), reach[0]), reach[1])
                    part = own.take(pa.array(place + s))
                part = part.set_column(names.index(_BUCKET), _BUCKET, pa.array((leaf + few).astype(np.int64)))
                for out in part.combine_chunks().to_batches(max_chunksize=1 << 16):
                    yield out

    return df.mapInArrow(run, df.schema)


@dataclass
class Plan:
    """How clouds are dealt out: several small ones to each of ``few`` buckets, a leaf of a large one to each further bucket."""

    keys: list[str]
    few: int
    large: DataFrame | None
    tree: Tree | None

    @property
    def buckets(self) -> int:
        return self.few + (self.tree.leaves if self.tree else 0)

    def bucketed(self, df: DataFrame) -> DataFrame:
        """With the bucket of small clouds and the number of large ones."""
        df = df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.few)).cast("long"))
        return df.withColumn(_NO, F.lit(None).cast("int")) if self.large is None else df.join(self.large, self.keys, "left")


def sizes(points: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of points (n) and queries (m) of each cloud."""
    n, m = (df.groupBy(*keys).agg(F.count("*").alias(name)) for df, name in ((points, "n"), (queries, "m")))
    return checkpoint(n.join(m, keys, "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")))


def plan(counted: DataFrame, frames: list[DataFrame], keys: list[str], large: Column, small: int) -> Plan:
    """From the clouds' sizes; those where ``large`` holds are split by samples of the frames (keys, x, y, z)."""
    parts = max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = F.col("n") + (F.col("m") if len(frames) > 1 else F.lit(0))
    many, total, apart = counted.agg(F.count_if(large), F.sum(F.when(~large, F.col("n") + F.col("m"))), F.count_if(~large)).first()
    few = max(1, -(-(total or 0) // _TOGETHER), min(parts, apart or 0))
    if not many:
        return Plan(keys, few, None, None)
    numbered = checkpoint(counted.where(large).select(*keys, rows.alias("rows")).coalesce(1).withColumn(_NO, F.monotonically_increasing_id().cast("int")))
    held = [r["rows"] for r in numbered.orderBy(_NO).select("rows").collect()]
    numbered = numbered.select(*keys, _NO)
    numbered = F.broadcast(numbered) if many <= _MOST_BROADCAST else numbered
    wanted = max(20_000, 64 * sum(-(-n // _BLOCK) + 4 for n in held))
    share = max(1, sum(held) // wanted)
    sample = None
    for df in frames:
        own = df.join(numbered, keys).where(F.pmod(F.xxhash64("x", "y", "z", df.columns[len(keys)]), F.lit(share)) == 0).select(_NO, "x", "y", "z")
        sample = own if sample is None else sample.unionByName(own)
    got = sample.toArrow()
    no, xyz = got.column(_NO).to_numpy(), _xyz(got)
    order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0], no))
    no, xyz = no[order], xyz[order]
    ends = np.searchsorted(no, np.arange(len(held) + 1))
    return Plan(keys, few, numbered, Tree.of([xyz[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], held, small))


def dealt(p: DataFrame, q: DataFrame, buckets: int, keys: list[str], heavy: int, columns: list[str]) -> DataFrame:
    """Points before queries of each bucket, sorted, a bucket in one task; buckets of more than ``heavy`` queries are copied."""
    most = q.groupBy(_BUCKET).count().where(F.col("count") > heavy).orderBy(_BUCKET).collect()
    if most:
        rows, start = [], buckets
        for r in most:
            copies = -(-r["count"] // heavy)
            rows.append((r[0], start, copies))
            start += copies
        buckets = start
        side = F.broadcast(q.sparkSession.createDataFrame(rows, f"{_BUCKET} long, __from long, __copies long"))
        q = q.join(side, _BUCKET, "left").withColumn(_BUCKET, F.coalesce(F.col("__from") + F.pmod(F.xxhash64(_Q), F.col("__copies")), _BUCKET))
        p = p.join(side, _BUCKET, "left").withColumn(_BUCKET, F.explode(F.coalesce(F.sequence(F.col("__from"), F.col("__from") + F.col("__copies") - 1), F.array(_BUCKET))))
    return gathered(p.select(*columns).unionByName(q.select(*columns)), buckets, keys)


def gathered(df: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """Each bucket's rows in one task, sorted."""
    parts = max(1, min(buckets, 4000))
    return df.repartitionById(parts, F.pmod(F.col(_BUCKET), F.lit(parts)).cast("int")).sortWithinPartitions(_BUCKET, _KIND, *keys)


def _type(df: DataFrame, *names: str) -> list[StructField]:
    return [StructField(n, df.schema[n].dataType) for n in names]


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _sides(p: DataFrame, q: DataFrame, keys: list[str], limit: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and queries with the same columns, clouds without a name left out."""
    for k in keys:
        p, q = p.where(F.col(k).isNotNull()), q.where(F.col(k).isNotNull())
    kinds = p.schema["point_id"].dataType, q.schema["query_id"].dataType
    nothing = F.lit(None)
    p = p.select(*keys, F.col("point_id").alias(_P), "x", "y", "z", nothing.cast(kinds[1]).alias(_Q), F.lit(0).alias(_KIND), nothing.cast("double").alias(_BOUND))
    q = q.select(*keys, F.col("query_id").alias(_Q), "x", "y", "z", nothing.cast(kinds[0]).alias(_P), F.lit(1).alias(_KIND), F.lit(float(limit)).alias(_BOUND))
    return p, q, [_BUCKET, _KIND, *keys, _P, _Q, "x", "y", "z", _NO, _BOUND]


def repeated(queries: DataFrame, keys: list[str]) -> bool:
    """Whether a cloud has a query_id more than once."""
    return not queries.groupBy(*keys, "query_id").count().where("count > 1").isEmpty()


def nearest(points: DataFrame, queries: DataFrame, keys: list[str], most: int, metric: str, limit: float, strict: bool, small: int, counted: DataFrame | None = None) -> DataFrame:
    """keys, query_id, near (the nearest ``most`` points within the limit as structs of dist2 and point_id, by both) of each query.

    Repeated queries are ranked as one, repeated points count as often as they stand there.
    """
    counted = sizes(points, queries, keys) if counted is None else counted
    p, q, columns = _sides(points, queries, keys, limit)
    deal = plan(counted, [p], keys, F.col("n") > small, small)
    if deal.tree is not None and deal.tree.crowded:  # more points in one place than a block should hold: only the first can be nearest
        from pyspark.sql.window import Window

        p = p.withColumn("__w", F.row_number().over(Window.partitionBy(*keys, "x", "y", "z").orderBy(_P))).where(F.col("__w") <= most).drop("__w")
    near = ArrayType(StructType([StructField("dist2", DoubleType()), StructField("point_id", p.schema[_P].dataType)]))
    fields = [*_type(q, *keys), StructField("query_id", q.schema[_Q].dataType), StructField("near", near)]
    p, q = deal.bucketed(p), deal.bucketed(q)
    spec = Spec(keys, most, metric, limit, strict)
    if deal.tree is None:
        schema = StructType(fields)
        spec.schema = _arrow(schema)
        out = dealt(p, q, deal.buckets, keys, 32_768, columns).mapInArrow(_met(spec), schema)
        return _merged(out, keys, most) if repeated(queries, keys) else out
    schema = StructType([*fields, *_type(q, "x", "y", "z"), StructField(_NO, IntegerType()), StructField(_BOUND, DoubleType()), StructField("visits", ArrayType(LongType()))])
    spec.schema, spec.tree = _arrow(schema), deal.tree
    p = _placed(p.select(*columns), deal.tree, deal.few)
    first = checkpoint(dealt(p, _placed(q.select(*columns), deal.tree, deal.few), deal.buckets, keys, 32_768, columns).mapInArrow(_met(spec), schema))
    again = first.where(F.size("visits") > 0).select(*keys, F.col("query_id").alias(_Q), "x", "y", "z", _NO, _BOUND, F.lit(None).cast(points.schema["point_id"].dataType).alias(_P), F.lit(1).alias(_KIND), F.explode(F.transform("visits", lambda v: v + deal.few)).alias(_BUCKET))
    late = Spec(keys, most, metric, limit, strict, schema=_arrow(StructType(fields)))
    names = [f.name for f in fields]
    found = dealt(p.where(F.col(_NO).isNotNull()), again, deal.buckets, keys, 32_768, columns).mapInArrow(_met(late), StructType(fields))
    return _merged(first.select(*names).unionByName(found), keys, most)


def _merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    return found.groupBy(*keys, "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near"))


def listed(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_id, rank, point_id, dist2 of the points in ``near``."""
    own = found.select(*keys, "query_id", F.posexplode("near").alias("rank", "n"))
    return own.select(*keys, "query_id", F.col("rank").cast("long").alias("rank"), F.col("n.point_id").alias("point_id"), F.col("n.dist2").alias("dist2"))


def ranked_within(points: DataFrame, queries: DataFrame, keys: list[str], limit: float, strict: bool, metric: str, order: str, most: int | None, seed: int, small: int) -> DataFrame:
    """keys, query_id, rank, point_id, dist2 of all points within the limit (or the first ``most`` in the order); no query_id twice."""
    counted = sizes(points, queries, keys)
    p, q, columns = _sides(points, queries, keys, limit)
    deal = plan(counted, [p, q.select(*keys, _Q, "x", "y", "z")], keys, F.col("n") + F.col("m") > 2 * small, small)
    schema = StructType([*_type(q, *keys), StructField("query_id", q.schema[_Q].dataType), StructField("rank", LongType()), StructField("point_id", p.schema[_P].dataType), StructField("dist2", DoubleType())])
    p, q = deal.bucketed(p).select(*columns), deal.bucketed(q).select(*columns)
    if deal.tree is not None:
        p, q = _placed(p, deal.tree, deal.few, (limit, metric)), _placed(q, deal.tree, deal.few)
    spec = Spec(keys, most, metric, limit, strict, order, seed, schema=_arrow(schema))
    return dealt(p, q, deal.buckets, keys, 4096, columns).mapInArrow(_met(spec), schema)

"""Operator 6: SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in one map stage; only different fingerprints are compared from there on. Two that differ in at
most two bits agree in at least two of four 16-bit blocks, so each goes to the six buckets of its block pairs. Within a
bucket the fingerprints stand vertically, 64 to a block of bit planes; a carry-save counter adds up all 64 distances
plane by plane and a block is abandoned once every lane exceeds the radius. A bucket of more than ``most`` fingerprints is
dealt again by the bits that its members needn't share: of these, too, at least two of four blocks agree. After three
such steps a bucket shares 56 bits, so it holds 256 different fingerprints at most, and every comparison stays exact and
bit-sliced. Buckets leave chains through the fingerprints that hang together, never all pairs and never stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.cluster import components

from .common import balanced, checkpoint

_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_RADIUS = 2


def fingerprint(text: bytes, words_in_shingle: int = 3, seed: int = 42, part: int = 255 * 256) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text; 0 where it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    one, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(start), part):
        h = np.array([one(joined[a:b], seed) for a, b in zip(start[at : at + part], end[at : at + part], strict=True)], np.uint64)
        h = np.append(h, np.zeros(-len(h) % 255, np.uint64))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in balanced(batches, "text", batch_bytes):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def bit_sliced_links(bucket: np.ndarray, fp: np.ndarray, most_pairs: int = 20_000, look: int = 8) -> np.ndarray:
    """For each row its root in a spanning forest of the links inside buckets.

    ``bucket`` is ascending; rows of one bucket are next to each other. Each row is compared with the 64-lane blocks of
    its own bucket that start at or after its own block.
    """
    n = len(fp)
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        while (parent[x] != x).any():
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(starts, n))
    rank = np.arange(n) - np.repeat(starts, size)
    blocks = -(-size // 64)
    first_block = np.cumsum(blocks) - blocks
    own_block = np.repeat(first_block, size) + rank // 64
    lanes = np.full((blocks.sum(), 64), -1, np.int64)
    lanes[own_block, rank % 64] = np.arange(n)
    there = np.where(lanes >= 0, fp[lanes], 0)
    planes = np.empty((64, len(lanes)), np.uint64)
    for b in range(64):
        planes[b] = np.packbits(((there >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
    valid = np.packbits(lanes >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    todo = np.repeat(first_block + blocks, size) - own_block
    todo[np.repeat(size, size) < 2] = 0
    ends = np.cumsum(todo)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most_pairs, "right")))
        q = np.repeat(np.arange(row, stop), todo[row:stop])
        block = own_block[q] + np.arange(len(q)) - np.repeat(np.cumsum(todo[row:stop]) - todo[row:stop], todo[row:stop])
        row = stop
        ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
        for b in range(64):
            x = planes[b][block] ^ (np.uint64(0) - ((fp[q] >> np.uint64(b)) & np.uint64(1)))
            carry = ones & x
            ones ^= x
            over |= twos & carry
            twos ^= carry
            if b % look == look - 1:
                live = np.flatnonzero(~(over | (twos & ones)) & valid[block])
                if len(live) < len(q):
                    q, block, ones, twos, over = q[live], block[live], ones[live], twos[live], over[live]
        near = ~(over | (twos & ones)) & valid[block]
        hit, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, c = q[hit], lanes[block[hit], lane]
        a, c = a[c > a], c[c > a]
        while len(a):
            a, c = roots(a), roots(c)
            a, c = a[a != c], c[a != c]
            np.minimum.at(parent, np.maximum(a, c), np.minimum(a, c))
    return roots(np.arange(n))


def _bucket_links(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Links of buckets that come in ascending order, some whole buckets at a time: a chain through each component."""

    def links(bucket, fp):
        again = np.flatnonzero((np.append(bucket[1:] == bucket[:-1], False)) | np.concatenate([[False], bucket[1:] == bucket[:-1]]))
        bucket, fp = bucket[again], fp[again]
        if not len(fp):
            return None
        root = bit_sliced_links(bucket, fp.view(np.uint64))
        order = np.lexsort((fp, root))
        same = np.flatnonzero(root[order[1:]] == root[order[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(fp[order[same]]), pa.array(fp[order[same + 1]])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) < least:
            continue
        bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut and (out := links(bucket[:cut], fp[:cut])):
            yield out
        held = [(bucket[cut:], fp[cut:])]
    if held and (out := links(*(np.concatenate(x) for x in zip(*held, strict=True)))):
        yield out


def _deal(rows: DataFrame, bits: int) -> DataFrame:
    """bucket, fp and free (what members of the new bucket needn't share) of the six buckets of four blocks of ``free``.

    Buckets are numbered by a hash; where two meet, more is compared than need be.
    """
    block = [F.shiftrightunsigned("free", bits * i).bitwiseAND((1 << bits) - 1) for i in range(4)]
    each = []
    for t, (i, j) in enumerate(_PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        each.append(F.struct(F.xxhash64("bucket", F.lit(t), block[i], block[j]).alias("bucket"), F.shiftleft(block[m], bits).bitwiseOR(block[k]).alias("free")))
    return rows.select("fp", F.explode(F.array(*each)).alias("x")).select("x.bucket", "fp", "x.free")


def links(different: DataFrame, most: int = 4096, most_broadcast: int = 100_000) -> DataFrame:
    """Links (a < b) between fingerprints (column fp) whose components are those of all pairs within two bits."""
    parts = max(1, int(different.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, found = different.select(F.lit(0).cast("long").alias("bucket"), "fp", F.col("fp").alias("free")), None
    for bits in (16, 8, 4):
        rows = _deal(rows, bits)
        hot = checkpoint(rows.groupBy("bucket").count().where(F.col("count") > most).select("bucket")) if bits > 4 else None
        n_hot = hot.count() if hot else 0
        side = (F.broadcast(hot) if n_hot <= most_broadcast else hot) if n_hot else None
        cold = rows.join(side, "bucket", "left_anti") if n_hot else rows
        own = cold.select("bucket", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links, "a long, b long")
        found = own if found is None else found.unionByName(own)
        if not n_hot:
            break
        rows = rows.join(side, "bucket", "left_semi")
    return found.distinct()


def with_labels(rows: DataFrame, labels: DataFrame, salts: int = 64, least: int = 1000) -> DataFrame:
    """``rows`` (doc_id, fp) with the component_id of ``labels`` (fp, n rows, component_id), hot fingerprints salted.

    Hot is what has more than a sixteenth of a task's even share of the rows, so there are at most 16 for each task.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > max(least, total // (16 * parts))
    hot = checkpoint(labels.where(is_hot).select("fp", F.lit(salts).alias("of")))
    left = rows.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("of")), F.lit(0)).cast("int")).drop("of")
    right = labels.select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))).alias("salt"))
    return left.join(right, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of each row.

    Null and empty texts, and texts of white space alone, have fingerprint 0 and are linked like any other. Null ids
    stay but never name a component; one of null ids alone has a null component_id. Repeated rows share their
    component. Other columns are not read. An empty table gives no row. Texts of any length are read whole.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    different = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    edges = checkpoint(links(different, most))
    linked = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    nodes = components(linked, edges)
    named = nodes.join(different, F.col("node") == F.col("fp")).select("fp", "root", "low")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    own = checkpoint(named.select("fp", "root").join(lowest, "root").select("fp", "component"))
    labels = checkpoint(different.join(own, "fp", "left").select("fp", "n", F.coalesce("component", "low").alias("component_id")))
    return with_labels(rows, labels).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest doc_id stays.

    Of repeated rows of that doc_id one stays. Rows without an id stay.
    """
    found = checkpoint(near_duplicates(docs, id_col, text_col))
    gone = checkpoint(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    repeated = checkpoint(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col))

    def side(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= most_broadcast else ids

    kept = docs.join(side(gone), id_col, "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    twice = side(repeated)
    return kept.join(twice, id_col, "left_anti").select(docs.columns).unionByName(kept.join(twice, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col]))

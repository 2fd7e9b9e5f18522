"""Operator 8: removal of byte strings that also start in a document with a smaller id.

Suffixes are sorted one bucket at a time. A 50-byte window goes to the bucket of its minimizer (the leftmost 8-byte
string of least hash in it), so equal windows meet in one bucket, and neighbouring windows travel together as one short
segment. A minimizer that a sample of the documents shows to be frequent is told apart by the 21 bytes on one side of it, which
windows around it share, too. There are as many buckets as the bytes of all documents need, so that one fits into a
task whatever the size of the corpus.

Before the shuffle each batch of documents keeps one copy of equal segments, that of its smallest document, and marks the
rest at once; so a passage that many documents share reaches its bucket once a batch. In a bucket, too, segments that
are equal byte for byte count as one (this is a departure: they don't go through the sort, which would only find what is
known). Windows whose larger side of the minimizer nobody else has are set aside; the rest is one text whose window
suffixes are sorted block by block: first by 16 bytes, then ties are resolved by the ranks of a difference cover's sample
suffixes, sorted beforehand with the lengths of their common prefixes. For any two tied suffixes some shift below the
cover's period brings both onto sample positions, so each suffix finds the smallest document of its class through one
of a few rank look-ups, and memory stays bounded by the block and the sample.

Spans go back to the batch they came from, and meet its compressed texts there.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced, batches_of, checkpoint

_GRAM = 8
_PERIOD, _COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is one of two of these
_SPANS = "batch long, row int, start int, end int"


def _words(text: np.ndarray, at: np.ndarray | slice, big: bool) -> np.ndarray:
    """The eight bytes at each position as one number."""
    view = np.ndarray((len(text) - 7,), ">u8" if big else "<u8", text, strides=(1,))
    return view[at].astype(np.uint64)


def gram_hash(text: np.ndarray, at: np.ndarray | slice, size: int = _GRAM) -> np.ndarray:
    """Hash of the ``size`` (8 or more) bytes at each position."""
    h = None
    for step in [*range(0, size - 8, 8), size - 8]:
        w = _words(text, slice(at.start + step, at.stop + step) if isinstance(at, slice) else at + step, False)
        if h is None:
            h = w
        else:
            h ^= h >> np.uint64(29)
            h += w
        h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def segments(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int, part: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of windows and minimizer position of each segment.

    ``text`` holds texts one after another (``starts``, ``sizes``) and 64 spare bytes; no window leaves its text.
    """
    n = len(text) - 64
    width = depth - _GRAM + 1
    edge = np.zeros(n + 1, np.int8)
    long = sizes >= depth
    edge[starts[long]] += 1
    np.subtract.at(edge, starts[long] + sizes[long] - depth + 1, 1)
    valid = np.cumsum(edge[:-1], dtype=np.int8)
    out = []
    for a in range(0, n, part):
        b = min(n, a + part)
        here = np.flatnonzero(valid[a:b])
        if not len(here):
            continue
        stop = min(b + width - 1, n + 48)
        v = gram_hash(text, slice(a, stop))
        p = np.arange(len(v), dtype=np.int32)
        size = 1
        while size < width:
            step = min(size, width - size)
            less = v[step:] < v[:-step]
            v, p = np.where(less, v[step:], v[:-step]), np.where(less, p[step:], p[:-step])
            size += step
        anchor = p[here]
        new = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (anchor[1:] != anchor[:-1])])
        first = np.flatnonzero(new)
        out.append((here[first] + a, np.diff(np.append(first, len(here))), anchor[first].astype(np.int64) + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _gather(text: np.ndarray, start: np.ndarray, size: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """The bytes of the ranges, one after another."""
    out = []
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    for a in range(0, len(start), part):
        s, n = start[a : a + part], size[a : a + part]
        out.append(text[np.repeat((s - (np.cumsum(n) - n)).astype(kind), n) + np.arange(n.sum(), dtype=kind)])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _first(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where a new key starts in the order."""
    return np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else np.zeros(0, np.int64)


#: Type of each part of a blob, and whether it is stored as differences.
_FIELDS = {"size": ("u1", False), "anchor": ("u1", False), "count": ("<u4", False), "doc": ("<i8", True), "row": ("<i4", True), "local": ("<i4", True), "pos": ("<i4", True), "end": ("<i4", True), "data": ("u1", False)}


def _blob(zip_: zstandard.ZstdCompressor, **parts: np.ndarray) -> bytes:
    """The parts, byte planes of numbers apart, compressed."""
    out = [struct.pack(f"<{len(_FIELDS)}I", *(len(parts.get(k, ())) for k in _FIELDS))]
    for k, (kind, by_difference) in _FIELDS.items():
        if k in parts:
            x = np.diff(parts[k], prepend=0) if by_difference else parts[k]
            x = np.ascontiguousarray(x.astype(kind))
            out.append(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return zip_.compress(b"".join(out))


def _parts(blob: bytes, unzip: zstandard.ZstdDecompressor) -> dict[str, np.ndarray]:
    raw = unzip.decompress(blob)
    counts, at, out = struct.unpack_from(f"<{len(_FIELDS)}I", raw), 4 * len(_FIELDS), {}
    for (k, (kind, by_difference)), n in zip(_FIELDS.items(), counts, strict=True):
        width = np.dtype(kind).itemsize
        x = np.frombuffer(raw, np.uint8, n * width, at)
        x = x if width == 1 else np.ascontiguousarray(x.reshape(width, n).T).view(kind)[:, 0]
        out[k] = np.cumsum(x, dtype=np.int64) if by_difference else x
        at += n * width
    return out


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans, by row and start, those that overlap or touch as one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(row.astype(np.int64) * far + end)
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (row[1:].astype(np.int64) * far + start[1:] > reach[:-1])]))
    return row[head], start[head], (reach[np.append(head[1:], len(row)) - 1] - row[head].astype(np.int64) * far).astype(end.dtype)


def _texts(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts as bytes, all of them one after another with 64 spare bytes, and the size of each."""
    texts = pc.fill_null(column.cast(pa.string()), "").cast(pa.binary()).to_pylist()
    return texts, np.frombuffer(b"".join([*texts, bytes(64)]), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def _split_hot(text: np.ndarray, s0: np.ndarray, count: np.ndarray, anchor: np.ndarray, depth: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments and the hash that says their bucket; those of a frequent minimizer in two, by the side that all their windows hold."""
    key = gram_hash(text, anchor)
    often = np.isin(key, hot)
    if not often.any():
        return s0, count, anchor, key
    half = (depth - _GRAM) // 2
    out = [(x[~often],) for x in (s0, count, anchor, key)]
    s, n, at = s0[often], count[often], anchor[often]
    first = np.clip(at - s - half + 1, 0, n)  # windows with so many bytes before the minimizer
    for begin, some, shift in ((s, first, -half), (s + first, n - first, 0)):
        there = np.flatnonzero(some)
        own = (begin[there], some[there], at[there], gram_hash(text, at[there] + shift, half + _GRAM))
        out = [(*x, y) for x, y in zip(out, own, strict=True)]
    return tuple(np.concatenate(x) for x in out)


def _ship(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, hot: np.ndarray, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, blob) rows: segments once a batch; a blob without segments holds spans that are settled already."""
    zip_ = zstandard.ZstdCompressor(level=3)
    few = np.uint16 if buckets < 1 << 16 else np.uint32
    for number, (batch,) in batches_of(batches, 1, batch_bytes):
        _, text, size = _texts(batch.column(1))
        doc = pc.fill_null(batch.column(0), np.iinfo(np.int64).max).to_numpy()
        start = np.cumsum(size) - size
        s0, count, anchor = segments(text, start, size, depth)
        if not len(s0):
            continue
        s0, count, anchor, key = _split_hot(text, s0, count, anchor, depth, hot)
        bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(few)
        by = np.lexsort((s0, bucket))
        s0, anchor, bucket, length = s0[by], anchor[by], bucket[by], count[by] + depth - 1
        offsets = np.concatenate([[0], np.cumsum(length)])
        data = pa.py_buffer(_gather(text, s0, length))
        coded = pa.Array.from_buffers(pa.large_binary(), len(s0), [None, pa.py_buffer(offsets), data]).dictionary_encode()
        code = coded.indices.to_numpy()
        row = np.searchsorted(start, s0, "right") - 1
        at = s0 - start[row]
        keep = np.ones(len(code), bool)
        often = np.flatnonzero((np.bincount(code) > 1)[code])
        names, blobs = [], []
        if len(often):
            order = often[np.lexsort((doc[row[often]], code[often]))]
            head = _first(code, order)
            low = np.repeat(doc[row[order[head]]], np.diff(np.append(head, len(order))))
            done = order[doc[row[order]] != low]
            keep[done] = False
            if len(done):
                names.append(number % buckets)
                settled = _joined(row[done], at[done], at[done] + length[done])
                blobs.append(_blob(zip_, **dict(zip(("row", "pos", "end"), settled, strict=True))))
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(code[kept], kind="stable")]
        head = np.append(_first(code, kept), len(kept))  # of each different segment, in the order of the dictionary
        seg, uses = kept[head[:-1]], np.diff(head)
        places = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(seg) + 1)
        content = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
        bounds = np.append(np.flatnonzero(np.concatenate([[True], bucket[seg][1:] != bucket[seg][:-1]])), len(seg))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            occ, s = kept[head[a] : head[b]], seg[a:b]
            rows, local = np.unique(row[occ], return_inverse=True)
            names.append(int(bucket[s[0]]))
            blobs.append(_blob(zip_, size=length[s], anchor=anchor[s] - s0[s], count=uses[a:b], doc=doc[rows], row=rows, local=local, pos=at[occ], data=content[places[a] : places[b]]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([number] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])


class CoverSample:
    """Ranks of a difference cover's sample suffixes, to ``depth`` bytes, and classes of those that share a prefix.

    Of the sample only what lies less than a period after one of the ``windows`` is looked up, so only that is sorted.
    """

    def __init__(self, text: np.ndarray, windows: np.ndarray, depth: int):
        n = len(text) - 64
        used = np.zeros(n, bool)
        used[windows] = True
        reach = 1
        while reach < _PERIOD:
            step = min(reach, _PERIOD - reach)
            used[step:] |= used[:-step].copy()
            reach += step
        at = np.flatnonzero(used)
        at = at[np.isin(np.arange(_PERIOD), _COVER)[at % _PERIOD]]
        keys = [_words(text, at + 8 * j, True) for j in range(-(-depth // 8))]
        order = np.lexsort(keys[::-1])
        self.rank = np.full(n, -1, np.int32)
        self.rank[at[order]] = np.arange(len(at), dtype=np.int32)
        common = np.zeros(len(at), np.int64)
        same = np.ones(max(0, len(at) - 1), bool)
        for k in keys:
            k = k[order]
            x = k[1:] ^ k[:-1]
            zero = np.zeros(len(x), np.int64)
            for byte in range(8):
                zero += x < np.uint64(1) << np.uint64(8 * byte) if byte else x == 0
            common[1:] += np.where(same, zero, 0)
            same &= x == 0
        self.common = np.minimum(common, depth)
        self.depth = depth

    def classes(self, shift: int) -> np.ndarray:
        """By rank, the class of suffixes that agree in what lies past ``shift`` bytes of a window."""
        return np.cumsum(self.common < self.depth - shift)


def smallest_of_equal(text: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int, block: int = 1 << 18) -> np.ndarray:
    """For each window (its first byte in ``at``) the smallest document among windows of the same ``depth`` bytes."""
    out = doc.copy()
    if not len(at):
        return out
    cover = CoverSample(text, at, depth)
    classes = [cover.classes(shift).astype(np.int32) for shift in range(_PERIOD)]
    lead = _words(text, at, True)
    cuts = np.unique(np.sort(lead[:: block // 16])[16::16])
    where = np.searchsorted(cuts, lead, "right")
    blocks = np.argsort(where, kind="stable")
    bounds = np.append(_first(where, blocks), len(blocks))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = blocks[a:b]
        k0, k1 = lead[some], _words(text, at[some] + 8, True)
        order = np.lexsort((k1, k0))
        some, k0, k1 = some[order], k0[order], k1[order]
        new = np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
        head = np.flatnonzero(new)
        spread = np.minimum.reduceat(doc[some], head) != np.maximum.reduceat(doc[some], head)
        group = np.cumsum(new) - 1
        tied = spread[group]
        some, group = some[tied], group[tied]
        best = doc[some]
        for shift in range(_PERIOD):
            rank = cover.rank[at[some] + shift]
            sampled = np.flatnonzero(rank >= 0)
            if not len(sampled):
                continue
            pair = group[sampled].astype(np.int64) << 32 | classes[shift][rank[sampled]]
            order = np.argsort(pair, kind="stable")
            head = _first(pair, order)
            low = np.minimum.reduceat(doc[some[sampled[order]]], head)
            best[sampled[order]] = np.minimum(best[sampled[order]], np.repeat(low, np.diff(np.append(head, len(order)))))
        out[some] = best
    return out


def shared_parts(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """By segment the least and largest number of bytes before the minimizer with which a window may be shared at all.

    ``at`` is the minimizer's place, ``left`` and ``right`` the bytes that the segment has around it. A window has half of
    what the minimizer leaves of it on one side at least; where these bytes and the minimizer stand in one document
    only (``low``), no window that holds them is shared. Without any window, the least is above the largest.
    """
    around = depth - _GRAM
    half = around // 2
    least, most = np.full(len(at), around + 1), np.full(len(at), -1)
    for before, has in ((half, left), (0, right)):
        some = np.flatnonzero(has >= half)
        h = gram_hash(data, at[some] - before, half + _GRAM)
        order = np.argsort(h, kind="stable")
        head = _first(h, order)
        spread = np.minimum.reduceat(low[some[order]], head) != np.maximum.reduceat(low[some[order]], head) if len(head) else np.zeros(0, bool)
        hit = some[order[np.repeat(spread, np.diff(np.append(head, len(order))))]]
        if before:
            least[hit], most[hit] = np.minimum(least[hit], half), around
        else:
            least[hit], most[hit] = 0, np.maximum(most[hit], around - half)
    return np.maximum(least, around - right), np.minimum(most, left)


def _settle(parts: list[dict], depth: int) -> tuple | None:
    """(batch, row, start, end) arrays of what a bucket shows to be removable."""
    if not parts:
        return None
    size, anchor, count = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in ("size", "anchor", "count"))
    low = np.concatenate([p["doc"][p["local"][np.cumsum(p["count"], dtype=np.int64) - p["count"]]] for p in parts])
    content = np.concatenate([p["data"] for p in parts])
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(content)]).dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    head = _first(code, order)
    lowest = np.minimum.reduceat(low[order], head)
    # equal segments (the code says which) are removed whole but for the smallest document's, which stands for them
    start = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(head) + 1)[:-1]
    data = np.concatenate([np.frombuffer(coded.dictionary.buffers()[2], np.uint8), np.zeros(64, np.uint8)])
    b = np.where(low > lowest[code], size, 0)
    a = np.zeros(len(b), np.int64)
    before = anchor[order[head]]
    least, most = shared_parts(data, start + before, before, size[order[head]] - before - _GRAM, lowest, depth)
    shared = np.flatnonzero(least <= most)
    if len(shared):
        # what remains of each segment, as one text
        skip, windows = (before - most)[shared], (most - least)[shared] + 1
        length = windows + depth - 1
        text = np.concatenate([_gather(data, start[shared] + skip, length), np.zeros(64, np.uint8)])
        begin = np.cumsum(length) - length
        seg = np.repeat(np.arange(len(shared)), windows)
        rel = np.arange(len(seg)) - (np.cumsum(windows) - windows)[seg]
        own = lowest[shared][seg]
        hit = np.flatnonzero(smallest_of_equal(text, begin[seg] + rel, own, depth) < own)
        if len(hit):
            # windows of one segment start closer than a window's length, so what they cover is one span
            which, at = np.unique(seg[hit], return_index=True)
            span = np.zeros((2, len(head)), np.int64)
            span[0, shared[which]] = rel[hit][at] + skip[which]
            span[1, shared[which]] = rel[hit][np.append(at[1:], len(hit)) - 1] + skip[which] + depth
            a, b = np.where(b > 0, a, span[0][code]), np.where(b > 0, b, span[1][code])
    cut = np.flatnonzero(b)
    if not len(cut):
        return None
    base = np.cumsum([0, *(len(p["row"]) for p in parts)])[:-1]
    batch, row = np.concatenate([np.full(len(p["row"]), p["batch"]) for p in parts]), np.concatenate([p["row"] for p in parts])
    local, pos = np.concatenate([p["local"] + o for p, o in zip(parts, base, strict=True)]), np.concatenate([p["pos"] for p in parts])
    uses = count[cut]
    use = np.repeat((np.cumsum(count) - count)[cut] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
    own = local[use]
    return batch[own], row[own], pos[use] + np.repeat(a[cut], uses), pos[use] + np.repeat(b[cut], uses)


def _spans(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()

    def rows(found, part: int = 1 << 18):
        for at in range(0, len(found[0]) if found else 0, part):
            batch, *rest = (x[at : at + part] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), *(pa.array(x.astype(np.int32)) for x in rest)], ["batch", "row", "start", "end"])

    held, now = [], None
    for whole in batches:
        for bucket, number, blob in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), whole.column(2), strict=True):
            if bucket != now:
                yield from rows(_settle(held, depth))
                held, now = [], bucket
            p = _parts(blob.as_buffer(), unzip) | {"batch": number}
            if len(p["size"]):
                held.append(p)
            else:
                yield from rows((np.full(len(p["row"]), number), p["row"], p["pos"], p["end"]))
    yield from rows(_settle(held, depth))


def survey(docs: DataFrame, depth: int, one_in: int = 64, most_hot: int = 10_000, least: int = 1000) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the hashes of frequent minimizers: those of more than ``least`` segments in a hashed sample of texts.

    The sample only says what is dealt apart, ``most_hot`` minimizers at most; what is found doesn't depend on it.
    """

    def run(batches):
        for batch in balanced(batches, "text", 8 << 20):
            texts, _, size = _texts(batch.column(1))
            texts = [t for t in texts if len(t) >= depth and xxhash.xxh64_intdigest(t, 42) % one_in == 0]
            _, text, own = _texts(pa.array(texts, pa.binary()).cast(pa.string()))
            _, _, anchor = segments(text, np.cumsum(own) - own, own, depth)
            key, n = np.unique(gram_hash(text, anchor), return_counts=True) if len(anchor) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            key = np.append(key.view(np.int64), np.int64(0))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(n), np.int64), size.sum()))], ["key", "n", "bytes"])

    seen = docs.mapInArrow(run, "key long, n long, bytes long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    seen = checkpoint(seen.where((F.col("n") > least) | (F.col("bytes") > 0)))
    total = seen.agg(F.sum("bytes")).first()[0] or 0
    hot = seen.where(F.col("n") > least).orderBy(F.desc("n"), "key").limit(most_hot).select("key").toArrow().column(0).to_numpy()
    return total, np.sort(hot).view(np.uint64)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, bucket_bytes: int = 6 << 20, batch_bytes: int = 8 << 20, keep_text: bool = False, hot: list[int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; ``keep_text`` adds kept (binary).

    Removed is each byte that a ``depth``-byte string (of at most 255) covers which also starts in a document of smaller id. Null
    texts are empty; a null id is larger than any other and equal to other null ids, so it removes nothing elsewhere.
    Repeated rows (same id) remove nothing from each other. Other columns are not read; an empty table gives no row.
    Texts are treated whole. A bucket holds the segments of about ``bucket_bytes`` of text. ``hot``: hashes of minimizers
    to deal apart, by default those that ``survey`` finds.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, often = survey(picked, depth)
    often = often if hot is None else np.sort(np.array(hot, np.uint64))
    buckets = -(-max(2 * parts, total // bucket_bytes) // parts) * parts
    schema = _OUT + ", kept binary" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(rows):
        zip_ = zstandard.ZstdCompressor(level=6)
        for number, (piece,) in batches_of(rows, 1, batch_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zip_.compress(sink.getvalue())])], ["batch", "docs"])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError("the documents changed between two scans")
        piece = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(left.column("docs")[0].as_buffer())).read_all().to_batches()[0]
        texts, _, _ = _texts(piece.column(1))
        row, start, end = _joined(*(right.column(c).to_numpy() for c in ("row", "start", "end")))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        start, end, out = start.tolist(), end.tolist(), []
        for i, text in enumerate(texts):
            at, kept, gone = 0, [], 0
            for k in range(bounds[i], bounds[i + 1]):
                kept.append(text[at : start[k]])
                gone, at = gone + end[k] - start[k], end[k]
            kept = b"".join([*kept, text[at:]])
            out.append((len(text), gone, bounds[i + 1] - bounds[i], hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
        return pa.Table.from_arrays([piece.column(0), *map(pa.array, zip(*out, strict=True))], names)

    shipped = picked.mapInArrow(lambda rows: _ship(rows, depth, buckets, often, batch_bytes), "bucket long, batch long, blob binary")
    dealt = shipped.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    spans = dealt.mapInArrow(lambda rows: _spans(rows, depth), _SPANS)
    blobs = picked.mapInArrow(pack, "batch long, docs binary")
    return blobs.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(cut, schema)


#: DuckDB SQL of ``dedup``: all windows of all documents, grouped.
SQL = """WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS b, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 50] AS g FROM d, range(n - 49) AS r(i)),
low AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN low USING (g) WHERE low < doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
gap AS (SELECT doc_id, COALESCE(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM run UNION ALL SELECT d.doc_id, COALESCE(max(run.z), 0), d.n FROM d LEFT JOIN run USING (doc_id) GROUP BY d.doc_id, d.n),
kept AS (SELECT doc_id, string_agg(hex(b[gap.a + 1:gap.z]), '' ORDER BY gap.a) AS h FROM gap JOIN d USING (doc_id) WHERE gap.z > gap.a GROUP BY doc_id),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(h, ''))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

"""Operator 3: ISO base media containers.

``build`` stores samples in a container (ftyp, moov with its sample tables, mdat). ``walk`` goes through nested boxes and
``tracks`` decodes the sample tables, those of fragments too, into codec, duration, sample and key-frame byte ranges; sample
payloads are never decoded. ``describe_media`` does so for any binary column, damaged files included; ``media_columns`` stores
texts and reads them back. Both are one map stage over Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced

SAMPLE, TIMESCALE, GROUP, CHUNK = 576, 25, 12, 8  # a 24 x 24 picture of 8-bit grey; a key frame each GROUP samples
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """The data and bytes 255 up to a positive multiple of a sample."""
    return data + b"\xff" * (SAMPLE - len(data) if not data else -len(data) % SAMPLE)


def build(payload: bytes) -> bytes:
    """A container whose only track holds the payload as samples of SAMPLE bytes."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    entry = struct.pack(">6xH16xHHIII H32sHh", 1, 24, 24, 0x480000, 0x480000, 0, 1, b"", 40, -1)
    runs = ([(1, CHUNK, 1)] if n >= CHUNK else []) + ([(chunks, n % CHUNK, 1)] if n % CHUNK else [])
    tables = [
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", -(-n // GROUP)), (np.arange(0, n, GROUP) + 1).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
    ]
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * SAMPLE)
        stbl = _box(b"stbl", *tables, _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()))
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", 24 << 16, 24 << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(brand) + len(moov(0))
    wide = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([brand, moov(head + len(mdat)), mdat, payload])


def _boxes(data: memoryview, deepest: int = 32) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of kinds, start of the box, start and end of its content) of each box, containers before what they hold."""
    todo = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box {kind!r} at {start} is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        own = (*path, kind)
        yield own, start, start + head, start + size
        todo.append((start + size, end, path))
        inner = start + head
        if kind == b"meta" and bytes(data[inner + 4 : inner + 8]) != b"hdlr":
            inner += 4  # version and flags, which some writers leave out
        if kind in _NESTS or kind == b"meta":
            if len(own) > deepest:
                raise ValueError(f"boxes are nested more than {deepest} deep")
            todo.append((inner, start + size, own))


def walk(data: memoryview) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, start and end of the content) of each box, containers before what they hold.

    64-bit sizes and size 0 (up to the end) are understood; a box that leaves its container raises ValueError.
    """
    for path, _, at, end in _boxes(data):
        yield path, at, end


def _table(data: memoryview, at: int, end: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip)[0]
    at += skip + 4
    if at + n * width * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, at).astype(np.int64).reshape(n, width)


def _compact_sizes(data: memoryview, at: int, end: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits (stz2)."""
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if width not in (4, 8, 16) or at + 12 + -(-n * width // 8) > end:
        raise ValueError("a sample table is cut off")
    if width == 16:
        return np.frombuffer(data, ">u2", n, at + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -(-n * width // 8), at + 12).astype(np.int64)
    return raw if width == 8 else np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n]


def _optional(data: memoryview, at: int, flags: int, fields: list[tuple[int, str, str]]) -> tuple[dict, int]:
    """Values of the fields whose flag is set, one after another, and where they end."""
    out = {}
    for flag, name, kind in fields:
        if flags & flag:
            out[name] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return out, at


_NOT_SYNC = 0x10000
_TFHD = [(0x1, "base", ">Q"), (0x2, "entry", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")]
_TRUN = [(0x1, "offset", ">i"), (0x4, "first", ">I")]
_RUN_COLUMNS = [(0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "composition")]


class _Fragments:
    """Samples of track fragments, by track id."""

    def __init__(self):
        self.defaults, self.runs, self.moof, self.now = {}, {}, 0, {}

    def add(self, kind: bytes, data: memoryview, start: int, at: int, end: int) -> None:
        if kind == b"moof":
            self.moof, self.next = start, start
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            self.defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, at)
            own, _ = _optional(data, at + 8, flags & 0xFFFFFF, _TFHD)
            base = self.moof if flags & 0x20000 else self.next
            self.now = {"track": track, "base": base, "duration": 0, "size": 0, "flags": 0} | self.defaults.get(track, {}) | own
            self.next = self.now["base"]
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", data, at)
            own, at = _optional(data, at + 8, flags & 0xFFFFFF, _TRUN)
            there = [name for flag, name in _RUN_COLUMNS if flags & flag]
            if at + 4 * n * len(there) > end or (not there and n > len(data)):
                raise ValueError("a sample table is cut off")
            table = np.frombuffer(data, ">u4", n * len(there), at).astype(np.int64).reshape(n, len(there))
            column = {name: table[:, i] for i, name in enumerate(there)}
            if not self.now:
                raise ValueError("a run stands before its track")
            size, duration, bits = (column.get(k, np.full(n, self.now[k], np.int64)) for k in ("size", "duration", "flags"))
            if "first" in own and "flags" not in column and n:
                bits[0] = own["first"]
            first = self.now["base"] + own["offset"] if "offset" in own else self.next
            self.next = first + int(size.sum())
            self.runs.setdefault(self.now["track"], []).append((first + np.cumsum(size) - size, size, (bits & _NOT_SYNC) == 0, int(duration.sum())))


def tracks(media: bytes) -> list[dict]:
    """id, codec, timescale, duration, handler, offset, size and key (numpy arrays by sample) of each track.

    Samples of fragments follow those of the track's own tables. Damaged boxes and tables raise ValueError.
    """
    try:
        return _tracks(memoryview(media))
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"a box is too short: {e}") from e


def _tracks(data: memoryview) -> list[dict]:
    out, fragments = [], _Fragments()
    for path, start, at, end in _boxes(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({"id": 0, "codec": "", "timescale": 0, "duration": 0, "handler": ""})
        elif path[0] == b"moof" or path[-2:] == (b"mvex", b"trex"):
            fragments.add(kind, data, start, at, end)
        elif path[:2] == (b"moov", b"trak"):
            t = out[-1]
            if kind == b"tkhd":
                t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr" and b"meta" not in path:
                t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
                t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stts":
                t["stts"] = _table(data, at, end, ">u4", 2)
            elif kind == b"stss":
                t["stss"] = _table(data, at, end, ">u4", 1)[:, 0]
            elif kind == b"stsc":
                t["stsc"] = _table(data, at, end, ">u4", 3)
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", data, at + 4)
                if n * max(size, 1) > len(data):
                    raise ValueError("the samples are larger than the file")
                t["size"] = np.full(n, size, np.int64) if size else _table(data, at, end, ">u4", 1, 8)[:, 0]
            elif kind == b"stz2":
                t["size"] = _compact_sizes(data, at, end)
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
    for t in out:
        size, chunks, runs = t.setdefault("size", np.zeros(0, np.int64)), t.pop("chunks", np.zeros(0, np.int64)), t.pop("stsc", np.zeros((0, 3), np.int64))
        last = np.append(runs[1:, 0], len(chunks) + 1)
        chunk_counts = last - runs[:, 0]
        if len(runs) and ((chunk_counts < 0).any() or runs[0, 0] != 1 or chunk_counts.sum() != len(chunks)):
            raise ValueError("the sample tables disagree")
        per_chunk = np.repeat(runs[:, 1], chunk_counts) if len(runs) else np.zeros(0, np.int64)
        if per_chunk.sum() != len(size):
            raise ValueError("the sample tables disagree")
        chunks, per_chunk = chunks[: len(per_chunk)][per_chunk > 0], per_chunk[per_chunk > 0]
        first = np.cumsum(per_chunk) - per_chunk
        before = np.cumsum(size) - size
        t["offset"] = np.repeat(chunks - before[first], per_chunk) + before
        stss = t.pop("stss", None)
        t["key"] = np.zeros(len(size), bool)
        if stss is not None and len(stss) and not 1 <= stss.min() <= stss.max() <= len(size):
            raise ValueError("a key frame isn't among the samples")
        t["key"][slice(None) if stss is None else stss - 1] = True
        stts = t.pop("stts", np.zeros((0, 2), np.int64))
        more = fragments.runs.get(t["id"], [])
        t["duration"] = (t["duration"] or int((stts[:, 0] * stts[:, 1]).sum())) + sum(r[3] for r in more)
        for k, name in enumerate(("offset", "size", "key")):
            t[name] = np.concatenate([t[name], *(r[k] for r in more)])
        if len(t["size"]) and (t["offset"].min() < 0 or (t["offset"] + t["size"]).max() > len(data)):
            raise ValueError("a sample lies past the end")
    return out


def ranges(offset: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the byte ranges that the samples cover in turn, adjoining ones as one."""
    if not len(offset):
        return []
    end = offset + size
    cut = np.concatenate([[True], offset[1:] != end[:-1]])
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], len(offset)) - 1
    return [(int(offset[a]), int(end[b] - offset[a])) for a, b in zip(starts, stops, strict=True)]


def samples(media: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples."""
    return b"".join([media[a : a + n] for a, n in ranges(track["offset"], track["size"])])


def describe(found: list[dict]) -> str:
    """Codec, duration and key-frame byte ranges of each track."""
    return ";".join(f"{t['handler']}/{t['codec'].strip()} {t['duration']}/{t['timescale']} s, {len(t['size'])} samples, keys " + ",".join(f"{a}+{n}" for a, n in ranges(t["offset"][t["key"]], t["size"][t["key"]])) for t in found)


_TRACK = "id: bigint, handler: string, codec: string, timescale: bigint, duration: bigint, n_samples: bigint, payload_bytes: bigint, keys: array<struct<start: bigint, length: bigint>>"


def describe_media(df: DataFrame, media_col: str = "media", batch_rows: int = 64) -> DataFrame:
    """The rows with tracks (an array of structs: id, handler, codec, timescale, duration, samples, payload bytes and key-frame
    byte ranges) and media_error in place of the binary column ``media_col``; all other columns stay as they are.

    A null file has null tracks and no error. A damaged file has null tracks and says why in media_error; it fails no task.
    A file without a track has an empty array. Fragmented files count the samples of their fragments.
    """
    if {"tracks", "media_error"} & set(df.columns):
        raise ValueError("there is a column tracks or media_error already")
    rest = [c for c in df.columns if c != media_col]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("payload_bytes", pa.int64()), ("keys", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]))

    def one(media: bytes | None) -> tuple[list | None, str | None]:
        if media is None:
            return None, None
        try:
            found = tracks(media)
        except ValueError as e:
            return None, str(e)
        return [{"id": t["id"], "handler": t["handler"], "codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["size"]), "payload_bytes": int(t["size"].sum()), "keys": [{"start": a, "length": n} for a, n in ranges(t["offset"][t["key"]], t["size"][t["key"]])]} for t in found], None

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                made = [one(v.as_py()) for v in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], pa.string())], [*rest, "tracks", "media_error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != media_col), f"tracks array<struct<{_TRACK}>>", "media_error string"])
    return df.select(media_col, *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """Digest and feature columns of each text stored as a container; see ``SCHEMA``. ``keep_media`` adds media (binary).

    Null and empty texts are stored as one sample of bytes 255; null ids stay; repeated rows give repeated results;
    other columns are not read; texts of any length are stored whole.
    """

    def run(batches):
        for batch in balanced(batches, "text", batch_bytes):
            texts, rows = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary()).to_pylist(), []
            for data in texts:
                media = build(padded(data))
                found = tracks(media)
                back = samples(media, found[0])
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(found), *[media] * keep_media))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names)

    schema = SCHEMA + ", media binary" * keep_media
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

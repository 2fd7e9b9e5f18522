"""Containers: exact round trips, hand-made boxes, and the digest columns."""

import hashlib
import struct
import zlib

import pytest

from pointloom.llm import iso_media as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 12 + 3, 576 * 100])
def test_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    payload = M.padded(data)
    assert payload.startswith(data) and len(payload) % 576 == 0 and payload and set(payload[n:]) <= {255}
    media = M.build(payload)
    (track,) = M.tracks(media)
    assert M.samples(media, track) == payload
    assert (track["handler"], track["codec"].strip(), track["timescale"], track["duration"]) == ("vide", "raw", 25, len(payload) // 576)
    keys = b"".join(media[a : a + k] for a, k in M.ranges(track["offset"][track["key"]], track["size"][track["key"]]))
    assert keys == b"".join(payload[at : at + 576] for at in range(0, len(payload), 576 * 12))


def test_walk_understands_sizes():
    wide = struct.pack(">I4sQ", 1, b"free", 19) + b"abc"
    rest = struct.pack(">I4s", 0, b"mdat") + b"tail"
    found = list(M.walk(memoryview(M._box(b"moov", wide, M._box(b"trak")) + rest)))
    assert [p for p, _, _ in found] == [(b"moov",), (b"moov", b"free"), (b"moov", b"trak"), (b"mdat",)]
    with pytest.raises(ValueError):
        list(M.walk(memoryview(struct.pack(">I4s", 99, b"moov"))))
    with pytest.raises(ValueError):
        M.tracks(M.build(M.padded(b"x"))[:-10])


def test_columns(docs_of):
    rows = [(1, None), (2, ""), (3, "naïve 漢字"), (3, "naïve 漢字"), (None, "x" * 3_000_000), (4, "\xff")]
    found = M.media_columns(docs_of(rows), keep_media=True).collect()
    assert len(found) == len(rows) and M.media_columns(docs_of([])).collect() == []
    texts = {i: (t or "").encode() for i, t in rows}
    for r in found:
        data = texts[r.doc_id]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and payload in bytes(r.media)
        assert r.feature.startswith("vide/raw ")


def fragmented(tables=b""):
    """A movie without samples of its own, and two fragments of three and two samples; the first of each is a key frame."""
    stbl = M._box(b"stbl", M._full(b"stsd", struct.pack(">I", 1), M._box(b"avc1", bytes(78))), tables)
    mdia = M._box(b"mdia", M._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), M._full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), M._box(b"minf", stbl))
    tkhd = M._full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0))
    trex = M._full(b"trex", struct.pack(">5I", 7, 1, 40, 5, M._NOT_SYNC))
    out = M._box(b"ftyp", b"isom") + M._box(b"moov", M._box(b"trak", tkhd, mdia), M._box(b"mvex", trex))
    want = []
    for sizes in ([5, 5, 5], [9, 4]):
        own = sizes != [5, 5, 5]
        columns = struct.pack(f">{len(sizes)}I", *sizes) if own else b""

        def moof(offset):
            trun = M._full(b"trun", struct.pack(">IiI", len(sizes), offset, 0), columns, flags=0x5 | (0x200 if own else 0))
            return M._box(b"moof", M._full(b"mfhd", struct.pack(">I", 1)), M._box(b"traf", M._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun))

        size = len(moof(0))
        start = len(out) + size + 8
        want += [(start + sum(sizes[:i]), n, i == 0) for i, n in enumerate(sizes)]
        out += moof(size + 8) + M._box(b"mdat", bytes(sum(sizes)))
    return out, want


def test_fragments():
    media, want = fragmented()
    (t,) = M.tracks(media)
    assert list(zip(t["offset"].tolist(), t["size"].tolist(), t["key"].tolist(), strict=True)) == want
    assert (t["id"], t["codec"], t["duration"], t["timescale"]) == (7, "avc1", 200, 1000)


@pytest.mark.parametrize(("width", "raw"), [(4, bytes([0x35, 0x20])), (8, bytes([3, 5, 2])), (16, bytes([0, 3, 0, 5, 0, 2]))])
def test_compact_sizes(width, raw):
    box = M._full(b"stz2", struct.pack(">II", width, 3), raw)
    assert M._compact_sizes(memoryview(box), 8, len(box)).tolist() == [3, 5, 2]
    with pytest.raises(ValueError):
        M._compact_sizes(memoryview(box[:-1]), 8, len(box) - 1)


def test_meta_and_depth():
    hdlr = M._full(b"hdlr", struct.pack(">I4s12x", 0, b"pict"), b"\0")
    for meta in (M._full(b"meta", hdlr), M._box(b"meta", hdlr)):
        assert [p for p, _, _ in M.walk(memoryview(meta))] == [(b"meta",), (b"meta", b"hdlr")]
    deep = b""
    for _ in range(5000):
        deep = M._box(b"moov", deep)
    with pytest.raises(ValueError, match="nested"):
        M.tracks(deep)


def test_damaged_files_only_raise_value_errors():
    import random

    rng = random.Random(4)
    for whole in (M.build(M.padded(b"some text " * 300)), fragmented()[0]):
        for _ in range(600):
            bad = bytearray(whole[: rng.randrange(len(whole) + 1)])
            for _ in range(rng.randrange(6)):
                if bad:
                    bad[rng.randrange(len(bad))] = rng.randrange(256)
            try:
                M.tracks(bytes(bad))
            except ValueError:
                pass


def test_describe_media(spark):
    good, (broken, _) = M.build(M.padded(b"abc")), fragmented()
    rows = [(1, good, 5), (2, None, 6), (3, good[:-9], 7), (4, broken, 8), (5, b"", 9), (5, b"", 9), (None, b"junk", 1)]
    frame = spark.createDataFrame(rows, "id long, media binary, codec int")
    found = {(r.id, r.codec): r for r in M.describe_media(frame).collect()}
    assert M.describe_media(frame).columns == ["id", "codec", "tracks", "media_error"] and M.describe_media(frame).count() == len(rows)
    (t,) = found[1, 5].tracks
    assert (t.codec.strip(), t.n_samples, t.payload_bytes, t.duration) == ("raw", 1, 576, 1) and good[t["keys"][0].start :][:3] == b"abc"
    assert found[2, 6].tracks is None and found[2, 6].media_error is None
    assert found[3, 7].tracks is None and found[3, 7].media_error
    assert found[4, 8].tracks[0].n_samples == 5 and len(found[4, 8].tracks[0]["keys"]) == 2
    assert found[5, 9].tracks == [] and found[5, 9].media_error is None
    with pytest.raises(ValueError, match="already"):
        M.describe_media(M.describe_media(frame).withColumn("media", M.F.lit(b"")))

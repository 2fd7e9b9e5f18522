import random

import numpy as np
import xxhash

from pointloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(3, len(words))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Component number of each fingerprint, by comparing all pairs."""
    n, comp = len(fps), list(range(len(fps)))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    return comp


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    low = {c: min((i for (i, _), d in zip(rows, comp) if d == c and i is not None), default=None) for c in comp}
    return sorted(((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def edge_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "x", "y", "ÄÖ", "漢字"]
    base = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two"), (None, "nobody else"), (7, "ONE two"), (8, "a b c"), (9, "a\x0bb  c")]
    for i in range(40):
        doc = list(base)
        for _ in range(i % 4):
            doc[rng.randrange(len(doc))] = "z%d" % i
        rows.append((100 - i, " ".join(doc)))
    rows.append((200, "long " * 70_000 + "end"))
    return rows


def test_same_as_all_pairs(docs_of):
    rows = edge_rows()
    found = simhash.near_duplicates(docs_of(rows))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


def test_hot_buckets_are_exact(docs_of):
    rows = edge_rows()
    assert sorted(map(tuple, simhash.near_duplicates(docs_of(rows), most=2).collect()), key=str) == expected(rows)


def test_crowded_bucket_is_dealt_again(spark):
    """Thousands of fingerprints that share 44 bits: beyond the bound at the first step, and at the second."""
    rng = random.Random(8)
    top = rng.getrandbits(44) << 20
    fps = sorted({top | rng.getrandbits(20) for _ in range(700)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    comp = plain_components(fps)
    for most in (4096, 100, 8):
        found = simhash.links(frame, most).collect()
        assert all(r.a < r.b for r in found) and len(found) < 18 * len(fps)
        mine = list(range(len(fps)))
        at = {f: i for i, f in enumerate(signed)}
        for r in found:
            a, b = mine[at[r.a]], mine[at[r.b]]
            mine = [a if c == b else c for c in mine] if a != b else mine
        assert len(set(zip(mine, comp, strict=True))) == len(set(mine)) == len(set(comp))


def test_hot_fingerprints_are_salted(spark):
    rows = spark.createDataFrame([(i, 5 if i % 3 else i) for i in range(300)], "doc_id long, fp long")
    labels = rows.groupBy("fp").count().selectExpr("fp", "count AS n", "fp + 1 AS component_id")
    found = simhash.with_labels(rows, labels, 8, 10).collect()
    assert sorted((r.doc_id, r.fp, r.component_id) for r in found) == [(i, f, f + 1) for i in range(300) for f in [5 if i % 3 else i]]


def test_sf_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(sf_docs).collect()), key=str) == expected(rows)


def test_bit_sliced_forest():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    fps = []
    for c in centre:
        for _ in range(rng.integers(1, 150)):
            fps.append(int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)).tolist())))
    fps = np.unique(np.array(fps, np.uint64))
    bucket = np.sort(rng.integers(0, 4, len(fps)))
    root = simhash.bit_sliced_links(bucket, fps, most_pairs=50)
    for k in range(4):
        own = np.flatnonzero(bucket == k)
        comp = plain_components([int(x) for x in fps[own]])
        pairs = {(a, b) for a, b in zip(root[own].tolist(), comp, strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_empty_and_keep_one(docs_of, spark):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    rows = edge_rows()
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows)).collect()), key=str)
    want = {c for _, _, c in expected(rows) if c is not None}
    assert sorted(i for i, _ in kept if i is not None) == sorted(want)
    assert sum(i is None for i, _ in kept) == 2

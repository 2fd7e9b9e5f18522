import hashlib
import random

import numpy as np

from pointloom.llm import suffix_dedup


def plain(rows, depth=50):
    """By brute force: the smallest document of each window."""
    low, far = {}, float("inf")
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            low[w] = min(low.get(w, far), far if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - depth + 1):
            if low[b[p : p + depth]] < (far if i is None else i):
                gone[p : p + depth] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def edge_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé漢", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 49), (5, "x" * 50), (6, "x" * 51), (7, "x" * 300), (7, "x" * 300), (-3, "y" * 120), (8, "y" * 120), (None, "y" * 120), (None, shared[0]), (9, "ab" * 100), (10, "ba" * 100)]
    rows += [(100 - i, " ".join(rng.choice([text(3), rng.choice(shared), text(20)]) for _ in range(8))) for i in range(40)]
    rows += [(7, shared[1]), (50, shared[2] * 3), (300, "\0" * 80), (301, "\0" * 90), (302, "long " * 30_000), (303, "q" + "long " * 20_000 + text(30))]
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_same_as_brute_force(docs_of):
    rows = edge_rows()
    found = suffix_dedup.dedup(docs_of(rows))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(found) == plain(rows)


def test_small_batches_and_many_buckets(docs_of):
    rows = edge_rows()
    assert got(suffix_dedup.dedup(docs_of(rows), batch_bytes=500, bucket_bytes=300)) == plain(rows)


def test_frequent_minimizers_are_dealt_apart(docs_of, spark):
    rows = edge_rows()
    text = np.concatenate([np.frombuffer((t or "").encode() + bytes(64), np.uint8) for _, t in rows])
    every = np.unique(suffix_dedup.gram_hash(text, slice(0, len(text) - 7)))
    for hot in (every.tolist(), every[::2].tolist()):
        assert got(suffix_dedup.dedup(docs_of(rows), batch_bytes=2000, bucket_bytes=500, hot=hot)) == plain(rows)
    docs = spark.createDataFrame([(i, f"{i} " * 20 + "the same eight bytes " * 30) for i in range(50)], "doc_id long, text string")
    total, found = suffix_dedup.survey(docs, 50, 1, least=40)
    assert total == sum(len(r.text) for r in docs.collect()) and 0 < len(found) <= 21 and (np.diff(found.astype(float)) > 0).all()


def test_kept_text(docs_of):
    rows = [(1, "x" * 60 + "abc"), (2, "12" + "x" * 60 + "3é"), (3, None)]
    assert {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.dedup(docs_of(rows), keep_text=True).collect()} == {1: "x" * 60 + "abc", 2: "123é", 3: ""}


def test_sf_table(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert got(suffix_dedup.dedup(sf_docs)) == plain(rows)


def test_empty(docs_of):
    assert suffix_dedup.dedup(docs_of([])).collect() == []


def test_blocks_agree_with_a_dictionary():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 99, 4000).astype(np.uint8)
    body[1000:2000] = body[:1000]
    text = np.concatenate([body, np.zeros(64, np.uint8)])
    at = rng.permutation(3950)
    doc = rng.integers(0, 1000, len(at))
    low = {}
    for p, d in zip(at.tolist(), doc.tolist()):
        w = body[p : p + 50].tobytes()
        low[w] = min(low.get(w, d), d)
    want = [low[body[p : p + 50].tobytes()] for p in at.tolist()]
    assert suffix_dedup.smallest_of_equal(text, at, doc, 50, block=256).tolist() == want

"""Packing: exact pieces, gapless sequences, and cuts as cheap as those of a quadratic search."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from pointloom.llm import packing
from pointloom.llm.tokens import default_path


def check(rows, found, window):
    full = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = sorted((str(i), tuple(full.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert 0 < r.length <= window and r.offset + r.length <= window
        by_doc[str(r.doc_id)].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    ids = defaultdict(list)
    for i, tokens in want:
        ids[i].append(tokens)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        assert sorted({(len(t)) for t in ids[i]}) == sorted({r.doc_tokens for r in pieces})
        pool = [(a, len(a)) for a in ids[i]]
        assert sum(r.length for r in pieces) == sum(n for _, n in pool)
        for r in pieces:
            assert any(zlib.crc32(np.array(a[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for a, n in pool if n == r.doc_tokens)
    return sum((window if (n := sum(r.length for r in p)) & (n - 1) else n) - n for p in by_sequence.values()) / sum(len(t) for _, t in want)


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "Hello, World. It's <|endoftext|> naïve 漢字 😀!"), (None, "no id"), (4, "twice"), (4, "twice"), (5, "very long text. " * 20_000), (6, "x" * 30_000), (7, "\t\n ")]
    check(rows, packing.pack(docs_of(rows)).collect(), 4096)
    check(rows, packing.pack(docs_of(rows), window=64, run_tokens=500).collect(), 64)
    assert packing.pack(docs_of([])).collect() == []


def test_little_padding(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert check(rows, packing.pack(sf_docs.coalesce(1)).collect(), 4096) < 0.02


def test_best_cuts_are_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 40)))])
        penalty = rng.integers(0, 6, len(at))
        penalty[0] = 0
        window = int(rng.integers(8, 30))
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + window - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= window)
        cuts = packing.best_cuts(at, penalty, window)
        cost = dict(zip(at.tolist(), penalty.tolist()))
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        assert sum(window - (b - a) + cost[b] for a, b in zip(cuts, cuts[1:])) == best[-1]
        assert all(0 < b - a <= window for a, b in zip(cuts, cuts[1:]))

"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import zstandard
from test_simhash import expected as components_of
from tokenizers import Tokenizer

from pointloom.llm import compression, labelled, mixing, personal_data
from pointloom.llm.tokens import default_path

DIR = "/root/testdata/sf0.001"


def good(rows, model):
    """Ids of the rows that the compression model scores 0.3 or more, by zstandard itself."""
    def size(piece, content):
        return len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))

    out = []
    for r in rows:
        t = (r.text or "").encode()
        saved = sum(size(t[a : a + 1024], model.bad) - size(t[a : a + 1024], model.good) for a in range(0, len(t), 1024))
        if np.interp((saved + 256 * model.usual) / (len(t) + 256), model.at, model.value) >= 0.3:
            out.append(r.doc_id)
    return out


def mixed(rows):
    """Ids drawn under tempered targets, by plain proportional fitting over dictionaries."""
    full = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    cell, tokens = {}, {}
    for r in rows:
        t = r.text or ""
        dense = [len(re.findall(p, t)) / (max(len(t), 1) / 1000) / least for p, least in mixing.MARKS.values()]
        topic = mixing.TOPICS[int(np.argmax([*dense, 1.0]))]
        cell[r.doc_id] = (r.source or "other", r.lang or "other", topic)
        tokens[cell[r.doc_id]] = tokens.get(cell[r.doc_id], 0) + len(full.encode(t, add_special_tokens=False).ids) + 1
    total = sum(tokens.values())
    w = {c: n / total for c, n in tokens.items()}
    targets = []
    for k, power in enumerate((0.9, 0.9, 1.0)):
        held = {v: sum(n for c, n in tokens.items() if c[k] == v) / total for v in {c[k] for c in tokens}}
        whole = sum(s**power for s in held.values())
        targets.append({v: s**power / whole for v, s in held.items()})
    for _ in range(200):
        for k, target in enumerate(targets):
            have = {v: sum(x for c, x in w.items() if c[k] == v) for v in target}
            w = {c: x * target[c[k]] / have[c[k]] for c, x in w.items()}
    ratio = {c: w[c] / (tokens[c] / total) for c in w}
    most = max(ratio.values())
    return [i for i, c in cell.items() if int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:12], 16) / 2**48 < ratio[c] / most]


def test_stages_by_brute_force(spark, sf_docs, sf_labels):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "packing"]
    model = compression.fit(*labelled.sample(sf_docs, sf_labels, "quality", 1500))
    full = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    docs, rows = sf_docs, sf_docs.collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = rows, stage(spark, docs, DIR).persist()
        rows = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        assert len(texts) == len(before)
        if k < 4:
            assert docs.columns == sf_docs.columns and docs.dtypes == sf_docs.dtypes
        if k == 0:
            assert sorted(r.doc_id for r in rows) == sorted(good(before, model))
        if k == 1:
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in components_of([(r.doc_id, r.text) for r in before])})
        if k in (0, 1, 3):
            assert all(r.text == texts[r.doc_id] for r in rows)
        if k == 2:
            found = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(before, sf_docs.schema)).collect()}
            for r in rows:
                spans, out, at = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in found[r.doc_id].split(",") if s)], [], 0
                text, reach = texts[r.doc_id] or "", 0
                for a, b, kind in spans:
                    if a >= reach:
                        out += [text[at:a], f"[{kind.upper()}]"]
                    reach = at = max(reach, b)
                assert (r.text or "") == "".join([*out, text[at:]]) and r.n_chars == len(r.text)
            assert not any(re.search(r"[A-Za-z0-9]+@[A-Za-z0-9]+[.][a-z]+", r.text) for r in rows)
        if k == 3:
            assert sorted(r.doc_id for r in rows) == sorted(mixed(before))
            assert len(rows) > 0.5 * len(before)
        if k == 4:
            pieces, places = {}, {}
            for r in rows:
                pieces.setdefault(r.doc_id, []).append(r)
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert set(pieces) == set(texts)
            for i, own in pieces.items():
                ids = np.array([*full.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
                own.sort(key=lambda r: r.start)
                assert [r.start for r in own] == [sum(q.length for q in own[:n]) for n in range(len(own))] and sum(r.length for r in own) == len(ids)
                assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
            for own in places.values():
                own.sort()
                assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096


def test_run_is_all_stages(spark):
    found = corpus_pipeline.run(spark, DIR)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 50

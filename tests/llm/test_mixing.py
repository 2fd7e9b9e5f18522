import hashlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pointloom.llm import mixing
from pointloom.llm.tokens import default_path

ROWS = [(i, f"text {i} of some words" + (" a@b.c" if i % 3 == 0 else "") + (" x | y" if i % 5 == 0 else "")) for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ("a", "b", None, "zz")[i % 4], ("en", "xx")[i % 2], 5.0) for i, t in rows], "doc_id long, text string, source string, lang string, probability double").repartition(3)


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    cells = [(s, g, t) for s in "abc" for g in "xy" for t in "pq"]
    tokens = rng.random(len(cells)) + 0.1
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.4, "y": 0.6}, {"p": 0.9, "q": 0.1}]
    raked = mixing.rake(cells, tokens, targets)
    for k, target in enumerate(targets):
        for v, want in target.items():
            assert abs(sum(w for c, w in zip(cells, raked.weight) if c[k] == v) - want) < 1e-7
    assert raked.probability.max() == 1 and np.allclose(raked.probability / raked.probability.sum(), (raked.weight / tokens) / (raked.weight / tokens).sum())


def test_rows(spark):
    targets = dict(source_target={"a": 0.6, "b": 0.2, "other": 0.2}, lang_target={"en": 0.5, "other": 0.5}, topic_target={"prose": 0.5, "contact": 0.3, "table": 0.2})
    rows = mixing.mix(frame(spark, ROWS), **targets).collect()
    assert len(rows) == len(ROWS) and rows[0].__fields__ == ["doc_id", "source_slot", "lang_slot", "topic", "tokens", "probability", "sampled", "gap"]
    text = dict(ROWS)
    full = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    cells = {}
    for r in rows:
        assert r.source_slot == ("a", "b", "other", "other")[r.doc_id % 4] and r.lang_slot == ("en", "other")[r.doc_id % 2]
        t = text[r.doc_id]
        assert r.topic == ("contact" if "@" in t else "table" if " | " in t else "prose")
        assert r.tokens == len(full.encode(t, add_special_tokens=False).ids) + 1
        key = (r.source_slot, r.lang_slot, r.topic)
        cells[key] = cells.get(key, 0) + r.tokens
    # plain proportional fitting over dictionaries
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    for _ in range(300):
        for k, target in enumerate(targets.values()):
            have = {v: sum(x for c, x in w.items() if c[k] == v) for v in target}
            whole = sum(t for v, t in target.items() if have[v])
            w = {c: x * target[c[k]] / whole / have[c[k]] for c, x in w.items()}
    ratio = {c: w[c] / (cells[c] / total) for c in w}
    # each source stands in one language here, so that the targets can't all be met
    gap = max(abs(sum(x for c, x in w.items() if c[k] == v) - t) for k, target in enumerate(targets.values()) for v, t in target.items() if any(c[k] == v for c in w))
    assert gap > 0.05
    for r in rows:
        want = ratio[r.source_slot, r.lang_slot, r.topic] / max(ratio.values())
        assert abs(r.probability - want) < 1e-9
        assert r.sampled == (int(hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48 < r.probability)
        assert abs(r.gap - gap) < 1e-9
    again = {r.doc_id: r.sampled for r in mixing.mix(frame(spark, ROWS).repartition(7), **targets).collect()}
    assert all(again[r.doc_id] == r.sampled for r in rows)


def test_nulls_and_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    rows = mixing.mix(spark.createDataFrame([(None, None, None, None), (1, "", "src0", "en"), (1, "", "src0", "en"), (2, "long " * 100_000, "src1", "de")], "doc_id long, text string, source string, lang string")).collect()
    assert len(rows) == 4 and all(0 <= r.probability <= 1 for r in rows)


def test_sample_keeps_columns_and_most_rows(sf_docs):
    out = mixing.sample(sf_docs)
    assert out.columns == sf_docs.columns and out.count() > 0.5 * sf_docs.count()


def test_topic_is_the_densest_mark():
    texts = ["", "plain words", "a@b.c and c@d.e | x", "x | y | z | w " * 9 + "a@b.c", "word " * 400 + "a@b.c", "Copyright. All rights reserved. a@b.c", "word " * 100 + "licensed"]
    assert mixing.topics_of(pa.array(texts)).to_pylist() == ["prose", "prose", "contact", "table", "prose", "legal", "legal"]


def test_targets_of_zero_and_of_none():
    cells, tokens = [(s, g, "p") for s in "abc" for g in "xy"], np.arange(1.0, 7.0)
    raked = mixing.rake(cells, tokens, [{"a": 0.0, "b": None}, {}, {}])
    share = {s: sum(w for c, w in zip(cells, raked.weight) if c[0] == s) for s in "abc"}
    assert share["a"] == 0 and share["b"] == pytest.approx(7 / 18) and raked.probability[:2].max() == 0
    with pytest.raises(ValueError, match="leave nothing"):
        mixing.rake(cells, tokens, [{s: 0 for s in "abc"}, {}, {}])


def test_share_and_contradictions():
    cells, tokens = [("a", "x", "p"), ("b", "y", "p")], np.array([1.0, 9.0])
    with pytest.raises(ValueError, match="contradict"):
        mixing.rake(cells, tokens, [{"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1}, {}], most_gap=0.01)
    raked = mixing.rake(cells, tokens, [{"a": 0.2, "b": 0.8}, {}, {}], share=0.25, rounds=1)
    assert raked.gap > 0
    raked = mixing.rake(cells, tokens, [{"a": 0.2, "b": 0.8}, {"x": 0.2, "y": 0.8}, {}], share=0.25)
    assert (raked.probability * tokens).sum() / tokens.sum() == pytest.approx(0.25)
    with pytest.raises(ValueError, match="smallest cell"):
        mixing.rake(cells, tokens, [{"a": 0.2, "b": 0.8}, {"x": 0.2, "y": 0.8}, {}], share=0.6)


def test_too_many_cells(spark):
    rows = spark.createDataFrame([(f"s{i}", "en", "prose", 1) for i in range(9)], "source string, lang string, topic string, tokens long")
    assert len(mixing.cell_sums(rows)[0]) == 9
    with pytest.raises(ValueError, match="more than 8"):
        mixing.cell_sums(rows, 8)

"""The two classifiers: held-out accuracy, definitions by brute force, gradients, and odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import compression, toxicity

DIR = "/root/testdata/sf0.1"  # smaller tables hold too few toxic documents to learn from


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.mark.parametrize(("run", "label", "threshold", "least"), [(compression.quality, "quality", 0.3, 0.9), (toxicity.toxicity, "toxic", 0.5, 0.95)])
def test_held_out(tables, run, label, threshold, least):
    docs, labels = tables
    found = run(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > least


@pytest.mark.parametrize("run", [compression.quality, toxicity.toxicity])
def test_odd_input(spark, docs_of, run):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (50, None, None)], "doc_id long, quality int, toxic int")
    rows = [(i, f"good words number {i} " * 9 if i % 2 else f"### junk {i} %%% " * 9) for i in range(40)] + [(None, "x"), (60, None), (61, ""), (62, "long text " * 50_000), (3, "twice")]
    assert len(run(docs_of(rows), labels).collect()) == len(rows)
    assert run(docs_of([]), labels).collect() == []
    constant = run(docs_of(rows), labels.where("doc_id < 0")).collect()
    assert len(constant) == len(rows) and len({r.score for r in constant}) == 1


def test_compressed_sizes():
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma"] if y else ["xx%%", "##yy", "zz||"], 60)), int(y), int(f)) for y in (0, 1) for f in (0, 1) for _ in range(30)]
    model = compression.fit(rows, [60, 60])
    score = model.scorer()
    assert score([rows[-1][0].encode()])[0] > 0.8 > 0.3 > score([rows[0][0].encode()])[0]
    differ = compression.Differ(model.good, model.bad, model.level, model.window)
    text = rows[0][0].encode() * 30
    assert differ(text) == sum(differ(text[at : at + model.window]) for at in range(0, len(text), model.window))
    want = np.interp((differ(text) + model.prior_bytes * model.usual) / (len(text) + model.prior_bytes), model.at, model.value)
    assert score([text])[0] == pytest.approx(want)
    assert (np.diff(model.value) > 0).all()


def test_gradients():
    texts = pa.array(["the cat sat", "you awful thing of a dog", ""])
    words, at, ends = toxicity.words_of(texts)
    net = toxicity.Network(["cat", "dog", "awful"], hidden=3, width=2, size=4, stride=2)
    net.start(3, np.zeros(4, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    doc, first, n = toxicity.windows_of(ends, net.size, net.stride)
    idx = np.append(at, np.zeros(net.size, np.int64))[first + np.arange(net.size)[:, None]]
    weight = np.linspace(1, 2, len(doc))

    def loss():
        x, _ = net.inputs(words)
        return float((net.forward(x.astype(np.float64), idx, n) * weight).sum())

    x, aux = net.inputs(words)
    _, kept = net.forward(x.astype(np.float64), idx, n, keep=True)
    grads = net.backward(x.astype(np.float64), aux, idx, n, weight, kept)
    rng = np.random.default_rng(0)
    for k, g in grads.items():
        flat = np.flatnonzero(np.abs(g).reshape(-1) > 1e-4)
        for i in rng.permutation(flat)[:4]:
            v, step = net.p[k].reshape(-1), 1e-2
            v[i] += step
            up = loss()
            v[i] -= 2 * step
            down = loss()
            v[i] += step
            assert (up - down) / (2 * step) == pytest.approx(g.reshape(-1)[i], rel=0.05, abs=2e-3), k


def test_every_window_counts():
    net = toxicity.Network(["bad"], hidden=3, width=2)
    net.start(1, np.zeros(2, np.float32))
    texts = ["word " * 3000 + "bad " * 5 + "word " * 2000, "short", "", "many other words here " * 40]
    doc, logit = net.logits(pa.array(texts))
    for d, text in enumerate(texts):
        words = text.split()
        starts = [0] if len(words) <= net.size else range(0, -(-(len(words) - net.size) // net.stride) * net.stride + 1, net.stride)
        want = [net.logits(pa.array([" ".join(words[s : s + net.size])]))[1][0] for s in starts]
        assert np.allclose(np.sort(logit[doc == d]), np.sort(want), atol=1e-5)


def plain_gru(net, words, states, way):
    """States of one direction over the words of a window, element by element."""
    p, h = net.p, net.hidden
    s = [0.0] * h
    out = [None] * len(words)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(len(words)) if way == "f" else reversed(range(len(words))):
        x = words[t]
        wx = [sum(x[i] * p["W" + way][i, k] for i in range(len(x))) + p["b" + way][k] for k in range(3 * h)]
        us = [sum(s[i] * p["U" + way][i, k] for i in range(h)) for k in range(3 * h)]
        z, r = [sig(wx[k] + us[k]) for k in range(h)], [sig(wx[h + k] + us[h + k]) for k in range(h)]
        c = [np.tanh(wx[2 * h + k] + r[k] * us[2 * h + k]) for k in range(h)]
        s = [c[k] + z[k] * (s[k] - c[k]) for k in range(h)]
        out[t] = s
    return out


def plain_toxicity(net, text):
    """The whole way from a text to its score: words, inputs, windows, both directions, attention, the largest logit."""
    import re

    found = re.findall(r"[^\W_]+", text.lower())
    at = {w: i + 1 for i, w in enumerate(net.vocabulary)}
    inputs = []
    for w in found:
        x = list(net.p["words"][at.get(w, 0)])
        data = b"\x02" + w.encode() + b"\x03"
        for k, bits in ((3, 12), (5, 14)):
            rows = []
            for i in range(len(data) - k + 1):
                h = 0
                for b in data[i : i + k]:
                    h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
                rows.append(net.p[f"chars{k}"][(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)])
            x += list(np.mean(rows, 0)) if rows else [0.0] * net.width
        inputs.append(x)
    best, start = -np.inf, 0
    while True:
        window = inputs[start : start + net.size]
        if window:
            both = [plain_gru(net, window, None, way) for way in "fb"]
            e = [float(np.dot(both[0][t], net.p["a"][: net.hidden]) + np.dot(both[1][t], net.p["a"][net.hidden :])) for t in range(len(window))]
            w = np.exp(np.array(e) - max(e))
            w /= w.sum()
            pooled = np.concatenate([sum(w[t] * np.array(s[t]) for t in range(len(window))) for s in both])
            best = max(best, float(pooled @ net.p["o"] + net.p["c"][0]))
        else:
            best = max(best, float(net.p["c"][0]))
        if start + net.size >= len(inputs):
            return 1 / (1 + np.exp(-(net.slope * best + net.offset)))
        start += net.stride


def test_toxicity_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    net = toxicity.Network(["cat", "awful", "naïve", "漢字"], hidden=3, width=2, size=4, stride=3, slope=1.7, offset=-0.2)
    net.start(5, np.zeros(5, np.float32))
    for k in net.p:
        net.p[k] = rng.normal(0, 0.7, net.p[k].shape).astype(np.float32)
    words = ["cat", "Awful", "dog", "naïve", "漢字", "x", "don't", "a-b", "12", "Über"]
    texts = ["", "  \n", "cat", "cat awful dog x", "cat awful dog x cat", *(" ".join(rng.choice(words, n)) for n in (6, 7, 8, 23))]
    want = [plain_toxicity(net, t) for t in texts]
    assert net.scores(pa.array(texts)).tolist() == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(toxicity, "fit", lambda rows, **how: net)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert [found[i] for i in range(len(texts) + 1)] == pytest.approx([*want, want[0]], abs=1e-5)


def test_quality_by_brute_force(spark, monkeypatch):
    import zstandard

    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma"] if y else ["xx%%", "##yy", "zz||"], 200)), int(y), int(f)) for y in (0, 1) for f in (0, 1) for _ in range(20)]
    model = compression.fit(rows, [40, 40])
    size = lambda piece, content: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece))
    texts = ["", "alpha beta " * 400, "##yy xx%% " * 90, "something else é漢", "alpha ##yy " * 30]
    want = []
    for t in (t.encode() for t in texts):
        saved = sum(size(t[a : a + 1024], model.bad) - size(t[a : a + 1024], model.good) for a in range(0, len(t), 1024))
        x = (saved + 256 * model.usual) / (len(t) + 256)
        k = int(np.searchsorted(model.at, x, "right"))
        inside = 0 < k < len(model.at)
        want.append(model.value[k - 1] + (model.value[k] - model.value[k - 1]) * (x - model.at[k - 1]) / (model.at[k] - model.at[k - 1]) if inside else model.value[0 if k == 0 else -1])
    monkeypatch.setattr(compression, "fit", lambda *a, **how: model)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.score, r.predicted) for r in compression.quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert [found[i][0] for i in range(len(texts) + 1)] == pytest.approx([*want, want[0]])
    assert all(p == (s >= 0.3) for s, p in found.values())


def test_monotone_curve_by_brute_force():
    """Pooled adjacent violators against the min-max formula of isotonic regression."""
    rng = np.random.default_rng(9)
    x, y, w = rng.random(40), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.2
    order = np.argsort(x)
    y, w = y[order], w[order]
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    best = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    at, value = compression.monotone(x[order], y, w, smooth=0.0)
    plain = (value - 0.02 * (at - at[0]) / (at[-1] - at[0])) / 0.98
    assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(plain, 9))))


def test_sample_is_bounded_and_whole(spark, docs_of):
    from pointloom.llm import labelled

    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0)], "doc_id long, quality int")
    long = "x" * 50_000 + " end"
    docs = docs_of([(i, f"{i} {long}") for i in range(60)] + [(i, "twice") for i in range(5) for _ in range(300)])
    rows, counts = labelled.sample(docs, labels, "quality", 20)
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert counts == [sum(i % 2 == k and i != 3 for i in train) for k in (0, 1)]
    assert all(t == "twice" or t.endswith("end") and len(t) > 50_000 for t, _, _ in rows) and len(rows) <= 40
    few, _ = labelled.sample(docs, labels, "quality", 200, most_bytes=120_000)
    assert 0 < sum(len(t) for t, y, _ in few if y) <= 120_000

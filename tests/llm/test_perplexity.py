import math
import re
from collections import Counter, defaultdict

import pytest

from pointloom.llm import perplexity as P

ROWS = [(1, None, "en"), (2, "", "en"), (3, " \n\n \t", "de"), (4, "one", None), (5, "a b c d e a b c d e f # | $x\n\na\nb\na\n a", "en"), (None, "the cat sat on the mat and the cat sat on the mat again ok", "xx"), (6, "the 漢字 Straße, naïve 😀 text goes on " * 3, "de"), (6, "the 漢字 Straße, naïve 😀 text goes on " * 3, "de"), (7, "word " * 40_000, "fr"), (8, "the cat sat on the mat again " * 9 + "word " * 60 + "naïve Straße " * 20, "en"), (9, "word " * 30 + "the cat sat on the mat " * 20, "yy")]


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def plain_scores(rows):
    """Mean negative log probability of a byte under an interpolated modified Kneser-Ney model of each language, from dictionaries."""
    by_lang = defaultdict(list)
    for _, text, lang in rows:
        by_lang[lang].append(list((text or "").encode()))
    models = {}
    for lang, texts in by_lang.items():
        counts = {P.ORDER: Counter(tuple(c[i : i + P.ORDER]) for t in texts for c in [[255] * (P.ORDER - 1) + t] for i in range(len(t)))}
        for k in range(P.ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        models[lang] = {}
        for k, table in counts.items():
            n = [sum(c == v for c in table.values()) for v in range(5)]
            d = (0.5, 0.75, 0.9)
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [min(max(x, 0), 0.95 * (i + 1)) for i, x in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]))]
            by = defaultdict(dict)
            for g, c in table.items():
                by[g[:-1]][g[-1]] = c
            models[lang][k] = d, by

    def prob(g, model):
        if not g:
            return 1 / 256
        d, by = model[len(g)]
        own = by[g[:-1]]
        cut = lambda c: d[min(c, 3) - 1]
        return (own[g[-1]] - cut(own[g[-1]]) + sum(map(cut, own.values())) * prob(g[1:], model)) / sum(own.values())

    out = []
    for _, text, lang in rows:
        c = [255] * (P.ORDER - 1) + list((text or "").encode())
        costs = [-math.log(prob(tuple(c[i : i + P.ORDER]), models[lang])) for i in range(len(c) - P.ORDER + 1)]
        out.append(sum(costs) / len(costs) if costs else None)
    return out


def quartiles(values):
    v = sorted(round(x, 4) for x in values)
    at = [q * (len(v) - 1) for q in (0.25, 0.5, 0.75)]
    return [v[int(x)] + (x - int(x)) * (v[min(int(x) + 1, len(v) - 1)] - v[int(x)]) for x in at]


def checked(found, rows):
    """Compare base counts, scores, bands and verdicts with what the definitions give."""
    found = sorted(found, key=lambda r: (str(r.doc_id), r.n_words))
    want = sorted(((i, *plain_base(t), s, lang, len((t or "").encode())) for (i, t, lang), s in zip(rows, plain_scores(rows), strict=True)), key=lambda r: (str(r[0]), r[1]))
    good = [not (w[1] < 10 or 100 * w[5] > 20 * w[1]) for w in want]
    ends = {}
    for lang in {w[7] for w in want}:
        own = [w for w, ok in zip(want, good, strict=True) if ok and w[7] == lang]
        ends[lang] = [quartiles(x) if x else None for x in ([w[6] for w in own], [w[6] * w[8] / w[1] for w in own])]
    for r, w, ok in zip(found, want, good, strict=True):
        assert tuple(r)[:6] == w[:6] and r.base_failed == (not ok)
        assert (r.log_perplexity is None) == (w[6] is None) or not w[8]
        if not ok:
            assert not r.kept
            continue
        assert r.log_perplexity == pytest.approx(w[6], abs=1e-5)
        inside = []
        for q, value, n, floor, noise, low, high in ((ends[w[7]][0], w[6], w[8], 0.012, 1.0, r.low, r.high), (ends[w[7]][1], w[6] * w[8] / w[1], w[1], 0.05, 3.0, r.word_low, r.word_high)):
            a = q[1] - 4 * max(q[1] - q[0], floor) - noise / math.sqrt(n)
            b = q[1] + 4 * max(q[2] - q[1], floor) + noise / math.sqrt(n)
            assert (low, high) == (pytest.approx(a, abs=1e-3), pytest.approx(b, abs=1e-3))
            inside.append(low <= value <= high)
        assert r.kept == all(inside)


def test_base_scores_and_bands(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("slot", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    checked(P.quality_rules(frame).collect(), ROWS)
    checked(P.quality_rules(frame, batch_bytes=50).collect(), ROWS)


def test_bands_of_the_own_language_reject(spark):
    import random

    rng = random.Random(5)
    text = lambda words, n=60: " ".join(rng.choice(words) for _ in range(n))
    latin, greek = "the cat sat on a mat while rain fell over towns".split(), "και το σπίτι ήταν μεγάλο στην πόλη μας χθες".split()
    rows = [(i, text(latin), "en") for i in range(40)] + [(100 + i, text(greek), "el") for i in range(40)]
    noise = lambda a, b: " ".join("".join(chr(rng.randint(a, b)) for _ in range(5)) for _ in range(60))
    rows += [(200, noise(97, 122), "en"), (201, noise(0x3B1, 0x3C9), "el"), (202, text(greek), "en")]
    found = P.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    checked(found, rows)
    assert {r.doc_id for r in found if not r.kept and not r.base_failed} >= {200, 201, 202}


def test_bytes_of_long_texts_are_cut_anywhere():
    import numpy as np

    texts = ["añb".encode() * 7, b"", b"xy", b"z" * 50]
    slot = np.array([1, 2, 3, 4])
    whole = [np.concatenate(x) for x in zip(*P.gram_codes(texts, slot))]
    for part in (1, 3, 8):
        for a, b in zip(whole, (np.concatenate(x) for x in zip(*P.gram_codes(texts, slot, part))), strict=True):
            assert (a == b).all()
    assert len(whole[0]) == sum(map(len, texts))


def test_model_sums_to_one(spark):
    import numpy as np

    grams = np.array([k << 8 | w for k in (0xFFFFFFFF, 0xFFFFFF61) for w in (97, 98, 99)] + [0x6162636465, 0x6162636466])
    counts = spark.createDataFrame([(int(g), n) for g, n in zip(grams, (3, 1, 1, 4, 1, 2, 5, 1), strict=True)], "key long, n long")
    p = {r.key: math.exp(r.log_p) for r in P.kneser_ney(counts).collect()}
    assert len(p) == len(grams)
    for context in {k >> 8 for k in p}:
        assert 0 < sum(v for k, v in p.items() if k >> 8 == context) <= 1 + 1e-6


def test_empty_and_clean_documents(docs_of, sf_docs, sf_labels):
    assert P.quality_rules(docs_of([])).collect() == []
    found = {r.doc_id: r.kept for r in P.quality_rules(sf_docs).collect()}
    labels = {r.doc_id: r.quality for r in sf_labels.collect()}
    good, bad = ([found[i] for i, q in labels.items() if q == k] for k in (1, 0))
    assert len(found) == sf_docs.count()
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.5 * len(bad)

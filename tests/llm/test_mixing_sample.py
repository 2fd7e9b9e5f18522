from tokenizers import Tokenizer

from pointloom.llm import mixing
from pointloom.llm.tokens import default_path


def test_every_source_is_tempered(spark):
    """A hundred equal sources and a large one: none may be favoured by its name, all small ones are raised."""
    rows = [(i * 1000 + k, "some words of a text", f"s{i:03d}", f"l{k % 20}") for i in range(100) for k in range(20)] + [(10**6 + k, "some words of a text", "big", f"l{k % 20}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells, tokens = mixing.cell_sums(mixing.described(docs, "doc_id", "text", "source", "lang"))
    targets = mixing.tempered(cells, tokens, 0.9, 0.9, 1.0)
    assert len(targets[0]) == 101 and len(targets[1]) == 20 and mixing.OTHER not in targets[0]
    own = {s: sum(w for c, w in zip(cells, tokens) if c[0] == s) / tokens.sum() for s in targets[0]}
    assert all(abs(t - own[s] ** 0.9) < 1e-12 for s, t in targets[0].items())
    targets[1], targets[2] = {}, {}
    raked = mixing.rake(cells, tokens, targets)
    by = dict(zip((c[0] for c in raked.cells), raked.probability))
    assert max(v for s, v in by.items() if s != "big") - min(v for s, v in by.items() if s != "big") < 1e-9 and by["big"] < 0.9 * by["s000"]
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    drawn = {r.source: r["count"] for r in kept.groupBy("source").count().collect()}
    assert drawn["big"] / 2000 < sum(drawn.get(f"s{i:03d}", 0) for i in range(100)) / 2000


def test_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "x", "other", "en")], "doc_id long, text string, source string, lang string")
    assert mixing.sample(docs.where("false")).collect() == []
    assert mixing.sample(docs).columns == docs.columns


def test_cells_hold_the_tokens_that_packing_makes(spark):
    rows = [(1, "Straße naïve text, 1984!", "a", "de"), (2, "漢字漢字漢字漢字", "a", "zh"), (3, None, "a", "de"), (4, "", None, None), (5, "plain words " * 50, "b", "en")]
    full = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = {}
    for _, text, source, lang in rows:
        key = (source or mixing.OTHER, lang or mixing.OTHER, "prose")
        want[key] = want.get(key, 0) + len(full.encode(text or "", add_special_tokens=False).ids) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(2)
    assert dict(zip(*mixing.cell_sums(mixing.described(docs, "doc_id", "text", "source", "lang")))) == want

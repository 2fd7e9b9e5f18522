"""Token counts against the library, text by text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointloom.llm import token_counts
from pointloom.llm.tokens import BatchCounter, default_path

TEXTS = [None, "", " ", "\n", "one", "Two words.", "don't we'll\tgo \n\n now  ", "<|endoftext|> in a text", "naïve Straße çà", "漢字 and 😀 emoji here", "a\rb\r\nc", "x" * 5000, "  lead", "12345 6.7e8 #$%", "word " * 60_000, "été " * 30_000 + "漢", "àb ​ c"]


ODD = ["a\u00a0 b \u3000c", "a \nb\n c\n\nd\n", "x\x85 y\x1c z", "a\u2028 b\u2003 c", " \n ", "it's ' s 're\n're", "1 2\n3  4", "<|endoftext|> <|endoftext|>\n<|endoftext|>", "e\u0301 \u0301x \ud7ff", "\u200b \u200bx", "\n", "\nx", "x\n", "\t x\ty", "a b", "a  b", "a\n\nb", "a\r\nb"]


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'sTé漢1.<|\u00a0\u3000\x1c"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    for counter, full in BOTH:
        want = [len(full.encode(t, add_special_tokens=False).ids) for t in [*texts, *ODD]]
        assert counter.counts([*texts, *ODD]) == want


BOTH = [(BatchCounter(default_path(n), memo=40, short=3, batch_bytes=20), Tokenizer.from_file(default_path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]


def test_which_vocabularies_are_split():
    assert [c.splits for c, _ in BOTH] == [True, False]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(docs_of, vocabulary):
    full = Tokenizer.from_file(default_path(vocabulary))
    rows = list(enumerate(TEXTS)) + [(4, "one"), (None, "one")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs_of(rows), vocabulary=default_path(vocabulary)).collect())
    want = []
    for i, t in rows:
        n = len(full.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_tables(docs_of, sf_docs):
    assert token_counts.token_counts(docs_of([])).collect() == []
    full = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in sf_docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(sf_docs).collect()} == {i: len(full.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}

"""Exact tokenizer access with memory-bounded memo tables.

Byte-pair merges never cross a pre-token, so a text's ids are the concatenation of its pre-tokens' ids. Lengths come from
the library's batch encoder over the different parts of texts. Ids of words are memoised, too (white-space chunk and
pre-token); every unseen pre-token goes through the ``tokenizers`` library's own model, and whatever that route doesn't
surely cover (scripts beyond Latin, control characters, special strings) through the library's full encoder.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What the fast route doesn't cover; of the rest, only tab, line feed, carriage return and space are white space.
_BEYOND = "[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\\|"
_BEYOND_RE = re.compile(_BEYOND)
#: A letter before a run of other signs that ends a word: a pre-token always starts after it.
_WORD_END = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{-~]+)([ \n])"


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, as latin-1 ordinals."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}


_AS_CHARS = _byte_chars()


class _Memo(dict):
    """A dict that makes missing values and is emptied when ``most`` keys are held."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


@lru_cache(2)
def _loaded(path: str):
    """A vocabulary's tokenizer, which stays as it is in the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _tokens_of(model, piece: str) -> bytes:
    """The ids of one pre-token."""
    if piece.isascii() and piece.isprintable():
        piece = piece.replace(" ", "\u0120")
    else:
        piece = piece.encode().decode("latin-1").translate(_AS_CHARS)
    return array("I", [t.id for t in model.tokenize(piece)]).tobytes()


def _word_of(full, pieces: _Memo, text: str) -> bytes:
    """The ids of one white-space chunk."""
    if _BEYOND_RE.search(text):
        return array("I", full.encode(text, add_special_tokens=False).ids).tobytes()
    text = text.lower()
    if text.isalpha():
        return pieces.make(text)
    return b"".join(map(pieces.__getitem__, _WORD_PATTERN.findall(text)))


class BatchCounter:
    """Numbers of tokens by the library's batch encoder, of which only lengths are kept.

    Texts are split where a pre-token surely starts: before a space, and around a line feed, that stand alone between other
    signs, and between a letter or digit and a sign (no apostrophe or bar). Equal parts are encoded once as long as the memo holds them (``memo`` parts of up to ``short`` signs); all
    parts that it doesn't hold go to the encoder in batches of about ``batch_bytes``. That these places are safe follows
    from the byte-level pre-tokenizer; under any other pre-tokenizer, or a normalizer, texts are encoded whole.
    """

    _SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)|(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[!-&(-/:-@\[-`{}~])")

    _WORD = re.compile(r" ?\S+")

    def __init__(self, path: str, memo: int = 700_000, short: int = 64, batch_bytes: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.most, self.short, self.batch_bytes, self.memo = memo, short, batch_bytes, {}
        made = json.loads(self.full.to_str())
        before = made["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and self._SAFE.split(t["content"]) == [t["content"]] for t in made["added_tokens"])
        self.splits = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and plain
        line_end = self.full.encode("\n", add_special_tokens=False).ids
        self.splits, self.line_end = self.splits and len(line_end) == 1, line_end[0] if line_end else -1

    def _batches(self, parts: list[str]) -> Iterator[list[str]]:
        at = 0
        while at < len(parts):
            end, held = at, 0
            while end < len(parts) and (end == at or held + len(parts[end]) <= self.batch_bytes):
                held += len(parts[end]) + 1
                end += 1
            yield parts[at:end]
            at = end

    def _lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for some in self._batches(parts) for e in self.full.encode_batch_fast(some, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[int]:
        """The same of parts that hold no white space but a space before them: a batch is one text, a line for each."""
        out = []
        for some in self._batches(words):
            ids = np.array(self.full.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids + [self.line_end])
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't keep line feeds apart")
            out += (np.diff(ends, prepend=-1) - 1).tolist()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if not self.splits:
            return self._lengths(texts)
        parts = [self._SAFE.split(t) for t in texts]
        unseen = list({p for own in parts for p in own} - self.memo.keys())
        if len(self.memo) + len(unseen) > self.most:
            self.memo.clear()
            unseen = list({p for own in parts for p in own})
        words = [p for p in unseen if self._WORD.fullmatch(p)]
        others = [p for p in unseen if not self._WORD.fullmatch(p)]
        self.memo.update(zip(words, self._joined(words), strict=True))
        self.memo.update(zip(others, self._lengths(others), strict=True))
        out = [sum(map(self.memo.__getitem__, own)) for own in parts]
        for p in unseen:
            if len(p) > self.short:
                del self.memo[p]
        return out


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, under a vocabulary that drops white space.

    A worker loads the vocabulary once. The memos know the tokenizer, not this object, so they go with the task: a cycle
    would keep those of every task until a full collection of garbage, which comes late.
    """

    def __init__(self, path: str, memo: int = 700_000):
        self.full = _loaded(path)
        self.pieces = _Memo(partial(_tokens_of, self.full.model), memo)
        self.words = _Memo(partial(_word_of, self.full, self.pieces), memo)

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Lower case, and a space before what ends a word: fewer different words, the same pre-tokens."""
        return pc.replace_substring_regex(pc.utf8_lower(texts), _WORD_END, r"\1 \2\3")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none is null) one after another, and where each text's ids end.

        Texts are cut at ASCII white space, which no pre-token crosses.
        """
        beyond = pc.match_substring_regex(texts, _BEYOND)
        words = pc.ascii_split_whitespace(pc.if_else(beyond, texts, self._lowered(pc.if_else(beyond, "", texts))))
        coded = words.values.dictionary_encode()
        ids = [self.words[w] for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        at = coded.indices.to_numpy()
        count = n[at]
        ends = np.cumsum(count)
        out = flat[np.repeat(start[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[words.offsets.to_numpy()[1:]]

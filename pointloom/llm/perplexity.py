"""Operator 1: quality rules with n-gram perplexity bands.

The language model is a modified Kneser-Ney model of the bytes of UTF-8 (so of every script, case and digits kept), one
for each language, over 5-grams. Spark counts the grams of all documents, makes the continuation counts and three
discounts of each order, and estimates all orders by joins; nothing is pruned, so the model grows with the corpus and is
never broadcast. A gram and its language are one 56-bit number, a hash without collisions of grams.

Documents travel in batches. A batch asks for its different grams once, and what it asked for comes back to it as an
array sorted by hash beside one of log probabilities, searched by binary search; so what is shuffled is a few hundred
thousand short rows and the compressed texts of each batch. Each document is scored whole, under the model of its own
language, and rejected where its mean log perplexity by byte or by word leaves the band of that language: the exact median
and, to either side, a multiple of the quartile's distance, wider for short texts, whose mean is noisy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, written

ORDER = 5
_BYTE, _PAD, _SLOTS = 8, 0xFF, 1 << 16  # byte 255 isn't in UTF-8, so it stands before a text's first byte
_SPACE = b" \t\n\x0b\x0c\r"


def language_slots(lang: pa.Array) -> np.ndarray:
    """16 bits of a hash of each row's language (null is a language of its own)."""
    coded = lang.cast(pa.string()).dictionary_encode()
    each = np.array([xxhash.xxh32_intdigest(v.encode(), 42) % _SLOTS for v in coded.dictionary.to_pylist()] + [0], np.int64)
    return each[pc.fill_null(coded.indices, len(each) - 1).to_numpy()]


def gram_codes(texts: list[bytes], slot: np.ndarray, part: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, key) of the gram that ends at each byte of the texts, about ``part`` bytes at a time, in order."""
    held, at = [], []
    size = 0

    def codes() -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter((len(t) - (ORDER - 1) for t in held), np.int64, len(held))
        raw = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
        start = np.cumsum(n + ORDER - 1) - n
        own = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        code = raw[own]
        for k in range(1, ORDER):
            code |= raw[own - k] << (_BYTE * k)
        text = np.repeat(np.array(at, np.int64), n)
        return text, code | slot[text] << (_BYTE * ORDER)

    pad = bytes([_PAD]) * (ORDER - 1)
    for i, t in enumerate(texts):
        for a in range(0, len(t), part):
            held.append((pad + t[max(0, a - (ORDER - 1)) : a])[-(ORDER - 1) :] + t[a : a + part])
            at.append(i)
            size += len(held[-1])
            if size >= part:
                yield codes()
                held, at, size = [], [], 0
    if held:
        yield codes()


def _content(piece: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return pc.fill_null(piece.column(1), "").cast(pa.binary()).to_pylist(), language_slots(piece.column(2))


def _distinct(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.add.reduceat(n[order], head)


def count_grams(docs: DataFrame, batch_bytes: int = 32 << 20) -> DataFrame:
    """batch, key and n: the grams of each batch of documents (doc_id, text, lang), each once."""

    def run(rows):
        for number, pieces in batches_of(rows, batch_bytes):
            keys, counts = [], []
            for piece in pieces:
                for _, code in gram_codes(*_content(piece)):
                    code.sort()
                    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    keys.append(code[head])
                    counts.append(np.diff(np.append(head, len(code))))
                    if len(keys) > 8:
                        keys, counts = ([x] for x in _distinct(keys, counts))
            if keys:
                key, n = _distinct(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number)), pa.array(key), pa.array(n)], ["batch", "key", "n"])

    return docs.mapInArrow(run, "batch long, key long, n long")


def discounts(one: Column, two: Column, three: Column, four: Column) -> list[Column]:
    """Discounts of counts 1, 2, and 3 or more, from how many grams have the counts 1 to 4; fixed ones where some are missing."""
    y = one / (one + 2 * two)
    own = [1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three]
    whole = (one > 0) & (two > 0) & (three > 0)
    return [F.when(whole, F.greatest(F.lit(0.0), F.least(d, F.lit(0.95 * (i + 1))))).otherwise(F.lit(plain)) for i, (d, plain) in enumerate(zip(own, (0.5, 0.75, 0.9), strict=True))]


def _slot(key: Column, order: int) -> Column:
    return F.shiftrightunsigned(key, _BYTE * order)


def _shorter(key: Column, order: int) -> Column:
    """Without its first byte, the language kept."""
    return F.shiftleft(_slot(key, order), _BYTE * (order - 1)).bitwiseOR(key.bitwiseAND((1 << (_BYTE * (order - 1))) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """key and log_p of every 5-gram, from key and n (each key once): interpolated modified Kneser-Ney.

    Groups are at most 256 grams of one context; the discounts are one row for each of 65,536 language slots at most.
    """
    orders = {ORDER: written(counts.select("key", F.col("n").cast("double").alias("c")), "zstd")}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = written(orders[k + 1].groupBy(_shorter(F.col("key"), k + 1).alias("key")).agg(F.count("*").cast("double").alias("c")), "zstd")
    lower = None
    for k in range(1, ORDER + 1):
        key, c = F.col("key"), F.col("c")
        of = lambda v: F.sum(F.when(F.col("c") == v, 1.0).otherwise(0.0))
        cut = orders[k].groupBy(_slot(key, k).alias("slot")).agg(*(of(v).alias(f"m{v}") for v in (1, 2, 3, 4)))
        cut = cut.select("slot", *(d.alias(f"d{i + 1}") for i, d in enumerate(discounts(*(F.col(f"m{v}") for v in (1, 2, 3, 4))))))
        rows = orders[k].withColumns({"slot": _slot(key, k), "context": F.shiftrightunsigned(key, _BYTE)}).join(F.broadcast(cut), "slot")
        own = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("context")
        rows = rows.withColumn("cut", own).withColumns({"total": F.sum("c").over(context), "back": F.sum("cut").over(context)})
        if lower is None:
            rows = rows.withColumn("p_lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", _shorter(key, k)).join(lower.select(key.alias("shorter"), F.col("p").alias("p_lower")), "shorter")
        lower = rows.select("key", ((F.col("c") - F.col("cut") + F.col("back") * F.col("p_lower")) / F.col("total")).alias("p"))
    return lower.select("key", F.log("p").cast("float").alias("log_p"))


def log_perplexity(texts: list[bytes], slot: np.ndarray, keys: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Mean negative log probability of a byte of each text (NaN of an empty one); ``keys`` are sorted and hold every gram."""
    total = np.zeros(len(texts))
    for text, code in gram_codes(texts, slot):
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        if not len(keys) or (keys[at] != code).any():
            raise ValueError("the documents changed between counting and scoring")
        head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        total[text[head]] += np.add.reduceat(log_p[at], head, dtype=np.float64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    with np.errstate(invalid="ignore"):
        return np.where(size > 0, -total / np.maximum(size, 1), np.nan)


def base_counts(text: str, span: int = 5) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, duplicate lines, and words in repeated ``span``-word windows."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(chr(c)) for c in _SPACE)
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n > span:
        windows = list(zip(*(words[k:] for k in range(span)), strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            hit = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n + 1, np.int64)
            cover[: len(hit)] += hit
            cover[span : span + len(hit)] -= hit
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_RAW = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, slot int, n_bytes long, log_perplexity double"


def scored(docs: DataFrame, asked: DataFrame, model: DataFrame, batch_bytes: int) -> DataFrame:
    """Base counts and log perplexity of each document; each batch meets the part of the model that it asked for."""
    names = [x.split()[0] for x in _RAW.split(", ")]

    def pack(rows):
        zip_ = zstandard.ZstdCompressor(level=9)
        for number, pieces in batches_of(rows, batch_bytes):
            for i, piece in enumerate(pieces):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_batch(piece)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([i]), pa.array([zip_.compress(sink.getvalue())])], ["batch", "piece", "docs"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, log_p = (right.column(c).to_numpy() for c in ("key", "log_p"))
        order = np.argsort(keys)
        keys, log_p = keys[order], log_p[order]
        out, unzip = [], zstandard.ZstdDecompressor()
        for blob in left.sort_by("piece").column("docs"):
            for piece in pa.ipc.open_stream(unzip.decompress(blob.as_buffer())):
                texts, slot = _content(piece)
                value = log_perplexity(texts, slot, keys, log_p)
                plain = [t.decode() for t in texts]
                base = np.array(list(map(base_counts, plain)), np.int64).reshape(-1, 5)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                out.append(pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(slot.astype(np.int32)), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(value, mask=np.isnan(value))], names))
        return pa.Table.from_batches(out)

    blobs = docs.mapInArrow(pack, "batch long, piece long, docs binary")
    answers = asked.join(model, "key").select("batch", "key", "log_p")
    return blobs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, _RAW)


def bands(rows: DataFrame, column: str) -> DataFrame:
    """slot and the exact quartiles of a column (rounded to 1e-4, so there are no more values than that allows) as an array."""
    seen = rows.where("not base_failed").groupBy("slot", F.round(column, 4).alias("v")).agg(F.count("*").alias("n"))
    return seen.groupBy("slot").agg(F.percentile("v", [0.25, 0.5, 0.75], F.col("n")).alias(f"q_{column}"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reach: float = 4.0, least: tuple[float, float] = (0.012, 0.05), short: tuple[float, float] = (1.0, 3.0), batch_bytes: int = 32 << 20) -> DataFrame:
    """Base counts, base_failed, log perplexity by byte and by word with their bands, and kept of each row.

    The mean is taken over bytes and over words, as signs that are easy to guess lower the first and raise the second.
    A band reaches from the language's median ``reach`` times the distance of the quartile (``least`` at least) plus
    ``short`` over the root of the number of bytes (or words) to either side; only rows that pass the base rules shape
    it. Null and empty texts have no words, fail the base rules and have null perplexities. Null ids stay; a null language
    is a language; languages share a model and a band where 16 bits of their hashes meet; repeated rows get repeated
    results; other columns are not read; an empty table gives no row. Texts are read whole.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    asked = written(count_grams(picked, batch_bytes), "zstd")  # a batch's keys ascend, so they take few bytes
    model = kneser_ney(asked.groupBy("key").agg(F.sum("n").alias("n")))
    rows = scored(picked, asked.select("batch", "key"), model, batch_bytes)
    rows = written(rows.withColumn("word_log_perplexity", F.when(F.col("n_words") > 0, F.col("log_perplexity") * F.col("n_bytes") / F.col("n_words"))), "zstd")
    out, kept = rows, ~F.col("base_failed")
    for column, length, prefix, floor, noise in zip(("log_perplexity", "word_log_perplexity"), ("n_bytes", "n_words"), ("", "word_"), least, short, strict=True):
        out = out.join(F.broadcast(bands(rows, column)), "slot", "left")  # at most 65,536 slots
        q, wide = F.col(f"q_{column}"), F.lit(noise) / F.sqrt(F.greatest(length, F.lit(1)))
        low, high = (q[1] - reach * F.greatest(q[1] - q[0], F.lit(floor)) - wide, q[1] + reach * F.greatest(q[2] - q[1], F.lit(floor)) + wide)
        out = out.withColumns({f"{prefix}low": low, f"{prefix}high": high})
        kept = kept & F.coalesce(F.col(column).between(F.col(f"{prefix}low"), F.col(f"{prefix}high")), F.lit(False))
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "low", "high", "word_log_perplexity", "word_low", "word_high", "kept")

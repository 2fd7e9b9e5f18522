"""Operator 4: compression classifier.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed with each in
windows; the difference of the compressed sizes over the text's size, drawn a little towards the usual difference of
good text (so that a few words decide nothing), goes through a monotone curve fitted on labelled texts that the
dictionaries haven't seen, weighted as the classes stand among all labels. Scoring is one map stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced
from .labelled import is_held_out, sample


@dataclass
class CompressionModel:
    """Dictionaries as bytes, the usual difference of good text, and the calibration: points of a curve."""

    good: bytes
    bad: bytes
    usual: float
    at: np.ndarray
    value: np.ndarray
    level: int = 3
    window: int = 1024
    prior_bytes: int = 256

    def scorer(self):
        """A function from a list of texts (bytes) to their scores."""
        differ = Differ(self.good, self.bad, self.level, self.window)

        def run(texts: list[bytes]) -> np.ndarray:
            x = np.array([differ.drawn(t, self.usual, self.prior_bytes) if self.good else 0.0 for t in texts], float)
            return np.interp(x, self.at, self.value)

        return run


class Differ:
    """The normalised difference of a text's compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, level: int, window: int):
        self.window = window
        self.pair = []
        for content in (bad, good):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.pair.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes) -> int:
        """Size with the bad dictionary minus size with the good one."""
        bad, good = (c.compress for c in self.pair)
        w = self.window
        return sum(len(bad(text[at : at + w])) - len(good(text[at : at + w])) for at in range(0, len(text), w))

    def drawn(self, text: bytes, usual: float, prior_bytes: int) -> float:
        """The difference by byte, drawn to the usual one as by ``prior_bytes`` more bytes."""
        return ((self(text) if text else 0) + prior_bytes * usual) / (len(text) + prior_bytes)


def _dictionary(texts: list[bytes], size: int, piece: int = 512) -> bytes:
    """Pieces from all over the texts, one of each text in turn, up to ``size`` bytes."""
    parts, held, turn = [], 0, 0
    while texts and held < size:
        for i, t in enumerate(texts):
            spread = (turn * len(texts) + i) * 0.6180339887498949 % 1
            at = int(spread * max(0, len(t) - piece + 1))
            parts.append(t[at : at + piece])
            held += len(parts[-1])
            if held >= size:
                break
        turn += 1
        texts = [t for t in texts if len(t) > turn * piece]
    return b"".join(parts)[:size]


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Points of the increasing curve nearest to y (pooled adjacent violators), a little tilted so that order is kept."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of w * x, sum of w * y, sum of w
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([w * a, w * b, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    mean = float((weight * y).sum() / weight.sum())
    at = np.array([b[0] / b[2] for b in blocks])
    value = np.array([(b[1] + smooth * mean) / (b[2] + smooth) for b in blocks])
    value = np.maximum.accumulate(value)
    low, high = at[0] - 1.0, at[-1] + 1.0
    at, value = np.concatenate([[low], at, [high]]), np.concatenate([[value[0]], value, [value[-1]]])
    return at, 0.98 * value + 0.02 * (at - low) / (high - low)


def fit(rows: list[tuple[str, int, int]], class_rows: list[int], dictionary_bytes: int = 112 << 10, level: int = 3, window: int = 1024, prior_bytes: int = 256) -> CompressionModel:
    """Build dictionaries from fold 0 and calibrate on fold 1; without both classes in both folds, a constant score."""
    data = [(t.encode(), y, f) for t, y, f in rows]
    texts = {(y, f): [t for t, a, b in data if (a, b) == (y, f) and t] for y in (0, 1) for f in (0, 1)}
    if not all(texts.values()):
        share = (class_rows[1] + 1) / (sum(class_rows) + 2)
        return CompressionModel(b"", b"", 0.0, np.array([-1.0, 1.0]), np.array([share, share]), level, window, prior_bytes)
    good, bad = (_dictionary(texts[y, 0], dictionary_bytes) for y in (1, 0))
    differ = Differ(good, bad, level, window)
    usual = float(np.median([differ(t) / len(t) for t in texts[1, 1]]))
    x = np.array([differ.drawn(t, usual, prior_bytes) for y in (0, 1) for t in texts[y, 1]])
    y = np.repeat([0.0, 1.0], [len(texts[0, 1]), len(texts[1, 1])])
    share = [class_rows[k] / len(texts[k, 1]) for k in (0, 1)]
    weight = np.where(y == 1, share[1], share[0]) / max(share)
    return CompressionModel(good, bad, usual, *monotone(x, y, weight), level, window, prior_bytes)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row."""

    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a curve

    def run(batches):
        scores = sent.value.scorer()
        for batch in balanced(batches, "text", batch_bytes):
            s = scores(pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = 1500, most_bytes: int = 64 << 20, threshold: float = 0.3) -> DataFrame:
    """Fit on a bounded labelled sample (``per_class`` rows and ``most_bytes`` of whole texts a class) and score every row.

    Null and empty texts get the score of the usual difference of good text. Null ids stay and count as held out. Repeated rows get
    repeated results; other columns are not read; without labels of both classes the score is their smoothed share.
    """
    return score(docs, fit(*sample(docs, labels, label, per_class, most_bytes, id_col, text_col)), id_col, text_col, threshold)


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.3, batch_bytes: int = 8 << 20) -> DataFrame:
    """The documents whose score is ``threshold`` or more, all columns as they are; a map stage, so no join by id."""

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = sent.value.scorer()
        for batch in balanced(batches, text_col, batch_bytes):
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()), "").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)

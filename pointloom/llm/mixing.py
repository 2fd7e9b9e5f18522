"""Operator 7: mixing sources to target weights by iterative proportional fitting.

One map stage finds each document's topic (the kind of mark it is densest in) and its tokens (those that packing makes).
Documents fall into cells of source, language and topic. The token weights of the cells are raked until their marginals
meet the targets of all three, and each document is sampled with its cell's calibrated probability: the raked over the
own weight of its cell, times the share of tokens asked for, or the largest share that no cell is too small for. Only cell
sums reach the driver.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import balanced, checkpoint
from .tokens import WordEncoder, default_path

OTHER = "other"
#: Of each topic its marks, and how many of them a thousand characters hold on average where the text is about it.
MARKS = {"legal": (r"(?i)licen[cs]e|copyright|rights reserved|warrant", 0.5), "contact": (r"@|\[EMAIL\]|\[PHONE\]|\+[0-9]", 1.0), "table": (r" \| |\t", 10.0)}
TOPICS = (*MARKS, "prose")
#: Target shares of the production mixture; None keeps a value's own share, 0 removes the value.
SOURCE_TARGET = {f"src{i}": 0.05 for i in range(20)} | {OTHER: None}
LANG_TARGET = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10, OTHER: 0.05}
TOPIC_TARGET = {"legal": 0.05, "contact": 0.10, "table": 0.05, "prose": 0.80}


def topics_of(texts: pa.Array) -> pa.Array:
    """The topic of each text (none is null): the kind whose marks are the densest, prose where none is dense enough."""
    thousands = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1) / 1000
    dense = [pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / thousands / least for pattern, least in MARKS.values()]
    best = np.argmax(np.stack([*dense, np.ones(len(texts))]), axis=0)
    return pa.array(TOPICS).take(pa.array(best))


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, vocabulary: str | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, source and lang (null is ``other``), topic and tokens (the end mark included) of each row."""
    path = vocabulary or default_path("word_bpe_49k.json")

    def run(batches):
        encoder = WordEncoder(path)
        for batch in balanced(batches, "text", batch_bytes):
            texts = pc.fill_null(batch.column(3), "")
            _, ends = encoder.encode(texts)
            tokens = np.diff(ends, prepend=0).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], topics_of(texts), pa.array(tokens)], ["doc_id", "source", "lang", "topic", "tokens"])

    own = [F.coalesce(F.col(c).cast("string"), F.lit(OTHER)).alias(n) for c, n in ((source_col, "source"), (lang_col, "lang"))]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own, F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, lang string, topic string, tokens long")


def slot(value: Column, target: dict) -> Column:
    """The value where the target names it, else ``other``."""
    named = sorted(set(target) - {OTHER})
    return F.when(value.isin(named), value).otherwise(OTHER) if named else F.lit(OTHER)


@dataclass
class Raked:
    """Cells as (source, language, topic), the probability of each, and how far the marginals are off at the end."""

    cells: list[tuple[str, str, str]]
    probability: np.ndarray
    weight: np.ndarray
    gap: float


def rake(cells: list[tuple[str, str, str]], tokens: np.ndarray, targets: list[dict], rounds: int = 200, close: float = 1e-13, share: float | None = None, most_gap: float | None = None) -> Raked:
    """Iterative proportional fitting of cell weights to the targets.

    Targets count over the values that have tokens and sum to one there; a value without a target, or with None, keeps
    its own share, and one with 0 goes. ``share`` is how much of all tokens to draw; None draws as much as no cell is too
    small for. A share that a cell is too small for is a ValueError, as are marginals off by more than ``most_gap``
    (where cells are missing, targets may contradict each other) and targets that leave nothing.
    """
    own = tokens / tokens.sum()
    w, at, want = own.copy(), [], []
    for k, target in enumerate(targets):
        values = sorted({c[k] for c in cells})
        number = {v: i for i, v in enumerate(values)}
        idx = np.array([number[c[k]] for c in cells])
        held = np.bincount(idx, own, len(values))
        t = np.array([s if target.get(v) is None else target[v] for v, s in zip(values, held, strict=True)], float)
        if (t < 0).any() or not t.sum() > 0:
            raise ValueError("targets are negative or leave nothing")
        at.append(idx)
        want.append(t / t.sum())
    gap = 1.0
    for _ in range(rounds):
        gap = 0.0
        for idx, t in zip(at, want, strict=True):
            have = np.bincount(idx, w, len(t))
            gap = max(gap, float(np.abs(have - t).max()))
            w = w * (t / np.where(have > 0, have, 1))[idx]
        if gap < close or not w.sum() > 0:
            break
    if not w.sum() > 0:
        raise ValueError("the targets leave no cell")
    w /= w.sum()
    gap = max(float(np.abs(np.bincount(idx, w, len(t)) - t).max()) for idx, t in zip(at, want, strict=True))
    if most_gap is not None and gap > most_gap:
        raise ValueError(f"the targets contradict each other: a marginal is off by {gap:.3g}")
    ratio = w / own
    most = 1 / ratio.max()
    if share is not None and share > most * (1 + 1e-9):
        raise ValueError(f"{share:.3g} of the tokens are asked for; the smallest cell allows {most:.3g}")
    return Raked(cells, np.minimum(1.0, ratio * (most if share is None else share)), w, gap)


def cell_sums(rows: DataFrame, most_cells: int = 2_000_000) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Cells (columns source, lang, topic) in order, and the tokens of each; ValueError beyond ``most_cells``."""
    sums = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(most_cells + 1).toArrow().sort_by([(c, "ascending") for c in ("source", "lang", "topic")])
    if sums.num_rows > most_cells:
        raise ValueError(f"there are more than {most_cells} cells of source, language and topic")
    cells = list(zip(*(sums.column(c).to_pylist() for c in ("source", "lang", "topic")), strict=True))
    return cells, sums.column("tokens").to_numpy().astype(float)


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id alone, so that a draw doesn't depend on the partitioning; null ids share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def drawn(doc_id, seed: int) -> float:
    """The same of one id."""
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) / float(1 << 48)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", source_target: dict | None = None, lang_target: dict | None = None, topic_target: dict | None = None, seed: int = 11, share: float | None = None, most_gap: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, lang and topic slots, tokens, probability, sampled, and the marginals' last gap, of each row.

    Null texts are one token (the end mark) and count as prose; null or unnamed sources and languages fall into ``other``;
    null ids stay; repeated rows are drawn alike; other columns are not read; an empty table gives no row. ``share`` and
    ``most_gap`` as in ``rake``. There are at most as many cells as the targets' sizes allow.
    """
    targets = [source_target or SOURCE_TARGET, lang_target or LANG_TARGET, topic_target or TOPIC_TARGET]
    rows = described(docs, id_col, text_col, source_col, lang_col, vocabulary)
    slots = [slot(F.col(c), t).alias(c) for c, t in zip(("source", "lang", "topic"), targets, strict=True)]
    rows = checkpoint(rows.select("doc_id", *slots, "tokens"))
    cells, tokens = cell_sums(rows)
    raked = rake(cells, tokens, targets, share=share, most_gap=most_gap) if cells else Raked([], np.zeros(0), np.zeros(0), 0.0)
    names = list(zip(*raked.cells, strict=True)) or [[], [], []]
    own = pa.table([*(pa.array(x, pa.string()) for x in names), pa.array(raked.probability, pa.float64())], names=["source", "lang", "topic", "probability"])
    out = rows.join(F.broadcast(docs.sparkSession.createDataFrame(own)), ["source", "lang", "topic"])
    return out.select("doc_id", F.col("source").alias("source_slot"), F.col("lang").alias("lang_slot"), "topic", "tokens", "probability", (draw("doc_id", seed) < F.col("probability")).alias("sampled"), F.lit(raked.gap).alias("gap"))


def tempered(cells: list[tuple[str, str, str]], tokens: np.ndarray, *powers: float) -> list[dict[str, float]]:
    """Targets in proportion to a power of the own token shares of every source, language and topic."""
    out = []
    for k, power in enumerate(powers):
        sums: dict[str, float] = {}
        for c, w in zip(cells, tokens.tolist(), strict=True):
            sums[c[k]] = sums.get(c[k], 0.0) + w
        total = sum(sums.values()) or 1
        out.append({v: (w / total) ** power for v, w in sums.items()})
    return out


def sample(docs: DataFrame, powers: tuple[float, float, float] = (0.9, 0.9, 1.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 11, share: float | None = None, wide_gap: float = 0.01, batch_bytes: int = 4 << 20) -> DataFrame:
    """The sampled documents under tempered targets of every source, language and topic, all columns as they are.

    By default small sources and languages are raised a little, and each topic is held at its own share.

    Two map stages, nothing is shuffled but cell sums; the driver and each task hold a number for each cell that has
    documents (at most ``most_cells`` of ``cell_sums``). A gap of the marginals beyond ``wide_gap`` is a warning.
    """
    cells, tokens = cell_sums(described(docs, id_col, text_col, source_col, lang_col))
    if not cells:
        return docs.where(F.lit(False))
    raked = rake(cells, tokens, tempered(cells, tokens, *powers), share=share)
    if raked.gap > wide_gap:
        warnings.warn(f"marginals are off by {raked.gap:.3g}: cells are missing that the targets need", stacklevel=2)
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(cells, raked.probability.tolist(), strict=True)))

    def run(batches):
        for batch in balanced(batches, text_col, batch_bytes):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            texts = pc.fill_null(column(text_col).cast(pa.string()), "")
            keys = zip(*(pc.fill_null(column(c).cast(pa.string()), OTHER).to_pylist() for c in (source_col, lang_col)), topics_of(texts).to_pylist(), strict=True)
            keep = [drawn(i, seed) < sent.value[k] for i, k in zip(column(id_col).to_pylist(), keys, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Operator 9: packing token streams into fixed windows by order-preserving dynamic programming.

Documents keep the order in which their partition holds them. Window cuts are chosen among document ends (free),
sentence ends (a small penalty) and, in stretches without either, evenly spaced hard cuts (a larger penalty), so that
padding plus penalties is least: best[j] = W - c_j + penalty_j + min over c_j - c_i <= W of (best[i] + c_i), whose
minimum a monotone queue keeps in constant time. The work is one map stage; a run of tokens at a time is held.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced
from .tokens import WordEncoder, default_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_ids: np.ndarray, sentence: int, hard: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut points of a run (0 and its end included), and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[1:][np.isin(ids, sentence_ids)] = sentence
    penalty[doc_ends] = 0
    penalty[0] = penalty[-1] = 0
    at = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(at) > gap)
    if len(wide):
        extra = np.concatenate([np.arange(at[i] + gap, at[i + 1], gap) for i in wide])
        penalty[extra] = hard
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int, tail: Callable[[int], int] | None = None) -> list[int]:
    """The cut points of least total padding plus penalties, the first and last included.

    ``tail`` gives the cost of what stands after the last cut but one, by its length; by default its padding.
    """
    c, p = at.tolist(), penalty.tolist()
    value, before = [0] * len(c), [0] * len(c)  # value: best[j] + c_j, what the queue compares
    queue: deque[int] = deque([0])
    for j in range(1, len(c)):
        low = c[j] - window
        while c[queue[0]] < low:
            queue.popleft()
        before[j] = queue[0]
        value[j] = window + p[j] + value[queue[0]]
        while queue and value[queue[-1]] > value[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [c[-1]], len(c) - 1
    if tail and j:
        near = range(bisect_left(c, c[-1] - window), j)
        j = min(near, key=lambda i: value[i] - c[i] + tail(c[-1] - c[i]))
        cuts.append(c[j])
    while j:
        j = before[j]
        cuts.append(c[j])
    return cuts[::-1]


def tail_cost(n: int, window: int, hard: int) -> int:
    """Cost of the last window: its padding, or that of its cuts at powers of two."""
    return min(window - n, (n.bit_count() - 1) * hard)


def tail_lengths(n: int, window: int, hard: int) -> list[int]:
    """How the last window is laid out: powers of two, which need no padding, where their cuts cost less than padding."""
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return powers if (len(powers) - 1) * hard < window - n else [n]


class _Packer:
    def __init__(self, window: int, sentence_ids: np.ndarray, sentence: int, hard: int, gap: int, first_id: int):
        self.window, self.cost, self.next_id = window, (sentence_ids, sentence, hard, gap), first_id
        self.docs: list[list] = []  # id, tokens of the whole document, ids not yet packed, where these start
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids), ids, 0])
        self.held += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of all windows but the last one, which a later run may fill; with ``last``, of all."""
        if not self.docs:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        # what a run leaves open costs nothing, as the next run goes on with it
        tail = (lambda n: tail_cost(n, self.window, self.cost[2])) if last else lambda n: 0
        cuts = best_cuts(*cut_points(ids, ends, *self.cost), self.window, tail)
        if last:
            cuts[-1:] = (cuts[-2] + np.cumsum(tail_lengths(cuts[-1] - cuts[-2], self.window, self.cost[2]))).tolist()
        else:
            cuts.pop()
        rows, k, kept = [], 0, 0
        for start, end in zip(cuts, cuts[1:], strict=False):
            at = start
            while at < end:
                doc_id, n, own, done = self.docs[k]
                take = min(len(own), end - at)
                rows.append((doc_id, done, take, zlib.crc32(own[:take].tobytes()), n, self.next_id, at - start))
                at += take
                if take == len(own):
                    k += 1
                else:
                    self.docs[k] = [doc_id, n, own[take:], done + take]
            self.next_id += 1
            kept = end
        self.docs = self.docs[k:]
        self.held -= kept
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = 4096, end_id: int = 2, sentence_penalty: int = 8, hard_penalty: int = 64, gap: int = 64, run_tokens: int = 1 << 19, batch_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens; see ``SCHEMA``.

    Each document is its token ids and ``end_id``, so null and empty texts are one token. Null ids stay, repeated rows
    are packed as often as they stand there, other columns are not read, an empty table gives no row. Documents longer
    than a window go over several. sequence_id holds the partition in its upper bits.
    """
    path = vocabulary or default_path("word_bpe_49k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        encoder = WordEncoder(path)
        stops = np.array(sorted({i for s in (".", "!", "?", "。") for i in encoder.full.encode(s, add_special_tokens=False).ids[-1:]}), np.uint32)
        packer = _Packer(window, stops, sentence_penalty, hard_penalty, min(gap, window), TaskContext.get().partitionId() << 40)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
        for batch in balanced(batches, "text", batch_bytes):
            flat, ends = encoder.encode(pc.fill_null(batch.column(1).cast(pa.string()), ""))
            start = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                packer.add(doc_id, np.append(flat[start:end], np.uint32(end_id)))
                start = end
                if packer.held >= run_tokens and (rows := packer.pack(False)):
                    yield out(rows)
        if rows := packer.pack(True):
            yield out(rows)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)

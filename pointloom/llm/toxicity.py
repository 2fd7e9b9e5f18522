"""Operator 10: toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as a word vector (words of the training vocabulary) beside the means of its hashed three- and
five-character vectors (any word). A forward and a backward gated recurrent layer run over overlapping windows, attention pools their
states, and a document's score is the calibrated largest logit of all its windows. Training is plain numpy with
back-propagation through time on a bounded labelled sample: the label holds for a document, so each pass takes the
window that now scores highest in each document (and a random one of each clean document). Scoring is one map stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced
from .labelled import is_held_out, sample

_GRAMS = {3: 12, 5: 14}  # bytes in a gram: bits of its hash


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different lower-case words (letters and digits), each word's position among them, and where each text's words end."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), "[^\\pL\\pN]+", " ")
    lists = pc.ascii_split_whitespace(clean)
    coded = lists.values.dictionary_encode()
    at, ends = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        keep = at != blank
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        at = at[keep]
    return coded.dictionary, at, ends[1:]


def grams(words: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ``k``-byte grams of the words with their borders, and how many each word has."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(marked.buffers()[2], np.uint8)
    ends = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(words) + 1].astype(np.int64)
    n = np.maximum(np.diff(ends) - k + 1, 0)
    at = np.repeat(ends[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h = np.zeros(len(at), np.uint32)
    for i in range(k):
        h = (h ^ data[at + i]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _GRAMS[k])).astype(np.int64), n


def windows_of(ends: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of every window; a text without words has one window of none."""
    start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - start
    count = np.maximum(1, -(-(n - size) // stride) + 1)
    doc = np.repeat(np.arange(len(ends)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return doc, start[doc] + first, np.minimum(size, n[doc] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Parameters; vocabulary row 0 stands for every other word."""

    vocabulary: list[str]
    hidden: int = 8
    width: int = 8
    size: int = 40
    stride: int = 30
    slope: float = 1.0
    offset: float = 0.0
    p: dict = field(default_factory=dict)

    def start(self, seed: int, word_hint: np.ndarray) -> None:
        rng, h, d = np.random.default_rng(seed), self.hidden, (1 + len(_GRAMS)) * self.width
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"words": rng.normal(0, 0.1, (len(self.vocabulary) + 1, self.width)).astype(np.float32), **{f"chars{k}": rng.normal(0, 0.1, (1 << b, self.width)).astype(np.float32) for k, b in _GRAMS.items()}}
        self.p["words"][:, 0] = word_hint
        for way in "fb":
            self.p |= {"W" + way: draw(d, 3 * h), "U" + way: draw(h, 3 * h), "b" + way: np.zeros(3 * h, np.float32)}
        self.p |= {"a": draw(2 * h, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "c": np.zeros(1, np.float32)}

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, tuple]:
        """Input vector of each word, and what the backward pass needs."""
        own = pc.fill_null(pc.index_in(words, value_set=pa.array(self.vocabulary, pa.string())), -1).to_numpy() + 1
        parts, aux = [self.p["words"][own]], []
        for k in _GRAMS:
            gram, n = grams(words, k)
            start = np.cumsum(n) - n
            chars = np.zeros((len(words), self.width), np.float32)
            for at in range(0, len(words), 50_000):
                s = slice(at, at + 50_000)
                a, b = start[at], start[at] + n[s].sum()
                if b > a:
                    chars[s] = np.add.reduceat(self.p[f"chars{k}"][gram[a:b]], np.minimum(start[s] - a, b - a - 1), axis=0)
            chars[n == 0] = 0
            parts.append(chars / np.maximum(n, 1)[:, None])
            aux.append((gram, n))
        return np.concatenate(parts, 1).astype(np.float32), (own, aux)

    def layer(self, way: str, proj: np.ndarray, idx: np.ndarray, n: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, windows, hidden) of one direction; rows of ``idx`` are (step, window) word positions."""
        hid, steps = self.hidden, len(idx)
        u, h, saved = self.p["U" + way], np.zeros((idx.shape[1], self.hidden), np.float32), []
        states = np.empty((steps, *h.shape), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, hu, live = proj[idx[t]], h @ u, (n > t)[:, None]
            zr = _sigmoid(x[:, : 2 * hid] + hu[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            c = np.tanh(x[:, 2 * hid :] + r * hu[:, 2 * hid :])
            new = np.where(live, c + z * (h - c), h)
            if keep:
                saved.append((t, h, z, r, c, hu[:, 2 * hid :], live))
            states[t] = h = new
        return states, saved

    def forward(self, x: np.ndarray, idx: np.ndarray, n: np.ndarray, keep: bool = False):
        """Logit of each window."""
        both, saved = [], []
        for way in "fb":
            s, k = self.layer(way, x @ self.p["W" + way] + self.p["b" + way], idx, n, keep)
            both.append(s)
            saved.append(k)
        h = self.hidden
        e = both[0] @ self.p["a"][:h] + both[1] @ self.p["a"][h:]
        e[np.arange(len(idx))[:, None] >= np.maximum(n, 1)] = -1e9
        e -= e.max(0)
        att = np.exp(e)
        att /= att.sum(0)
        pooled = np.concatenate([(att[:, :, None] * s).sum(0) for s in both], 1)
        pooled[n == 0] = 0
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (both, saved, att, pooled)) if keep else logit

    def backward(self, x: np.ndarray, aux: tuple, idx: np.ndarray, n: np.ndarray, dlogit: np.ndarray, kept: tuple) -> dict:
        """Gradients of all parameters, given those of the logits."""
        both, saved, att, pooled = kept
        h, g = self.hidden, {}
        g["o"], g["c"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = np.outer(dlogit, self.p["o"])
        dpool[n == 0] = 0
        dstates = [att[:, :, None] * dpool[None, :, k * h : (k + 1) * h] for k in (0, 1)]
        datt = sum((both[k] * dpool[None, :, k * h : (k + 1) * h]).sum(2) for k in (0, 1))
        de = att * (datt - (att * datt).sum(0))
        g["a"] = np.concatenate([np.einsum("tn,tnh->h", de, both[k]) for k in (0, 1)])
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            dstates[k] = dstates[k] + de[:, :, None] * self.p["a"][k * h : (k + 1) * h]
            u, dh = self.p["U" + way], np.zeros((idx.shape[1], h), np.float32)
            du, dproj = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t, before, z, r, c, hun, live in reversed(saved[k]):
                dh = dh + dstates[k][t]
                dnew = np.where(live, dh, 0)
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (before - c) * z * (1 - z)
                dr = dc * hun * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], 1)
                inner = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dproj, idx[t], gates)
                du += before.T @ inner
                dh = np.where(live, dnew * z, dh) + inner @ u.T
            g["U" + way], g["b" + way], g["W" + way] = du, dproj.sum(0), x.T @ dproj
            dx += dproj @ self.p["W" + way].T
        own, by_gram = aux
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], own, dx[:, : self.width])
        for at, (k, (gram, count)) in enumerate(zip(_GRAMS, by_gram, strict=True), 1):
            g[f"chars{k}"] = np.zeros_like(self.p[f"chars{k}"])
            np.add.at(g[f"chars{k}"], gram, np.repeat(dx[:, at * self.width : (at + 1) * self.width] / np.maximum(count, 1)[:, None], count, axis=0))
        return g

    def logits(self, texts: pa.Array, part: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Document and logit of every overlapping window."""
        words, at, ends = words_of(texts)
        x, _ = self.inputs(words)
        doc, first, n = windows_of(ends, self.size, self.stride)
        at = np.append(at, np.zeros(self.size, np.int64))
        x = x if len(x) else np.zeros((1, (1 + len(_GRAMS)) * self.width), np.float32)
        out = np.empty(len(doc), np.float32)
        order = np.argsort(n, kind="stable")
        for a in range(0, len(doc), part):
            some = order[a : a + part]
            idx = at[np.minimum(first[some] + np.arange(max(1, n[some].max()))[:, None], len(at) - 1)]
            out[some] = self.forward(x, idx, n[some])
        return doc, out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated score of each text: its largest window logit through a logistic curve."""
        doc, logit = self.logits(texts)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, logit)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -30, 30)))


def fit(rows: list[tuple[str, int, int]], every: int = 8, **how) -> Network:
    """Train on labelled texts and calibrate on each ``every``-th of them, which training doesn't see.

    Where either part would lack a class, all texts serve both ends.
    """
    own, kept = [r for i, r in enumerate(rows) if i % every], rows[::every]
    if any(len({r[1] for r in part}) < 2 for part in (own, kept)):
        own = kept = rows
    net = train(own, **how)
    if net.vocabulary:
        doc, logit = net.logits(pa.array([r[0] for r in kept], pa.string()))
        best = np.full(len(kept), -np.inf)
        np.maximum.at(best, doc, logit)
        net.slope, net.offset = _calibrate(best, np.array([r[1] for r in kept]))
    return net


def train(rows: list[tuple[str, int, int]], vocabulary: int = 8000, epochs: int = 10, batch: int = 32, rate: float = 0.005, seed: int = 7) -> Network:
    """The network without its calibration; without both classes it gives a constant score."""
    y = np.array([r[1] for r in rows], np.int64)
    if not 0 < y.sum() < len(y):
        net = Network([])
        net.start(seed, np.zeros(1, np.float32))
        net.slope, net.offset = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    words, at, ends = words_of(pa.array([r[0] for r in rows], pa.string()))
    doc_of = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
    once = np.unique(doc_of * len(words) + at)
    df = np.stack([np.bincount((once % len(words))[y[once // len(words)] == k], minlength=len(words)) for k in (0, 1)])
    odds = np.log((df[1] + 0.5) / (y.sum() + 1)) - np.log((df[0] + 0.5) / ((1 - y).sum() + 1))
    weight = df.sum(0) * np.abs(odds)
    picked = np.lexsort((np.arange(len(words)), -weight))[:vocabulary]
    picked = picked[df.sum(0)[picked] >= 3]
    net = Network(words.take(pa.array(picked)).to_pylist())
    net.start(seed, np.concatenate([[0], np.clip(odds[picked] / 4, -1, 1)]).astype(np.float32))
    doc, first, n = windows_of(ends, net.size, net.stride)
    at = np.append(at, np.zeros(net.size, np.int64))
    rng = np.random.default_rng(seed)
    hint = np.concatenate([[0], np.cumsum(np.clip(odds, 0, 4)[at[: len(at) - net.size]] ** 2)])
    now = (hint[first + n] - hint[first]).astype(np.float32)
    m, v, step = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    share = y.mean()
    for epoch in range(epochs):
        if epoch:
            now = np.empty(len(doc), np.float32)
            x, _ = net.inputs(words)
            for a in range(0, len(doc), 8192):
                s = slice(a, a + 8192)
                now[s] = net.forward(x, at[first[s] + np.arange(net.size)[:, None]], n[s])
        order = np.lexsort((rng.random(len(doc)), -now, doc))
        top = order[np.searchsorted(doc[order], np.arange(len(rows)))]
        order = np.lexsort((rng.random(len(doc)), doc))
        other = order[np.searchsorted(doc[order], np.flatnonzero(y == 0))]
        todo = rng.permutation(np.concatenate([top, other]))
        for a in range(0, len(todo), batch):
            w = todo[a : a + batch]
            idx = at[first[w] + np.arange(net.size)[:, None]]
            used, flat = np.unique(idx, return_inverse=True)
            idx = flat.reshape(idx.shape)
            x, aux = net.inputs(words.take(pa.array(used)))
            logit, kept = net.forward(x, idx, n[w], keep=True)
            target = y[doc[w]]
            d = ((1 / (1 + np.exp(-logit)) - target) * np.where(target == 1, 0.5 / share, 0.5 / (1 - share)) / len(w)).astype(np.float32)
            step += 1
            for k, g in net.backward(x, aux, idx, n[w], d, kept).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic curve with both classes weighted alike, by Newton's method."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    weight, w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = 2000, most_bytes: int = 64 << 20, threshold: float = 0.5, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row, after training on a bounded sample.

    The sample is ``per_class`` rows and ``most_bytes`` of whole texts a class.

    Null and empty texts are one window without words. Null ids stay and count as held out. Repeated rows get repeated
    results; other columns are not read. Every window of a text of any length is scored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, label, per_class, most_bytes, id_col, text_col)[0]))

    def run(batches):
        net = sent.value
        for batch in balanced(batches, "text", batch_bytes):
            s = net.scores(pc.fill_null(batch.column(1).cast(pa.string()), "")).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(id_col).alias("held_out"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

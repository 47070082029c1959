"""Quality classifier: a factorisation machine on hashed words and structure statistics; metadata are left out.

Pairwise weights have a low rank, so a document is scored in time linear in its features by
``sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2) / 2``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._labels import training_rows
from .toxicity import _score

BITS = 15
RANK = 6
#: Most labelled documents a fit learns from.
TRAINING_ROWS = 4_000

STATISTICS = (
    "log words", "mean word length", "upper share", "digit share", "space share", "punctuation share", "symbol share", "pipe share",
    "shares of words with inner or trailing symbols", "repeated word share", "same as the word before", "line feeds a word",
    "capitalised words", "distinct word share", "log longest word", "log bytes a line",
)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        kind[c] = 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in " \t\n\r\x0b\x0c" else 4 if ch in ".,;:'\"()?-" else 5 if c < 128 and not ch.isalnum() else 0
    return kind


_KIND = _classes()


@dataclass
class Rows:
    """Features of a slice of documents: the hashed words of each with their weights, and its statistics."""

    at: np.ndarray  # where each row's words begin
    ids: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray) -> Rows:
    rows = len(offsets) - 1
    low = T.lower_ascii(buf)
    start, end, row = T.words(low, offsets)
    h = T.slice_hash(T.prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    word = (h >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique((row << BITS) | word, return_counts=True)
    owner, ids = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value**2, rows))
    value = value / np.maximum(norm[owner], 1e-9)

    n = np.bincount(row, minlength=rows).astype(float)
    size = np.diff(offsets).astype(float)
    some, n1 = np.maximum(size, 1), np.maximum(n, 1)
    of = np.repeat(np.arange(rows), np.diff(offsets))
    kind = _KIND[buf]
    share = [np.bincount(of[kind == k], minlength=rows) / some for k in (1, 2, 3, 4, 5)]
    length = (end - start).astype(float)
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    first = kind[start] if len(start) else np.zeros(0, np.uint8)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    distinct = np.bincount(np.unique((row << 40) | (h >> np.uint64(24)).astype(np.int64)) >> 40, minlength=rows) if len(h) else np.zeros(rows)
    lines = np.bincount(of[buf == 10], minlength=rows) + 1.0
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    stats = np.stack(
        [
            np.log1p(n) / 10, np.bincount(row, length, rows) / n1 / 10, share[0], share[1], share[2], share[3], share[4],
            np.bincount(of[buf == 124], minlength=rows) / n1, np.bincount(row[last == 5], minlength=rows) / n1, 1 - distinct / n1,
            np.bincount(row[same], minlength=rows) / n1, (lines - 1) / n1, np.bincount(row[first == 1], minlength=rows) / n1,
            distinct / n1, np.log1p(longest) / 5, np.log1p(size / lines) / 10,
        ],
        1,
    )
    return Rows(np.searchsorted(owner, np.arange(rows + 1)), ids, value, stats)


@dataclass
class Model:
    bias: float
    w: np.ndarray  # hashed words, then statistics
    v: np.ndarray  # (words + statistics) x RANK
    mean: np.ndarray
    scale: np.ndarray

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        r = features(buf, offsets)
        return 1 / (1 + np.exp(-np.clip(_margin(self, r.ids, r.values, _owner(r), self._stats(r.stats))[0], -40, 40)))

    def _stats(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)


def _owner(r: Rows) -> np.ndarray:
    return np.repeat(np.arange(len(r.at) - 1), np.diff(r.at))


def _margin(m: Model, ids: np.ndarray, values: np.ndarray, owner: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each row and its factor sums."""
    words, rows = 1 << BITS, len(stats)
    z = m.bias + np.bincount(owner, m.w[ids] * values, rows) + stats @ m.w[words:]
    sums = stats @ m.v[words:]
    squares = (stats**2) @ (m.v[words:] ** 2)
    for f in range(RANK):
        vx = m.v[ids, f] * values
        sums[:, f] += np.bincount(owner, vx, rows)
        squares[:, f] += np.bincount(owner, vx * vx, rows)
    return z + 0.5 * (sums**2 - squares).sum(1), sums


def per_row(r: Rows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(r.ids[a:b], r.values[a:b], s) for a, b, s in zip(r.at[:-1], r.at[1:], r.stats, strict=True)]


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 70, penalty: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the whole sample; both classes weigh alike. Without documents of both classes the score is their share."""
    words, k = 1 << BITS, len(STATISTICS)
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    m = Model(float(np.log(share / (1 - share))), np.zeros(words + k), np.zeros((words + k, RANK)), np.zeros(k), np.ones(k))
    if not len(labels) or labels.min() == labels.max():
        return m
    ids = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    stats = np.array([r[2] for r in rows])
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-6
    x = m._stats(stats)
    m.v = rng.normal(0, 0.02, m.v.shape)
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    m.bias = 0.0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), m.w, m.v)]
    for t in range(1, rounds + 1):
        z, sums = _margin(m, ids, values, owner, x)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        ex = e[owner] * values
        gw = np.append(np.bincount(ids, ex, words), e @ x) + penalty * m.w
        gv = np.empty_like(m.v)
        square = np.bincount(ids, ex * values, words)
        for f in range(RANK):
            gv[:words, f] = np.bincount(ids, ex * sums[owner, f], words) - square * m.v[:words, f]
            gv[words:, f] = x.T @ (e * sums[:, f]) - (e @ x**2) * m.v[words:, f]
        gv += penalty * m.v
        for p, g, (a, b) in zip((None, m.w, m.v), (np.array([e.sum()]), gw, gv), moments, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            step = 0.03 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            if p is None:
                m.bias -= float(step[0])
            else:
                p -= step
    return m


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of at most ``rows`` documents, each of at most 2**15 words; features are made where the texts are."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, buf = T.as_bytes(batch.column(0))
            for lo, hi in T.chunks(offsets):
                own = offsets[lo : hi + 1]
                made = per_row(features(buf[own[0] : own[-1]], own - own[0]))
                packed = [[x[i].astype(t).tobytes() for x in made] for i, t in enumerate((np.uint16, np.float32, np.float64))]
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), *(pa.array(p, pa.binary()) for p in packed)], names=["label", "ids", "words", "stats"])

    chosen = training_rows(docs, labels, label, rows).select("text", "label")
    got = chosen.mapInArrow(extract, "label int, ids binary, words binary, stats binary").toArrow()
    parts = (got[c].to_pylist() for c in ("ids", "words", "stats"))
    made = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.float32).astype(float), np.frombuffer(c)) for a, b, c in zip(*parts, strict=True)]
    return made, got["label"].to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    return fit(*sample(docs, labels, label, rows))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Whole texts; null and empty texts are scored by their statistics.

    Repeated rows keep a row each; a null id counts as held out; an empty table gives no row; further columns are
    not carried along.
    """
    return _score(docs, model, threshold, id_col, text_col)

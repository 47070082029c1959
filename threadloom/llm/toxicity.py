"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed n-grams (white space and ASCII punctuation folded, A-Z lower-cased) is scaled by the log ratio of their
counts in the two classes; a logistic regression with L2 penalty is fitted on that, and the product of both weights is the
model. Every n-gram enters whose log ratio is more than SURE of its standard deviations from 0; there is no cap on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _text as T
from ._labels import held_out, training_rows
from ._spark import durable

BITS = 19
GRAMS = (4, 5, 6)
#: Most labelled documents a fit learns from.
TRAINING_ROWS = 5_000
#: Standard deviations from 0 from which on an n-gram's log ratio counts.
SURE = 3.5

_BLANK = np.zeros(256, bool)
_BLANK[[c for c in range(128) if not chr(c).isalnum() and (c > 32 or 9 <= c <= 13)]] = True


def _folded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, white space and punctuation as one kind of byte, and a blank before and after each row."""
    low = T.lower_ascii(buf)
    low = np.where(_BLANK[low], np.uint8(32), low)
    size = np.diff(offsets)
    out = np.full(len(low) + 2 * len(size), 32, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(low)) + 2 * row + 1] = low
    return out, offsets + 2 * np.arange(len(offsets))


def gram_ids(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed ids of the n-grams at every position, one array for each n, and the rows' new offsets.

    The ids of a row are those at its positions but for the last n - 1.
    """
    folded, at = _folded(buf, offsets)
    prefix = T.prefix_hash(folded)
    return [(T.window_hash(prefix, n) >> np.uint64(64 - BITS)).astype(np.int32) for n in GRAMS], at


def features(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct ids of each row."""
    ids, at = gram_ids(buf, offsets)
    slot = np.zeros(1 << BITS, np.int32)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        own = np.concatenate([x[lo : max(lo, hi - n + 1)] for x, n in zip(ids, GRAMS, strict=True)])
        number = np.arange(len(own), dtype=np.int32)
        slot[own] = number  # the last position of each id wins
        out.append(own[slot[own] == number])
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each hashed n-gram, most of them 0
    bias: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, at = gram_ids(buf, offsets)
        live = self.weights != 0
        total = np.zeros(len(offsets) - 1)
        # only positions whose n-gram carries weight are looked at again
        row_of, id_of = [], []
        for x, n in zip(ids, GRAMS, strict=True):
            pos = np.flatnonzero(live[x])
            row = np.searchsorted(at, pos, "right") - 1
            inside = pos + n <= at[row + 1]
            row_of.append(row[inside]), id_of.append(x[pos[inside]])
        key = np.unique((np.concatenate(row_of).astype(np.int64) << BITS) | np.concatenate(id_of))
        np.add.at(total, key >> BITS, self.weights[key & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int], smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the shares of toxic and clean documents that hold an n-gram, and how many standard deviations it is from 0."""
    p, q = toxic + smooth, clean + smooth
    ratio = np.log(p / (n[1] + 2 * smooth)) - np.log(q / (n[0] + 2 * smooth))
    return ratio, np.abs(ratio) / np.sqrt(1 / p + 1 / q)


def fit(rows: list[np.ndarray], labels: np.ndarray, penalty: float = 1e-5, rounds: int = 100) -> Model:
    """``rows``: distinct ids of each document. Without documents of both classes the model is their share.

    A class weighs by the root of its number of documents, so that the rarer one isn't outvoted.
    """
    size = 1 << BITS
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), bias)
    count = [np.zeros(size), np.zeros(size)]
    for ids, y in zip(rows, labels, strict=True):
        count[y][ids] += 1
    ratio, sure = log_ratios(count[1], count[0], (int((1 - labels).sum()), int(labels.sum())))
    keep = np.flatnonzero(sure >= SURE)
    index = np.full(size, -1, np.int32)
    index[keep] = np.arange(len(keep))
    own = [index[r] for r in rows]
    own = [r[r >= 0] for r in own]
    length = np.array([len(r) for r in own])
    flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), length)
    r = ratio[keep]
    w, b = np.zeros(len(keep)), bias / 2
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    y = labels.astype(float)
    weight = np.where(y == 1, ((1 - share) / share) ** 0.5, 1.0)
    weight /= weight.sum()
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(row, (w * r)[flat], len(own)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(flat, error[row], len(keep)) * r + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(size, np.float32)
    weights[keep] = w * r
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents.

    N-grams are counted where the texts are and the counts added up by Spark; the driver gets the n-grams that enter the model
    (at most 2**BITS) and which of them each document holds.
    """
    sample = durable(training_rows(docs, labels, label, rows).select("label", "text"), "labelled")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not (n.get(0) and n.get(1)):
        return fit([], np.repeat([0, 1], [n.get(0, 0), n.get(1, 0)]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            offsets, buf = T.as_bytes(batch.column(1))
            labelled = batch.column(0).to_numpy()
            for lo, hi in T.chunks(offsets):
                own = offsets[lo : hi + 1]
                yield from zip(labelled[lo:hi], features(buf[own[0] : own[-1]], own - own[0]), strict=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for y, ids in each(batches):
            seen[y, ids] += 1
        live = np.flatnonzero(seen.any(0))
        yield pa.record_batch([pa.array(live.astype(np.int32)), pa.array(seen[0, live]), pa.array(seen[1, live])], names=["gram", "clean", "toxic"])

    total = sample.mapInArrow(count, "gram int, clean int, toxic int").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") + 1.0, F.col("clean") + 1.0  # as in log_ratios
    ratio = F.log(p / (n[1] + 2.0)) - F.log(q / (n[0] + 2.0))
    strong = total.where(F.abs(ratio) / F.sqrt(1 / p + 1 / q) >= SURE - 1e-6).select("gram").toArrow()["gram"].to_numpy()
    live = np.zeros(1 << BITS, bool)
    live[strong] = True

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, ids in each(batches):
            yield pa.record_batch([pa.array([int(y)], pa.int32()), pa.array([ids[live[ids]].tobytes()], pa.binary())], names=["label", "ids"])

    got = sample.mapInArrow(held, "label int, ids binary").toArrow()
    return fit([np.frombuffer(x, np.int32) for x in got["ids"].to_pylist()], got["label"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Whole texts; null and empty texts are scored like a blank one.

    Repeated rows keep a row each; a null id counts as held out; an empty table gives no row; further columns are
    not carried along.
    """
    return _score(docs, model, threshold, id_col, text_col)


def with_score(docs: DataFrame, model, text_col: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the model's score of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    columns = [c for c in docs.columns if c != into]
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, buf = T.as_bytes(batch.column(at))
            for lo, hi in T.chunks(offsets):
                own = offsets[lo : hi + 1]
                s = held.value.score(buf[own[0] : own[-1]], own - own[0])
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns, pa.array(s, pa.float64())], names=[*columns, into])

    rows = docs.select(*columns)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, DoubleType())]))


def _score(docs: DataFrame, model, threshold: float, id_col: str, text_col: str) -> DataFrame:
    scored = with_score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

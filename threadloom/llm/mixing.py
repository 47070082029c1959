"""Mixing documents to target weights by soft membership.

A softmax classifier on hashed words and structure statistics, fitted on the labels table, gives each document a posterior over
domains. Rates r >= 0 are then sought whose expected domain token totals ``sum_i r_i t_i p_ik`` are the targets, in
the sense of least squares. The gradient needs one vector of K totals a step: each step is one aggregation over the documents,
and a document's rate follows from its posterior and the steps so far, so no state is kept for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import _text as T
from . import quality
from ._spark import durable

#: Most labelled documents a fit learns from.
TRAINING_ROWS = 4_000
#: Projected-gradient steps at most, and the largest miss of a target's share at which they end.
STEPS, TOLERANCE = 40, 1e-6
#: With a capped domain, steps without a smaller miss after which they end.
PATIENCE = 3


@dataclass
class Domains:
    """Softmax regression; ``names`` are the domains in order."""

    names: list[str]
    w: np.ndarray  # (words + statistics + 1) x K
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, r: quality.Rows) -> np.ndarray:
        return _softmax(_margins(self.w, r.ids, r.values, quality._owner(r), np.clip((r.stats - self.mean) / self.scale, -4, 4)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _margins(w: np.ndarray, ids: np.ndarray, values: np.ndarray, owner: np.ndarray, stats: np.ndarray) -> np.ndarray:
    words = 1 << quality.BITS
    z = stats @ w[words:-1] + w[-1]
    for k in range(w.shape[1]):
        z[:, k] += np.bincount(owner, w[ids, k] * values, len(stats))
    return z


def fit_domains(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], domain: np.ndarray, names: list[str], rounds: int = 60) -> Domains:
    """Adam on the whole sample. Domains without a labelled document keep a small posterior."""
    words, stats_n, k = 1 << quality.BITS, len(quality.STATISTICS), len(names)
    w = np.zeros((words + stats_n + 1, k))
    m = Domains(names, w, np.zeros(stats_n), np.ones(stats_n))
    w[-1] = np.log((np.bincount(domain, minlength=k) + 0.5) / (len(domain) + 0.5 * k))
    if not len(rows):
        return m
    ids = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    stats = np.array([r[2] for r in rows])
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-6
    x = np.clip((stats - m.mean) / m.scale, -4, 4)
    y = np.eye(k)[domain]
    a, b = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = (_softmax(_margins(w, ids, values, owner, x)) - y) / len(rows)
        g = np.concatenate([np.stack([np.bincount(ids, e[owner, j] * values, words) for j in range(k)], 1), x.T @ e, e.sum(0)[None]])
        g[:-1] += 1e-5 * w[:-1]
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w -= 0.03 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    return m


def train(docs: DataFrame, labels: DataFrame, domain: Column, names: list[str], rows: int = TRAINING_ROWS) -> Domains:
    """``domain``: the name of a labelled row's domain, over the columns of ``labels``; null and other names don't count."""
    code = F.coalesce(*(F.when(domain == n, F.lit(i)) for i, n in enumerate(names)), F.lit(None).cast("int"))
    return fit_domains(*quality.sample(docs, labels.withColumn("_domain", code), "_domain", rows), names)


def with_posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """All rows and columns with ``_tokens`` (runs between white space) and ``_p`` (posterior of each domain)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    at = docs.columns.index(text_col)
    names = [*docs.columns, "_tokens", "_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, buf = T.as_bytes(batch.column(at))
            for lo, hi in T.chunks(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = buf[offsets[lo] : offsets[hi]]
                p = held.value.posteriors(quality.features(part, own))
                tokens = np.bincount(T.words(part, own)[2], minlength=hi - lo).astype(np.int64)
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns, pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=names)

    more = [StructField("_tokens", LongType()), StructField("_p", ArrayType(DoubleType()))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def least_rate(names: int, capped: int | None, p: str = "_p") -> Column:
    """The bound of a document's rate: 0, but 1 where there is a capped domain and it isn't the likeliest."""
    if capped is None:
        return F.lit(0.0)
    others = F.array_max(F.array(F.lit(0.0), *(F.get(F.col(p), F.lit(i)) for i in range(names) if i != capped)))
    return F.when(F.get(F.col(p), F.lit(capped)) > others, 0.0).otherwise(1.0)


def rate(moves: list[np.ndarray], p: str = "_p", capped: int | None = None) -> Column:
    """A document's rate: from 1, each step moves it along its posterior and cuts it at its bound."""
    r = F.lit(1.0)
    for v in moves:
        r = F.greatest(least_rate(len(v), capped, p), r - sum((F.get(F.col(p), F.lit(k)) * float(x) for k, x in enumerate(v)), F.lit(0.0)))
    return r


def fit_rates(
    rows: DataFrame, targets: np.ndarray, budget: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE, capped: int | None = None
) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps' moves (K numbers each) and the shares reached, for ``targets`` shares of ``budget`` times all tokens.

    ``rows`` have _tokens and _p. Projected gradient on ``|sum_i r_i t_i p_i / T - targets|^2 / 2`` from r = 1, in the metric of the
    documents' tokens and of the second moments of the posteriors of documents above zero, which makes a step without
    cuts exact. Targets that no rates reach (a domain without any posterior) are met as well as the steps allow.

    The share of a ``capped`` domain is only lowered: where the rows hold no more of it than its target, what they hold is
    the target of each domain and all rates stay 1. Rates of documents for which it isn't the likeliest stay 1 or more.
    """
    k = len(targets)
    total = rows.agg(F.sum("_tokens")).first()[0] or 0
    moves: list[np.ndarray] = []
    reached = np.zeros(k)
    if not total:
        return moves, reached
    goal = np.asarray(targets, float) * budget
    at = lambda i: F.get("_p", F.lit(i))
    weight = F.col("_tokens") / F.lit(float(total))
    best, best_miss, best_reached = 0, np.inf, reached
    for step in range(steps + 1):
        # at the first step with a cap, rows stand at their bound without having been cut
        free = F.lit(True) if capped is not None and step == 0 else F.col("r") > least_rate(k, capped)
        live = F.when(free, weight).otherwise(0.0)
        sums = [F.sum(F.col("r") * weight * at(i)) for i in range(k)]
        moments = {(i, j): F.sum(live * at(i) * at(j)) for i in range(k) for j in range(i, k)}
        got = list(rows.withColumn("r", rate(moves, capped=capped)).agg(*sums, *moments.values()).first())
        reached = np.array(got[:k])
        if capped is not None and step == 0 and reached[capped] <= goal[capped]:
            return moves, reached
        miss = reached - goal
        if (size := np.abs(miss).max()) < best_miss:
            best, best_miss, best_reached = len(moves), size, reached
        elif capped is not None and step - best >= PATIENCE:
            break
        if np.abs(miss).max() <= tolerance or step == steps:
            break
        gram = np.zeros((k, k))
        for (i, j), x in zip(moments, got[k:], strict=True):
            gram[i, j] = gram[j, i] = x
        # bounds at 1 can leave rows of one posterior only, from which a capped fit takes no direction
        moves.append(np.linalg.solve(gram + 1e-9 * np.eye(k), miss) if capped is None else np.linalg.lstsq(gram, miss, rcond=1e-6)[0])
    if capped is not None:
        return moves[:best], best_reached
    return moves, reached


@dataclass
class Mix:
    """A fitted mix: the rates of the fitted documents, and how to rate any rows."""

    model: Domains
    moves: list[np.ndarray]
    reached: dict[str, float]  # expected token share of each domain, of all tokens before
    rates: DataFrame  # doc_id, tokens, a posterior ``p_<name>`` for each domain, rate
    capped: int | None = None

    def apply(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", into: str = "rate") -> DataFrame:
        """All rows and columns of ``docs`` with their rate; a column named ``into`` is replaced."""
        others = [c for c in docs.columns if c != text_col]
        held = docs.select(F.col(text_col).alias("text"), F.struct(F.lit(None).alias("_"), *others).alias("rest"))  # names can't clash
        rated = with_posteriors(held, self.model)
        kept = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns if c != into]
        return rated.select(*kept, rate(self.moves, capped=self.capped).alias(into))


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
    capped: str | None = None,
) -> Mix:
    """Fit classifier and rates. ``targets`` are shares of ``budget`` times all tokens of ``docs``; for ``capped`` see fit_rates.

    Repeated rows get a rate each, null ids too; null and empty texts have no token and don't matter to the totals; an
    empty table gives no row. Further columns are not carried along in ``rates``, but by ``apply``.
    """
    names = sorted(targets)
    model = train(docs, labels, domain, names)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small = durable(with_posteriors(rows, model).drop("text"), "posteriors")
    cap = None if capped is None else names.index(capped)
    moves, reached = fit_rates(small, np.array([targets[n] for n in names]), budget, capped=cap)
    own = [F.get("_p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)]
    rates = small.select("doc_id", F.col("_tokens").alias("tokens"), *own, rate(moves, capped=cap).alias("rate"))
    return Mix(model, moves, dict(zip(names, reached.tolist(), strict=True)), rates, cap)


def copies(rate: Column, id_col: Column, seed: int = 0) -> Column:
    """How often a document is taken: its rate rounded up or down by the hash of its id, right on average."""
    u = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")

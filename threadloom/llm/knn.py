"""Exact top-k inner-product search as a Voronoi join.

Queries and data are grouped by their nearest pivot. First each query is solved within its own group, which gives
every group of queries a score that its k-th answers reach. Then a data vector goes to another group only if its upper
bound there reaches that score; the bounds come from summaries of the groups of queries (radius, length, greatest product
with each pivot) and the vector's own distance to its pivot. Groups of queries that would need most of the data
share one copy of it, so data that no bound can prune are moved once, not once for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text as T
from ._spark import durable

#: Pivots, by the root of the rows; the driver holds the square of their number.
FEWEST_PIVOTS, MOST_PIVOTS = 12, 256
#: A task solves at most about so many queries against about so many bytes of packed vectors.
QUERY_BLOCK, DATA_BYTES = 16_384, 12 << 20
#: Vectors of one packed row; queries and vectors of one product.
PACK, STEP, WIDTH = 1_024, 512, 8_192
#: Groups that reach more than this share of the data are solved together.
MOST_OF_IT = 0.5
#: Vector lengths that get pivots of their own, the most frequent ones; the rest are grouped by their length alone.
SHAPES = 4

_NONE = np.iinfo(np.int64).min
_FOUND = "g int, query_id long, vec_id long, score long"


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double>) with v = floor(scale * x); vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull()).where(sound)
    whole = lambda y: F.when(F.abs(y) < 2**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  beyond that a double has no fraction
    return rows.select("vec_id", F.transform("x", lambda e: whole(e * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _norm(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (pivots**2).sum(1)[None] - 2 * (m @ pivots.T)
    g = d.argmin(1)
    return g, _norm(m - pivots[g])


def _products(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; those beyond a long's range are held at its ends."""
    dim = x.shape[1]
    most = np.abs(x).max(initial=0)
    wide = np.abs(m).max(1, initial=0) * most * dim >= 2**53
    out = np.empty((len(x), len(m)), np.int64)
    out[:, ~wide] = x @ m[~wide].T
    if wide.any():  # beyond 53 bits: whole numbers of any size
        whole = np.frompyfunc(int, 1, 1)
        exact = whole(x) @ whole(m[wide]).T
        out[:, wide] = np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
    return out


def search(q: np.ndarray, x: np.ndarray, v: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``x``, id and score of the k best of each row, ties to the smaller id; rows of the query's own id don't count."""
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(q), STEP):
        own, part = q[at : at + STEP], x[at : at + STEP]
        row, vec, got = (np.zeros(0, np.int64),) * 3
        least = np.full(len(own), _NONE)
        for lo in range(0, len(v), WIDTH):
            ids = v[lo : lo + WIDTH]
            s = _products(part, m[lo : lo + WIDTH])
            s[own[:, None] == ids[None]] = _NONE
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(own), _NONE)
            i, j = np.nonzero((s >= np.maximum(kth, least)[:, None]) & (s > _NONE))
            row, vec, got = np.append(row, i), np.append(vec, ids[j]), np.append(got, s[i, j])
            order = np.lexsort((vec, -got, row))
            row, vec, got = row[order], vec[order], got[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            last = rank == k - 1
            least[row[last]] = got[last]
            row, vec, got = row[keep], vec[keep], got[keep]
        out.append((row + at, vec, got))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(m: np.ndarray) -> bytes:
    """In the narrowest of int16, int32 and float64; the length tells which."""
    most = np.abs(m).max(initial=0)
    return m.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def _unpack(ids: list[bytes], packed: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    each = [np.frombuffer(i, np.int64) for i in ids]
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    parts = [np.frombuffer(p, kinds[len(p) // (len(i) * dim)]).reshape(-1, dim) for i, p in zip(each, packed, strict=True)]
    return np.concatenate(each), np.concatenate(parts).astype(float)


def _salt(ids: np.ndarray, salts: int) -> int:
    return int(T.mix(np.bitwise_xor.reduce(T.mix(ids.view(np.uint64)))[None])[0] % np.uint64(salts))


_DATA = "g int, block int, salt int, ids binary, data binary"
_ASKED = "g int, block int, q_ids binary, q_data binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


@dataclass
class _Deal:
    """How the queries and vectors of each group are dealt to tasks: blocks of queries against salts of data."""

    blocks: dict[int, int]
    salts: dict[int, int]

    @classmethod
    def of(cls, asked: dict[int, int], rows: dict[int, int], dims: dict[int, int]) -> _Deal:
        return cls({g: max(1, -(-n // QUERY_BLOCK)) for g, n in asked.items()}, {g: max(1, -(-n * dims[g] * 2 // DATA_BYTES)) for g, n in rows.items()})

    def data(self, g: int, ids: np.ndarray, m: np.ndarray) -> list[tuple]:
        out = []
        for at in range(0, len(ids), PACK):
            part = np.ascontiguousarray(ids[at : at + PACK])
            salt, packed = _salt(part, self.salts[g]), (part.tobytes(), _pack(m[at : at + PACK]))
            out += [(g, b, salt, *packed) for b in range(self.blocks[g])]
        return out

    def queries(self, g: int, ids: np.ndarray, m: np.ndarray) -> list[tuple]:
        block = (T.mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(self.blocks[g])).astype(np.int64)
        return [(g, int(b), np.ascontiguousarray(ids[own]).tobytes(), _pack(m[own])) for b in np.unique(block) for own in [block == b]]

    def solve(self, data: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
        salts = F.create_map(*(F.lit(x) for g, n in self.salts.items() for x in (g, n)))
        return _solve(data, queries, F.element_at(salts, F.col("g")), k, lambda g: dim)


def _solve(data: DataFrame, queries: DataFrame, salts: Column, k: int, dim_of: Callable[[int], int]) -> DataFrame:
    """The k best of each query in each task, in which a block of a group's queries meets the group's vectors of one salt."""
    spread = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def local(key: tuple[pa.Scalar, ...], d: pa.Table, q: pa.Table) -> pa.Table:
        g = key[0].as_py()
        out = [np.zeros(0, np.int64)] * 3
        if len(d) and len(q):
            v, m = _unpack(d["ids"].to_pylist(), d["data"].to_pylist(), dim_of(g))
            ids, x = _unpack(q["q_ids"].to_pylist(), q["q_data"].to_pylist(), dim_of(g))
            row, vec, got = search(ids, x, v, m, k)
            out = [ids[row], vec, got]
        return pa.table([pa.array(np.full(len(out[0]), g, np.int32)), *out], names=["g", "query_id", "vec_id", "score"])

    key = ["g", "block", "salt"]
    return data.groupBy(key).cogroup(spread.groupBy(key)).applyInArrow(local, _FOUND)


def top_k(
    df: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    pivots: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k rows with the highest
    inner product of floor(scale * x), the query's own id left out; ties to the smaller id; all if fewer.

    Null ids take no part, nor do vectors that are null, empty or hold null or non-finite components. Vectors of
    different lengths are compared only with their own length. Repeated rows count once each: an id has one list, ranked
    over the pairs of each of its rows with each row of another id, as in the SQL, so the copies of a query bring a neighbour once each.
    An empty table gives no row. Scores are exact at any size; one beyond the range of a long is held at its end.
    ``report``, where given, gets for each vector length the share of (vector, group of queries) copies that the bounds left.
    """
    vectors = quantise(df, id_col, vector_col, scale)
    asked = F.count_if(F.col("vec_id") % every == 0).alias("asked")
    shapes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows"), asked).where("asked > 0")
    first = shapes.orderBy(F.desc("rows"), "dim").limit(SHAPES + 1).collect()
    parts = [_voronoi(vectors.where(F.size("v") == s["dim"]), s, k, every, pivots, report) for s in first[:SHAPES]]
    if len(first) > SHAPES:
        parts.append(_by_length(vectors.where(~F.size("v").isin([s["dim"] for s in first[:SHAPES]])), k, every))
    found = df.sparkSession.createDataFrame([], _FOUND)
    for part in parts:
        found = part if part is parts[0] else found.unionByName(part)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_length(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """Vectors of rare lengths: each length is a group, dealt by a hash of its ids."""
    tasks = max(1, -(-(vectors.agg(F.sum(F.size("v"))).first()[0] or 0) * 2 // DATA_BYTES))

    def deal(batch: pa.RecordBatch, queries: bool) -> list[tuple]:
        ids, length = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        out = []
        for d in np.unique(length):
            own = np.flatnonzero((length == d) & ((ids % every == 0) | (not queries)))
            if len(own):
                plan, m = _Deal({int(d): 1}, {int(d): tasks}), _matrix(batch.column(1).take(pa.array(own)), int(d))
                out += (plan.queries if queries else plan.data)(int(d), ids[own], m)
        return out

    def run(queries: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield _rows(deal(b, queries), _ASKED if queries else _DATA)

        return each

    return _solve(vectors.mapInArrow(run(False), _DATA), vectors.mapInArrow(run(True), _ASKED), F.lit(tasks), k, lambda g: g)


def _voronoi(vectors: DataFrame, shape, k: int, every: int, pivots: int | None, report: dict | None) -> DataFrame:
    dim = shape["dim"]
    wanted = pivots or int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, shape["rows"] ** 0.5 / 8)))
    # distinct vectors, so that one frequent vector isn't every pivot; at most ``wanted`` rows
    picked = vectors.select(F.xxhash64("v").alias("h"), "v").groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(wanted).collect()
    centre = np.array([r["v"] for r in picked])
    p = len(centre)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked, radius, reach, most = np.zeros(p, np.int64), np.zeros(p, np.int64), np.zeros(p), np.zeros(p), np.full((p, p), -np.inf)
        for b in batches:
            if b.num_rows:
                ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                g, d = _nearest(m, centre)
                rows += np.bincount(g, minlength=p)
                q = np.flatnonzero(ids % every == 0)
                asked += np.bincount(g[q], minlength=p)
                np.maximum.at(radius, g[q], d[q])
                np.maximum.at(reach, g[q], _norm(m[q]))
                np.maximum.at(most, g[q], m[q] @ centre.T)
        live = np.flatnonzero(rows)
        columns = [pa.array(live.astype(np.int32)), *(pa.array(c[live]) for c in (rows, asked, radius, reach))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(most[live].tolist(), pa.list_(pa.float64()))], names=["g", "rows", "asked", "radius", "reach", "most"])

    partial = vectors.mapInArrow(summarise, "g int, rows long, asked long, radius double, reach double, most array<double>")
    most_of = F.array(*(F.max(F.get("most", F.lit(j))) for j in range(p))).alias("most")
    groups = partial.groupBy("g").agg(F.sum("rows").alias("rows"), F.sum("asked").alias("asked"), F.max("radius").alias("radius"), F.max("reach").alias("reach"), most_of).collect()
    rows, asked, radius, reach, most = {}, {}, np.zeros(p), np.zeros(p), np.full((p, p), -np.inf)
    for r in groups:  # at most one row a pivot
        g = r["g"]
        rows[g], asked[g], radius[g], reach[g], most[g] = r["rows"], r["asked"], r["radius"], r["reach"], r["most"]
    live = np.array(sorted(g for g, n in asked.items() if n))  # groups that hold queries

    def dealt(deal: _Deal, place: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]], queries: bool) -> DataFrame:
        """Packed vectors or queries of the groups that ``place`` names, with the rows that go there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                    if queries:
                        own = np.flatnonzero(ids % every == 0)
                        ids, m = ids[own], m[own]
                    out = []
                    for g, own in place(m, _nearest(m, centre)[0]) if len(ids) else ():
                        if len(own):
                            out += (deal.queries if queries else deal.data)(int(g), ids[own], m[own])
                    yield _rows(out, _ASKED if queries else _DATA)

        return vectors.mapInArrow(run, _ASKED if queries else _DATA)

    # 1. each query within its own group
    deal = _Deal.of({int(g): asked[g] for g in live}, {int(g): rows[g] for g in live}, dict.fromkeys(map(int, live), dim))
    at_home = lambda m, g: ((i, np.flatnonzero(g == i)) for i in live)
    home = durable(_ranked(deal.solve(dealt(deal, at_home, False), dealt(deal, at_home, True), k, dim), k).drop("rank"), "knn-home")

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            g = _nearest(_matrix(b.column(1), dim), centre)[0] if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(g.astype(np.int32))], names=["query_id", "g"])

    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select("query_id", "low")
    ids = vectors.where(F.col("vec_id") % every == 0).mapInArrow(place_queries, "query_id long, g int")
    reached = ids.join(kth, "query_id", "left").groupBy("g").agg(F.min("low").alias("low"), F.count_if(F.col("low").isNull()).alias("open")).collect()
    floor = np.full(p, -np.inf)
    for r in reached:
        if not r["open"]:
            floor[r["g"]] = r["low"]

    # 2. vectors of other groups that may reach a group's score
    cross, length = centre @ centre.T, _norm(centre)

    def may_reach(m: np.ndarray, home_of: np.ndarray) -> np.ndarray:
        """Vectors by groups with queries: whether the bound reaches the group's score. For q = c_i + s and v = c_j + t:

        <q,v> <= <c_i,v> + |s||v|;  <q,v> <= max<q,c_j> + |q||t|;  <q,v> <= <c_i,v> + max<q,c_j> - <c_i,c_j> + |s||t|.
        """
        size, t = _norm(m), _norm(m - centre[home_of])
        near = m @ centre[live].T
        seen = most[live][:, home_of].T
        bound = np.minimum(near + radius[live] * size[:, None], seen + reach[live] * t[:, None])
        bound = np.minimum(bound, near + seen - cross[live][:, home_of].T + radius[live] * t[:, None])
        slack = 1e-9 * (1 + (reach[live] + length[live] + radius[live]) * (size + length[home_of] + t)[:, None])
        return ~(bound + slack < floor[live])  # what can't be told stays

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(live), np.int64)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), dim)
                g = _nearest(m, centre)[0]
                total += (may_reach(m, g) & (g[:, None] != live)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total)], names=["g", "n"])

    copies = {r["g"]: r["n"] for r in vectors.mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    total = shape["rows"]
    wide = np.array([g for g in live if copies[g] > MOST_OF_IT * (total - rows[g]) and copies[g]], np.int64)
    if report is not None:
        report[dim] = {"groups": len(live), "together": len(wide), "copied": sum(copies.values()) / max(1, sum(total - rows[g] for g in live))}
    if len(wide) == 1:
        wide = wide[:0]
    others = [g for g in live if g not in set(wide) and copies[g]]
    if not len(wide) and not others:
        return home
    together = p  # the number of the group that shares a copy
    counts = {int(g): copies[g] for g in others} | ({together: total} if len(wide) else {})
    asks = {int(g): asked[g] for g in others} | ({together: sum(asked[g] for g in wide)} if len(wide) else {})
    deal2 = _Deal.of(asks, counts, dict.fromkeys(counts, dim))

    def abroad(m: np.ndarray, g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        near = may_reach(m, g)
        at = {int(x): n for n, x in enumerate(live)}
        for i in others:
            yield i, np.flatnonzero(near[:, at[i]] & (g != i))
        if len(wide):  # solved anew for all of its groups
            yield together, np.flatnonzero(np.isin(g, wide) | near[:, [at[int(i)] for i in wide]].any(1))

    def asking(m: np.ndarray, g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in others:
            yield i, np.flatnonzero(g == i)
        if len(wide):
            yield together, np.flatnonzero(np.isin(g, wide))

    second = deal2.solve(dealt(deal2, abroad, False), dealt(deal2, asking, True), k, dim)
    return home.where(~F.col("g").isin([int(g) for g in wide])).unionByName(second) if len(wide) else home.unionByName(second)

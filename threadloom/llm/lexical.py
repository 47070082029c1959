"""Ranked lexical search: compressed postings in shards, a heap merge a document at a time, a global merge of the shards' best.

An index has two tables. ``postings``: a row a shard and term, with the number of its documents and their ordinals in the shard (in
ascending doc_id order, as gaps) and frequencies, as variable-length integers. ``shards``: a row a shard, with its documents' ids and
lengths. Shards are cut from what a task reads, so building moves no text; they are bounded by bytes of text.

A search takes the items in blocks of bounded size. It sums the terms' document frequencies over the shards, and merges
each shard's postings for each item: cursors lie in a heap by document, the least is scored in whole, and the best stay in a bounded
heap by (score, doc_id). Once that is full, terms whose greatest contributions together can't lift a document above its last score
don't enter the heap of cursors; they are looked up for the documents that the others name. Nothing that could rank is skipped.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text as T
from ._spark import durable, scratch

#: Text of a shard, in bytes (or one longer text).
SHARD_BYTES = 8 << 20
#: Distinct terms of the items of one block, each with its item: what is broadcast at a time.
BLOCK_TERMS = 200_000
#: Tasks of one block at most; beyond that a task solves several shards.
MOST_TASKS = 100_000
#: Lists that an item's results from the shards are first merged in.
SPREAD = 64

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each term of the texts in order, and the distinct terms."""
    offsets, buf = T.as_bytes(column)
    low = T.lower_ascii(buf)
    start, end, row = T.runs(_IS_TERM[low], offsets)
    if not len(start):
        return row, row, pa.array([], pa.large_binary())
    numbers, distinct = T.codes(low, start, end)
    return row, numbers, distinct


def pack_ints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as groups of seven bits, low ones first, and where each begins (and the end)."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], np.uint8)
    live, j = np.arange(len(v)), 0
    while len(live):
        more = size[live] > j + 1
        out[begin[live] + j] = ((v[live] >> np.uint64(7 * j)) & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))
        live, j = live[more], j + 1
    return out, begin


def unpack_ints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first) if len(last) else np.zeros(0, np.int64)


def _shard(rows: pa.Table, shard: int) -> tuple[pa.RecordBatch, ...]:
    """The rows of both tables for some documents."""
    rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
    row, numbers, distinct = _terms(rows["text"])
    n = len(rows)
    lengths = np.bincount(row, minlength=n)
    key, tf = np.unique(numbers * n + row, return_counts=True) if len(row) else (row, row)
    term, doc = key // max(n, 1), key % max(n, 1)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else term
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    data, begin = pack_ints(np.column_stack([gap, tf]).ravel())
    cut = begin[2 * np.append(first, len(term))]
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
    df = np.diff(np.append(first, len(term)))
    names = distinct.take(pa.array(term[first])).cast(pa.binary()).cast(pa.string())
    ids = rows["doc_id"].drop_null().to_numpy()
    one = lambda v: pa.array([v], pa.int64())
    held = (one(shard), one(int((lengths > 0).sum())), one(int(lengths.sum())), pa.array([ids.astype("<i8").tobytes()]), pa.array([lengths.astype("<i8").tobytes()]))
    entries = (pa.array(np.full(len(first), shard)), names, pa.array(df.astype(np.int64)), blobs.cast(pa.binary()))
    return (
        pa.record_batch([*entries, *(pa.nulls(len(first), c.type) for c in held[1:])], names=_COLUMNS),
        pa.record_batch([held[0], *(pa.nulls(1, c.type) for c in entries[1:]), *held[1:]], names=_COLUMNS),
    )


_COLUMNS = ["shard", "term", "df", "postings", "n_docs", "n_terms", "ids", "lengths"]
_SCHEMA = "shard long, term string, df long, postings binary, n_docs long, n_terms long, ids binary, lengths binary"


@dataclass
class Index:
    """The tables at ``path``, in so many shards; ``n_docs`` documents hold a term, ``n_terms`` with repeats."""

    spark: SparkSession
    path: str
    n_docs: int
    n_terms: int
    n_shards: int

    def part(self, kind: str) -> DataFrame:
        read = self.spark.read.schema(_SCHEMA).parquet(self.path)
        if kind == "postings":
            return read.where(F.col("term").isNotNull()).select("shard", "term", "df", "postings")
        return read.where(F.col("ids").isNotNull()).select("shard", "n_docs", "n_terms", "ids", "lengths")


def build(df: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row. Null texts and texts without terms have no posting; rows that repeat an id are documents each; a null id is the last."""
    spark = df.sparkSession
    path = path or scratch(spark, "lexical")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            offsets, _ = T.as_bytes(batch.column(1))
            for lo, hi in T.chunks(offsets):
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                if size >= shard_bytes:
                    yield from _shard(pa.Table.from_batches(held), shard)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield from _shard(pa.Table.from_batches(held), shard)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _SCHEMA)
    rows.write.parquet(path)
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written."""
    total = Index(spark, path, 0, 0, 0).part("shards").agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    return Index(spark, path, total[0] or 0, total[1] or 0, total[2])


def terms_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of the items' texts; rows of one id are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = T.as_bytes(batch.column(1))
            for lo, hi in T.chunks(offsets):
                row, numbers, distinct = _terms(batch.column(1).slice(lo, hi - lo))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.record_batch([ids, distinct.take(pa.array(numbers)).cast(pa.binary()).cast(pa.string())], names=["item", "term"])

    items = df.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "item long, term string")
    return items.groupBy("item", "term").agg(F.count("*").alias("times"))


def merge(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` documents of the greatest sums above 0 as (score, document), equal ones by document.

    Each list has ascending documents, what it adds to each, and the most that it adds.
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    below = [0]
    for _, _, most in lists:
        below.append(below[-1] + most)  # below[i]: the most that the lists before i add together
    at = [0] * len(lists)
    best: list[tuple[int, int]] = []  # (score, -document)
    bar, first = 0, 0
    heap = [(docs[0], i) for i, (docs, _, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            docs, adds, _ = lists[i]
            p = at[i]
            score += adds[p]
            at[i] = p = p + 1
            if p < len(docs):
                heapq.heapreplace(heap, (docs[p], i))
            else:
                heapq.heappop(heap)
        for i in range(first - 1, -1, -1):  # lists that left the heap
            if score + below[i + 1] <= bar:
                break
            docs, adds, _ = lists[i]
            at[i] = p = bisect_left(docs, doc, at[i])
            if p < len(docs) and docs[p] == doc:
                score += adds[p]
        if score > bar:  # a later document of an equal score comes after those held
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > bar:
                bar = best[0][0]
                if first < len(lists) and below[first + 1] <= bar:
                    while first < len(lists) and below[first + 1] <= bar:
                        first += 1
                    heap = [x for x in heap if x[1] >= first]
                    heapq.heapify(heap)
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _searcher(items: list[tuple[int | None, list[tuple[str, int]]]], weights: dict[str, int], n_docs: int, n_terms: int, k: int):
    """Solves one shard for all items of a block."""

    def solve(postings: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int | None, int | None, int]] = []
        if len(postings) and len(shard):
            ids = np.frombuffer(shard["ids"][0].as_py(), "<i8")
            lengths = np.frombuffer(shard["lengths"][0].as_py(), "<i8")
            wide = int(lengths.max(initial=0)) * 25 * n_docs >= 1 << 62
            m = 75 + (np.array([25 * int(x) * n_docs // n_terms for x in lengths]) if wide else 25 * lengths * n_docs // n_terms)
            held = {}
            for term, data in zip(postings["term"].to_pylist(), postings["postings"], strict=True):
                pairs = unpack_ints(data.as_py()).reshape(-1, 2)
                docs = np.cumsum(pairs[:, 0])
                adds = weights[term] * _impacts(pairs[:, 1], m[docs])
                held[term] = (docs.tolist(), adds, adds.tolist(), int(adds.max()))
            for item, terms in items:
                lists = []
                for term, times in terms:
                    if term in held:
                        docs, adds, plain, most = held[term]
                        lists.append((docs, plain if times == 1 else (adds * times).tolist(), most * times))
                out += [(item, int(ids[doc]) if doc < len(ids) else None, score) for score, doc in merge(lists, k)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return solve


def _best(df: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its ``k`` highest-scoring documents with a score above 0: item, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. Equal scores rank by ascending
    doc_id, a null one last; rows that repeat a doc_id rank each. Rows of one item id are one item with the terms of all; a null id is an
    item, too. Items without terms, or whose terms no document holds, give no row, and so does an empty table on either side.
    """
    spark = index.spark
    asked = durable(terms_of(items, id_col, text_col), "items")
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        # a block's terms are bounded by block_terms (or one longer item), so they may go to the driver and to all executors
        df = index.part("postings").join(F.broadcast(mine.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {r.term: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in df.collect()}
        block: dict[int | None, list[tuple[str, int]]] = {}
        for r in mine.collect():
            if weights.get(r.term, 0) > 0:
                block.setdefault(r.item, []).append((r.term, r.times))
        told = spark.sparkContext.broadcast((list(block.items()), weights))
        part = _search_block(index, mine, told, k)
        if blocks > 1:
            part = durable(part, "found")
            told.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(index: Index, asked: DataFrame, told, k: int) -> DataFrame:
    n_docs, n_terms = index.n_docs, index.n_terms

    def solve(key: tuple[pa.Scalar, ...], postings: pa.Table, shard: pa.Table) -> pa.Table:
        return _searcher(*told.value, n_docs, n_terms, k)(postings, shard)

    # by a fixed number of partitions: a shard's work is more than its bytes, by which Spark would join small ones
    parts = max(1, min(MOST_TASKS, index.n_shards))
    wanted = index.part("postings").join(F.broadcast(asked.select("term").distinct()), "term").select("shard", "term", "postings").repartition(parts, "shard")
    shards = index.part("shards").repartition(parts, "shard")
    each = wanted.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(solve, "item long, doc_id long, score long")
    # an item's rows from all shards meet in several lists first
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD))
    return _best(_best(each.withColumn("part", part), k, "part").drop("rank", "part"), k).select("item", "rank", "doc_id", "score")

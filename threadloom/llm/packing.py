"""Best-fit packing of token sequences: large items matched in pairs, smaller ones best-fit into the gaps.

Pieces of equal length are interchangeable, so the plan is made on the histogram of lengths (at most
``capacity`` counters) and says which ranks of a length go to which sequences. Pieces find their place by
their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from ._spark import durable, text_bytes

#: Text of one ranking block, in bytes: bounds the rows that a window sorts.
BLOCK_BYTES = 16 << 20


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, offset): piece ``first rank + i`` goes to bin ``first bin + i``.

    Items above a third of the capacity come at most two to a bin: each largest one takes the largest partner
    that fits. Smaller items, longest first, go to the fullest bins that still have room, new bins where none has.
    Bins of one history are kept as one range, so the work depends on the capacity, not on the pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of bins (first, how many)
    bins = 0

    def put(n: int, first: int, many: int, offset: int) -> None:
        runs.append((n, used[n], many, first, offset))
        used[n] += many
        left[n] -= many

    def room(n: int, first: int, many: int) -> None:
        if n:
            gaps.setdefault(n, []).append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in (m for m in large if m <= min(n, capacity - n)):
            if not left[n]:
                break
            many = left[n] // 2 if m == n else min(left[n], left[m])
            if many:
                put(n, bins, many, 0)
                put(m, bins, many, n)
                room(capacity - n - m, bins, many)
                bins += many
        if many := left[n]:
            put(n, bins, many, 0)
            room(capacity - n, bins, many)
            bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            fit = min((g for g in gaps if g >= n), default=0)
            if not fit:
                many = -(-left[n] // (capacity // n))
                room(capacity, bins, many)
                bins += many
                continue
            first, have = gaps[fit].pop()
            if not gaps[fit]:
                del gaps[fit]
            many = min(have, left[n])
            if have > many:
                room(fit, first + many, have - many)
            put(n, first, many, capacity - fit)
            room(fit - n, first, many)
    return runs


def pieces_of(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts longer than ``capacity`` in pieces of that length."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, all_ids in tokens.encode_batches(batches, tokenizer, end_id):
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(all_ids):
                for p, s in enumerate(range(0, len(ids), capacity)):
                    own = ids[s : s + capacity]
                    row.append(r), piece.append(p), start.append(s), length.append(len(own)), crc.append(tokens.crc32(own))
            yield pa.record_batch(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed as rows of their own;
    an empty table gives no row; further columns are not carried along.
    """
    spark = df.sparkSession
    blocks = max(1, -(-text_bytes(df, text_col) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int")
    pieces = durable(pieces_of(df, tokenizer, end_id, capacity, id_col, text_col).withColumn("block", block), "pieces")
    per = pieces.groupBy("length", "block").count()
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan_bins(histogram, capacity)
    table = (np.array(runs, np.int64) if runs else np.zeros((0, 5), np.int64))
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    held = spark.sparkContext.broadcast(table)  # grows with the capacity, not with the pieces

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(inside) - 1).join(base, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        key = t[:, 0] * (1 << 44) + t[:, 1]
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = np.searchsorted(key, n * (1 << 44) + rank, "right") - 1
            yield pa.record_batch(
                [*b.columns[:5], pa.array(t[run, 3] + rank - t[run, 1]), pa.array(t[run, 4])], names=[*b.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

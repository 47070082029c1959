"""Token-id output: ORC stripes of run-length encoded ids with row indexes and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from ._spark import text_bytes

#: Text of one output file, in bytes, and the most files: their bounds and totals go through one task. At 100 TB a file is 1 GB.
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
STRIPE_BYTES = 8 << 20
ROW_INDEX_STRIDE = 1000
_SCHEMA = "doc_id long, ids array<int>, n long, part int, row long"


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES
) -> None:
    """Write (doc_id, ids, n, part, row) in ascending id order as ORC files: ``n`` counts the ids, ``part`` the files, ``row`` a file's rows.

    Files hold consecutive ranges of ids, sorted; readers take stripes in parallel and skip stripes and row
    groups by the ids' minimum, maximum and Bloom filter. A null or empty text has the end id alone; a null id
    sorts first; repeated ids keep a row each, ordered by a hash of the text, and where there are very many of one id they fill
    several files. An empty table writes no row. Long texts are one row, whatever their length.
    """
    spark = df.sparkSession
    files = max(1, min(MOST_FILES, -(-text_bytes(df, text_col) // file_bytes)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(files, "doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, row = TaskContext.get().partitionId(), 0
        for part, ids in tokens.encode_batches(batches, tokenizer, end_id):
            n = len(ids)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            size = np.fromiter(map(len, ids), np.int64, n)
            off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            numbers = (pa.array(size), pa.array(np.full(n, file, np.int32)), pa.array(np.arange(row, row + n)))
            row += n
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(off, flat), *numbers], names=["doc_id", "ids", "n", "part", "row"])

    placed.mapInArrow(encode, _SCHEMA).write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": STRIPE_BYTES,
            "orc.create.index": "true",
            "orc.row.index.stride": ROW_INDEX_STRIDE,
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) as written; filters on doc_id reach the files' indexes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Per row of the files, in their order: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Sums run per file by the row's number, then over the files' totals (one row per file, from the counts alone).
    """
    read = spark.read.schema(_SCHEMA).orc(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            crc = [tokens.crc32(flat[lo:hi]) for lo, hi in zip(off[:-1], off[1:], strict=True)]
            made = [pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *made], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    rows = read.select("doc_id", "part", "row", "ids").mapInArrow(digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    totals = read.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "part").select(
        "doc_id",
        (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens",
        "ids_crc32",
    )

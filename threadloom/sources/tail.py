"""Transcripts that grow: only the bytes added since the last look are read, in whole lines, by ranges of bytes.

The state is a table, (path, mtime_ms, size, offset, mark): how far each file was read, and a checksum of the bytes before that place, by which a
file that was replaced by another is told from one that grew. Nothing of it goes through the driver. Ranges are read where Spark runs their
rows, through the file systems that Arrow knows (local and mounted folders, hdfs, s3, gs); long ranges are split.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a range that one row reads; and those before an offset that its checksum covers.
CHUNK, MARKED = 32 << 20, 64
STATE = "path string, mtime_ms long, size long, offset long, mark long"
_BATCH = 4 << 20


def _open(path: str) -> pa.NativeFile:
    from pyarrow import fs

    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^/+", "/", rest))
    authority, _, inner = rest.removeprefix("//").partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_file(f"{root.rstrip('/')}/{inner}")


def _mark(f: pa.NativeFile, offset: int) -> int:
    begin = max(0, offset - MARKED)
    return zlib.crc32(f.read_at(offset - begin, begin))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, offset) to (path, now): the checksum before the offset; none if the file is gone or shorter."""
    for b in batches:
        now = []
        for path, offset in zip(b["path"].to_pylist(), b["offset"].to_pylist(), strict=True):
            try:
                with _open(path) as f:
                    now.append(_mark(f, offset) if f.size() >= offset else None)
            except FileNotFoundError:
                now.append(None)
        yield pa.record_batch({"path": b["path"], "now": pa.array(now, pa.int64())})


def _lines_of(path: str, start: int, stop: int, size: int, base: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines that begin in [start, stop), looking at no byte from ``size`` on; ``base``: where the file's range begins."""
    with _open(path) as f:
        f.seek(max(base, start - 1))
        reader, at = io.BufferedReader(f, 1 << 16), max(base, start - 1)
        if start > base:  # a line begins at start only if one ends right before it
            at += len(reader.readline(size - at))
        while at < min(stop, size):
            line = reader.readline(size - at)
            if not line.endswith(b"\n"):
                return  # what has no line feed yet waits
            yield at, line
            at += len(line)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, stop, size, base) to (path, offset, value, next)."""
    for b in batches:
        for row in b.to_pylist():
            found, held = [], 0
            try:
                for at, line in _lines_of(row["path"], row["start"], row["stop"], row["size"], row["base"]):
                    found.append((row["path"], at, line[:-1].decode("utf-8", "replace"), at + len(line)))
                    held += len(line)
                    if held >= _BATCH:
                        yield _batch(found)
                        found, held = [], 0
            except FileNotFoundError:
                pass  # gone since it was listed
            yield _batch(found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, offset, value, after = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch({"path": pa.array(path, pa.string()), "offset": pa.array(offset, pa.int64()), "value": pa.array(value, pa.string()), "next": pa.array(after, pa.int64())})


def to_read(listing: DataFrame, state: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, start, stop, size, base): the ranges of bytes that are new in the listed files (path, mtime_ms, size), at most ``chunk`` long.

    A file whose time and size are those of the state isn't opened; one that shrank, or that holds other bytes before its offset than it did, is
    read from its beginning. A null offset counts as 0.
    """
    known = state.select("path", F.col("mtime_ms").alias("_mtime"), F.col("size").alias("_size"), F.coalesce("offset", F.lit(0)).alias("offset"), "mark")
    own = listing.select("path", "mtime_ms", "size").join(known, "path", "left")
    changed = own.where(~(F.col("mtime_ms").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))))
    seen = changed.where(F.col("offset") > 0).where(F.col("size") >= F.col("_size"))
    now = seen.select("path", "offset").mapInArrow(_marks, "path string, now long")
    held = changed.join(now, "path", "left").select("path", "size", F.when(F.col("now") == F.col("mark"), F.col("offset")).otherwise(F.lit(0)).alias("base"))
    ahead = held.where(F.col("size") > F.col("base"))
    start = F.explode(F.sequence(F.col("base"), F.col("size") - 1, F.lit(chunk).cast("long")))
    return ahead.select("path", start.alias("start"), "size", "base").select("path", "start", F.least(F.col("start") + chunk, F.col("size")).alias("stop"), "size", "base")


def read_new(ranges: DataFrame) -> DataFrame:
    """(path, offset, value, next) of the whole lines in the ranges of ``to_read``; blank lines too, so that their bytes count as read."""
    tasks = max(1, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_ranges, "path string, offset long, value string, next long")


def state_after(listing: DataFrame, state: DataFrame, ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """The state once ``lines`` are taken over. Files that are listed no more are forgotten. ``ranges`` and ``lines`` should be tables by then."""
    far = lines.groupBy("path").agg(F.max("next").alias("_next"))
    began = ranges.groupBy("path").agg(F.max("base").alias("_base"))
    old = state.select("path", F.col("offset").alias("_offset"))
    at = listing.select("path", "mtime_ms", "size").join(far, "path", "left").join(began, "path", "left").join(old, "path", "left")
    # no line, but a range: the offset is where the range began; no range: nothing was added, or the file lost what came after the offset
    at = at.select("path", "mtime_ms", "size", F.coalesce("_next", "_base", F.least("_offset", "size"), F.lit(0)).cast("long").alias("offset"))
    marked = at.select("path", "offset").mapInArrow(_marks, "path string, now long").withColumnRenamed("now", "mark")
    return at.join(marked, "path").select("path", "mtime_ms", "size", "offset", "mark")

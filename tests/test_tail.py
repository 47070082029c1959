"""Files that grow, shrink and are replaced, read by ranges of bytes."""

import os

import pytest

from threadloom.plans import storage
from threadloom.sources import tail, transcripts


class Reader:
    """Looks again and again, with the state in tables."""

    def __init__(self, spark, root):
        self.spark, self.root, self.state = spark, str(root), spark.createDataFrame([], tail.STATE)

    def look(self, chunk=tail.CHUNK):
        listing = storage.written(transcripts.list_files(self.spark, self.root, "claude"), "listing")
        ranges = storage.written(tail.to_read(listing, self.state, chunk), "ranges")
        lines = storage.written(tail.read_new(ranges), "lines")
        self.state = storage.written(tail.state_after(listing, self.state, ranges, lines), "state")
        self.bytes = sum(r.stop - r.start for r in ranges.collect())
        return sorted((os.path.basename(r.path), r.offset, r.value) for r in lines.collect())


def put(path, data, mode="wb"):
    old = path.stat().st_mtime if path.exists() else 0
    with open(path, mode) as f:
        f.write(data)
    os.utime(path, (old + 5, old + 5) if old else None)


def test_only_what_was_added_is_read(spark, tmp_path):
    r, big = Reader(spark, tmp_path), tmp_path / "big.jsonl"
    line = b'{"text": "' + b"x" * 1000 + b'"}\n'
    put(big, line * 20_000)
    assert len(r.look(chunk=1 << 20)) == 20_000 and r.bytes == 20_000 * len(line)
    assert r.look() == [] and r.bytes == 0
    put(big, line, "ab")
    assert [(o, len(v)) for _, o, v in r.look()] == [(20_000 * len(line), len(line) - 1)] and r.bytes == len(line)


def test_halves_wait_and_bytes_count(spark, tmp_path):
    r, f = Reader(spark, tmp_path), tmp_path / "a b.jsonl"
    put(f, "é1\n\nhalf".encode())
    put(tmp_path / "empty.jsonl", b"")
    assert r.look() == [("a b.jsonl", 0, "é1"), ("a b.jsonl", 4, "")]
    put(f, "ß\n".encode(), "ab")
    assert r.look() == [("a b.jsonl", 5, "halfß")]
    put(f, b"no end", "ab")
    assert r.look() == []
    put(f, b"\n", "ab")
    assert r.look() == [("a b.jsonl", 12, "no end")]


def test_shrunk_replaced_and_gone(spark, tmp_path):
    r = Reader(spark, tmp_path)
    for name in ("shrunk", "replaced", "gone", "cut"):
        put(tmp_path / f"{name}.jsonl", b"one\ntwo\n")
    assert len(r.look()) == 8
    put(tmp_path / "shrunk.jsonl", b"new\n")
    put(tmp_path / "replaced.jsonl", b"three\nfour\nfive\n")
    put(tmp_path / "cut.jsonl", b"one\n")
    (tmp_path / "gone.jsonl").unlink()
    want = [("cut.jsonl", 0, "one"), ("replaced.jsonl", 0, "three"), ("replaced.jsonl", 6, "four"), ("replaced.jsonl", 11, "five"), ("shrunk.jsonl", 0, "new")]
    assert r.look() == want and r.look() == []
    assert {os.path.basename(x.path) for x in r.state.collect()} == {"shrunk.jsonl", "replaced.jsonl", "cut.jsonl"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7, 100])
def test_chunks_split_anywhere(spark, tmp_path, chunk):
    put(tmp_path / "f.jsonl", b"a\n\nlong line here\nb\nrest")
    assert [(o, v) for _, o, v in Reader(spark, tmp_path).look(chunk)] == [(0, "a"), (2, ""), (3, "long line here"), (18, "b")]

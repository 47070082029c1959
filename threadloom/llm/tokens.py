"""Token ids of whole texts from a public tokenizer file, by runs between white space.

The tokenizer never joins text across ASCII white space, so a text's ids are those of its runs one after
another. Each distinct run is encoded once by the library and looked up after that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from ._text import as_bytes, chunks

#: Bytes of text encoded at a time, or one text.
SLICE = 2 << 20
#: Distinct runs kept by a worker; beyond it the memory starts anew.
MEMORY = 600_000
#: Words of letters given to the library in one text.
JOINED = 1_000


class _Numbers(dict):
    """Numbers of runs, in the order in which they are first met; ``new`` lists those met since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, run: bytes) -> int:
        self[run] = number = len(self)
        self.new.append(run)
        return number


class Encoder:
    """Ids of texts, equal to ``encode(text, add_special_tokens=False).ids`` of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.seen, self.used = _Numbers(), 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin, self.size = np.zeros(MEMORY, np.int64), np.zeros(MEMORY, np.int64)  # run i has ids[begin[i]:begin[i] + size[i]]

    def _learn(self, runs: list[bytes]) -> None:
        texts = [r.decode() for r in runs]
        # a run of Latin-1 letters is one word to the tokenizer: many go in one call and are told apart by their words' numbers
        plain = [t.isalpha() and max(t) <= "\xff" for t in texts]
        words = [t for t, p in zip(texts, plain, strict=True) if p]
        others = [t for t, p in zip(texts, plain, strict=True) if not p]
        joined = self.tokenizer.encode_batch([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False)
        alone = [e.ids for e in self.tokenizer.encode_batch(others, add_special_tokens=False)]
        sizes = [np.bincount(np.array(e.word_ids), minlength=min(JOINED, len(words) - i * JOINED)) for i, e in enumerate(joined)]
        sizes = np.concatenate([*sizes, np.fromiter(map(len, alone), np.int64, len(alone))]).astype(np.int64)
        at, last = len(self.seen) - len(runs), len(self.seen)
        if last > len(self.size):  # one slice with more distinct runs than the memory holds
            self.begin, self.size = (np.concatenate([x, np.zeros(last + MEMORY - len(x), np.int64)]) for x in (self.begin, self.size))
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        where = at + np.argsort(~np.array(plain), kind="stable")  # the words first, as they were encoded
        self.begin[where] = self.used + np.cumsum(sizes) - sizes
        self.size[where] = sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain(*(e.ids for e in joined), *alone), np.uint32, total)
        self.used += total

    def encode(self, text: bytes | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [separated(t or b"").split() for t in texts]  # at ASCII white space; other white space is left to the tokenizer
        counts = np.fromiter(map(len, split), np.int64, len(split))
        runs = list(chain.from_iterable(split))
        if len(self.seen) > MEMORY:
            self._clear()
        which = np.fromiter(map(self.seen.__getitem__, runs), np.int64, len(runs))
        if self.seen.new:
            try:
                self._learn(self.seen.new)
            except BaseException:
                self._clear()  # numbers without ids must not stay
                raise
            self.seen.new = []
        begin, size = self.begin[which], self.size[which]
        end = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(end[-1])
        at += np.repeat(begin - end[:-1], size)
        bounds = end[np.concatenate([[0], np.cumsum(counts)])]
        ids = self.ids[at]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for c in range(33, 127):
        kind[c] = 1 if chr(c).isalnum() else 2
    kind[ord("'")] = 0  # may begin a contraction
    return kind


_KIND = _classes()
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7, 0x9F, 0xBF]] = False  # two signs, and two letters whose lower case is not 32 up


def separated(text: bytes) -> bytes:
    """``text`` in lower case (of the Latin letters) with a blank between Latin letters or digits and ASCII punctuation (but for apostrophes).

    The tokenizer lower-cases and splits there itself, so the ids stay the same and fewer runs differ. Texts that may
    hold the name of a special token are left alone.
    """
    if b"<|" in text or not text:
        return text
    buf = np.frombuffer(text.lower(), np.uint8)
    kind = _KIND[buf]
    latin = np.flatnonzero((buf[:-1] == 0xC3) & _LATIN[buf[1:]])  # two-byte letters, U+00C0 to U+00FF
    kind[latin], kind[latin + 1] = 1, 1
    buf = buf.copy()
    buf[latin + 1] |= np.uint8(0x20)  # their lower case
    cut = np.flatnonzero((kind[1:] ^ kind[:-1] == 3)) + 1  # 1 beside 2
    out = np.full(len(buf) + len(cut), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[cut + np.arange(len(cut))] = False
    out[keep] = buf
    return out.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of (id, text) in slices of a few MB of text, each text's ids closed by ``end_id``."""
    enc = encoder(path)
    for batch in batches:
        offsets, _ = as_bytes(batch.column(1))
        for lo, hi in chunks(offsets, SLICE):
            part = batch.slice(lo, hi - lo)
            yield part, [np.append(ids, np.uint32(end_id)) for ids in enc.encode_many(part.column(1).cast(pa.binary()).to_pylist())]

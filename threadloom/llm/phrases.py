"""Removal of repeated phrases: recurring windows of words are confirmed, compiled into Aho-Corasick automata and located in all texts.

1. Confirm. Documents are dealt to groups. In the rounds of ``passages``, with words in place of bytes, a group learns which of its
   windows of ``length`` words also start in a document with a smaller id, and a document that holds each: first by anchors (of each
   window the least of the ranks of its ``length // 2``-word parts), then by stretches of windows that share an anchor, then by windows.
   A word's rank is the XXH3 of its bytes, a window's two 64-bit mixes of its parts' ranks.
2. Compile. Runs of recurring windows in a slice of a group (about 1 MB of text) are the phrases of its automata, over the numbers
   of the words in the slice's own vocabulary. A phrase takes ``RUN`` windows at most and an automaton ``PHRASE_WORDS`` words of
   phrases, so its memory is bounded, and so is the number of phrases that end in one place.
3. Stream. Every document of the slice runs through its automata; each occurrence of a phrase whose windows all start in earlier
   documents is marked.

A phrase is sent to no other group: each compiles what occurs in its own texts, so a text meets its own slice's automata only and
the work grows with the text. Within a slice words are compared as bytes, across groups as windows of which 32 bits, the
bucket and 64 bits more agree, so that far less than one wrong window is expected at 100 TB.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from .passages import _Group, _State, answers, in_groups

#: Words of one automaton's phrases, windows of a phrase, and the words that stream through an automaton at a time.
PHRASE_WORDS, RUN, PIECE = 200_000, 64, 1 << 17


class _Words(_Group):
    """Windows of words: the symbols are the words' hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> None:
        self.bytes, self.ids = buf, ids
        self.start, self.end, self.row = T.words(buf, offsets)
        symbols = T.word_hash(buf, self.start, self.end)
        super().__init__(symbols, np.searchsorted(self.row, np.arange(len(offsets))), ids, length)

    def rank_all(self, half: int) -> np.ndarray:
        n = max(0, len(self.buf) - half + 1)
        h = np.full(n, half, np.uint64)
        for j in range(half):
            h = T.mix(h * T.BASE + self.buf[j : j + n])
        return h

    def name_stretches(self, which: np.ndarray) -> np.ndarray:
        """By the first and the last window, which cover the stretch."""
        lo, hi = self.lo[which], self.hi[which]
        h = T.mix(self.rank_pairs(lo)[0] * T.BASE + self.rank_pairs(hi)[1])
        return T.mix(h + (hi - lo).astype(np.uint64))


def _slices(table: pa.Table, length: int):
    offsets, buf = T.as_bytes(table["_text"])
    ids = T.ids_of(table["_id"])
    for lo, hi in T.chunks(offsets):
        own = offsets[lo : hi + 1]
        yield lo, hi, _Words(buf[own[0] : own[-1]], own - own[0], ids[lo:hi], length)


def _recurring(state: _State, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the passages: runs of windows that earlier documents hold, cut to at most ``RUN`` windows.

    All windows of a passage start in documents up to that one, which is earlier than the passage's own.
    """
    g, (at, doc) = state.slices[i], state.windows[i]
    whole, owner = g.windows(state.whole[i])
    low = state.low[state.list.at(*state.keys[i])] if len(at) else np.zeros(0, np.int64)
    hit = low < doc
    at, low = np.concatenate([whole, at[hit]]), np.concatenate([state.whole_low[i][owner], low[hit]])
    if not len(at):
        return at, at, low
    order = np.argsort(at, kind="stable")
    at, low = at[order], low[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(nth % RUN == 0)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + g.length, np.maximum.reduceat(low, first)


def _spelled(numbers: np.ndarray, distinct: int) -> tuple[str, int]:
    """Numbers below ``distinct`` as a string of so many characters each; a place has its own 64 characters, so a node has few children."""
    width = 1
    while 64**width < distinct:
        width += 1
    signs = np.empty((len(numbers), width), "<u4")
    for place in range(width):
        signs[:, place] = (numbers >> (6 * (width - 1 - place)) & 63) + 64 * place
    return signs.tobytes().decode("utf-32-le"), width


def _occurrences(symbols: np.ndarray, distinct: int, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every occurrence in ``symbols`` of the phrases [start, end), and the phrase's ``low``; equal phrases have the least."""
    import ahocorasick

    text, width = _spelled(symbols, distinct)
    known: dict[str, int] = {}
    for a, b, doc in zip((start * width).tolist(), (end * width).tolist(), low.tolist(), strict=True):
        phrase = text[a:b]
        known[phrase] = min(doc, known.get(phrase, doc))
    found = [np.zeros((0, 2), np.int64)]
    phrases, docs = list(known), np.array(list(known.values()), np.int64)
    size = np.array([len(p) // width for p in phrases], np.int64)
    longest = int(size.max(initial=0))
    shard = (np.cumsum(size) - 1) // PHRASE_WORDS
    for k in range(int(shard.max(initial=-1)) + 1):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for j in np.flatnonzero(shard == k).tolist():
            automaton.add_word(phrases[j], j)
        automaton.make_automaton()
        for begin in range(0, len(symbols), PIECE):  # what starts in a piece ends in it or in what is added
            piece = text[begin * width : (begin + PIECE + longest) * width]
            hits = np.fromiter(chain.from_iterable(automaton.iter(piece)), np.int64).reshape(-1, 2)
            hits[:, 0] = (hits[:, 0] + 1) // width + begin
            found.append(hits)
    hits = np.concatenate(found)
    return hits[:, 0] - size[hits[:, 1]], hits[:, 0], docs[hits[:, 1]]


def _gone(state: _State, i: int) -> np.ndarray:
    """Which words of the slice go."""
    g: _Words = state.slices[i]
    start, end, low = _recurring(state, i)
    if not len(start):
        return np.zeros(len(g.buf), bool)
    numbers, distinct = T.codes(g.bytes, g.start, g.end)
    place = np.arange(len(numbers)) + g.row  # a stop after each document
    symbols = np.full(len(numbers) + len(g.ids), len(distinct), np.int64)
    symbols[place] = numbers
    first, last, doc = _occurrences(symbols, len(distinct) + 1, place[start], place[end - 1] + 1, low)
    stops = np.searchsorted(g.offsets[1:] + np.arange(len(g.ids)), first)
    late = doc < g.ids[g.row[first - stops]]
    edge = np.zeros(len(numbers) + 1, np.int32)
    np.add.at(edge, (first - stops)[late], 1)
    np.add.at(edge, (last - stops)[late], -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(g: _Words, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by a blank."""
    size = (g.end - g.start)[keep]
    off = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(off[-1], 32, np.uint8)
    edge = np.zeros(len(g.bytes) + 1, np.int8)
    edge[g.start[keep]] += 1
    edge[g.end[keep]] -= 1
    letters = np.ones(len(out), bool)
    letters[off[1:] - 1] = False
    out[letters] = g.bytes[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    cuts = np.searchsorted(np.flatnonzero(keep), g.offsets)
    return [out[off[a] : max(off[a], off[b] - 1)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def remove_phrases(df: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, with n_words, n_removed, spans (maximal removed runs of words) and kept.

    Words are runs of bytes other than ASCII white space, unchanged; a null text has none. A word goes if a window of ``length``
    consecutive words covers it whose words also start in a document with a smaller id; windows never cross documents, overlap
    counts, and they are judged on the input. ``kept`` are the other words, joined by one blank. Rows with one id are one document
    to each other: their windows don't count against themselves. A null id counts as the greatest. Texts of fewer words and an
    empty table lose nothing. Columns named like a result are replaced by it.
    """
    results = ("n_words", "n_removed", "spans", "kept")
    texts, buckets = in_groups(df, id_col, text_col, [c for c in df.columns if c not in (*results, text_col)])

    def remove(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        n_words, n_removed, spans, kept = [], [], [], []
        state = _State(t, replies, length, buckets, 3, _slices)
        for i, g in enumerate(state.slices):
            gone = _gone(state, i)
            kept += _joined(g, ~gone)
            for lo, hi in zip(g.offsets[:-1], g.offsets[1:], strict=True):
                flips = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0, append=0))
                n_words.append(int(hi - lo)), n_removed.append(int((flips[1::2] - flips[::2]).sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([t["_rest"], *made], names=["_rest", *results])

    kinds = f"_rest {texts.schema['_rest'].dataType.simpleString()}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    told = answers(texts, length, buckets, _slices)
    return texts.groupBy("bid").cogroup(told.groupBy("bid")).applyInArrow(remove, kinds).select("_rest.*", *results)

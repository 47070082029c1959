"""Removal of repeated passages by prefix doubling over the suffixes that can repeat.

A byte goes if it is covered by a ``length``-byte string that also starts in a document with a smaller id.
Ranks are 64-bit fingerprints, so ranking again needs no total order. The rounds:

1. Suffixes are ranked by their first ``length // 2`` bytes. Only anchors are exchanged: of each window of
   ``length`` bytes the position whose rank is least, leftmost if tied, which equal windows choose alike. Ranks
   that stay within one document are unique and leave.
2. The stretch of consecutive windows that share a surviving anchor is ranked as a whole. If an earlier document has the
   same stretch, all of its windows repeat. An anchor whose stretches are all alike is settled.
3. Windows of what is left are ranked by the pair of ranks of their halves, the second at offset ``length // 2``
   (for an odd length the halves are followed by the last byte's rank), which passes the threshold.

Every round sends, from a group of documents to the bucket of the rank, the group's distinct ranks in order, and gets
back a bit for each that says whether it repeats (and the least document, where it does). A group makes the same list
again from its documents, so the bits need no keys. Each group sends a rank once, so a frequent passage costs an entry a
group, not one for each occurrence. Within its bucket a first-round rank is cut to 32 bits, which can only add
candidates. Rounds two and three compare those 32 bits, the bucket and 64 bits more: an anchor's rank and its stretch's name,
or two hashes of the pair of the halves' ranks. Windows that differ are taken for equal only if all of them agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import text_bytes

#: Text bytes of a group of documents, which a task holds at a time (or one longer text).
GROUP_BYTES = 4 << 20
#: Bytes of text for each bucket of ranks: about 600 thousand anchors.
BUCKET_BYTES = 8 << 20
ANCHOR, STRETCH, WINDOW = 0, 1, 2

_ENTRIES = "bucket int, bid int, n int, ranks binary, names binary, low binary, more binary"
_REPLIES = "kind int, bucket int, bid int, n int, repeats binary, several binary, low binary"


class _Group:
    """Windows of one slice of a group: rank of each half, stretches and their anchors."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> None:
        half = length // 2
        self.length, self.buf, self.offsets = length, buf, offsets
        n = len(buf)
        self.rank = self.rank_all(half)
        end = np.repeat(offsets[1:], np.diff(offsets))
        at = np.flatnonzero(end - np.arange(n) >= length)  # starts of the windows
        if not len(at):
            z = np.zeros(0, np.int64)
            self.first, self.lo, self.hi, self.doc, self.anchor, self.stretch = z, z, z, z, z.view(np.uint64), z.view(np.uint64)
            return
        packed = (self.rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.rank), dtype=np.uint64)
        least = _sliding_min(packed, length - half + 1)[at]
        where = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
        self.first = np.flatnonzero(new)  # of each stretch, in at
        self.lo = at[self.first]
        self.hi = at[np.append(self.first[1:], len(where)) - 1]
        self.doc = ids[np.searchsorted(offsets, self.lo, "right") - 1]
        self.anchor = self.rank[where[self.first]]

    def rank_all(self, half: int) -> np.ndarray:
        self.prefix = T.prefix_hash(self.buf)
        return T.window_hash(self.prefix, half)

    def name_stretches(self, which: np.ndarray) -> np.ndarray:
        return T.slice_hash(self.prefix, self.lo[which], self.hi[which] + self.length)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of the stretches, and to which of them each belongs."""
        size = self.hi[which] - self.lo[which] + 1
        owner = np.repeat(np.arange(len(which)), size)
        return self.lo[which][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size), owner

    def rank_pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the ranks of both halves (and the last byte of an odd length), one to order by and one to tell apart."""
        half = self.length // 2
        one, two = self.rank[at], self.rank[at + half]
        if self.length % 2:
            two = T.mix(two * T.BASE + self.buf[at + self.length - 1].astype(np.uint64))
        return T.mix(one * T.BASE + two), T.mix(T.mix(two) * T.BASE + one)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _slices(table: pa.Table, length: int):
    """The group's documents in slices that bound the vectors in memory."""
    offsets, buf = T.as_bytes(table["_text"])
    ids = T.ids_of(table["_id"])
    for lo, hi in T.chunks(offsets):
        own = offsets[lo : hi + 1]
        yield lo, hi, _Group(buf[own[0] : own[-1]], own - own[0], ids[lo:hi], length)


def _bucket_of(rank: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the rank."""
    return ((rank >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class _List:
    """A group's distinct keys in order: ranks, names within a rank (or none), least document, whether it stands more than once."""

    rank: np.ndarray
    name: np.ndarray | None
    low: np.ndarray | None
    more: np.ndarray

    def at(self, rank: np.ndarray, name: np.ndarray | None = None) -> np.ndarray:
        """Where keys of this list stand in it."""
        if self.name is None:
            return np.searchsorted(self.rank, rank)
        lo = np.searchsorted(self.rank, rank)
        hi = np.searchsorted(self.rank, rank, "right")
        while (hi - lo > 1).any():  # names ascend within a rank
            mid = (lo + hi) // 2
            up = (self.name[np.minimum(mid, len(self.name) - 1)] <= name) & (hi - lo > 1)
            lo, hi = np.where(up, mid, lo), np.where(up | (hi - lo <= 1), hi, mid)
        return lo


def _distinct(rank: np.ndarray, name: np.ndarray | None = None, doc: np.ndarray | None = None) -> _List:
    order = np.argsort(rank, kind="stable") if name is None else np.lexsort((name, rank))
    rank = rank[order]
    new = np.ones(len(rank), bool)
    new[1:] = rank[1:] != rank[:-1]
    if name is not None:
        name = name[order]
        new[1:] |= name[1:] != name[:-1]
    first = np.flatnonzero(new)
    if doc is None:
        low, more = None, np.diff(np.append(first, len(rank))) > 1
    else:
        doc = doc[order]
        low = np.minimum.reduceat(doc, first) if len(first) else doc
        more = (np.maximum.reduceat(doc, first) if len(first) else doc) > low
    return _List(rank[first], None if name is None else name[first], low, more)


def _send(own: _List, bid: int, buckets: int) -> pa.Table:
    bucket = _bucket_of(own.rank, buckets)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=False):  # without keys there is no cut
        # the bucket's share of the upper half is known where the rank goes: what is left is spread over 32 bits
        rank = (own.rank[lo:hi] * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
        name, low = (b"" if x is None else x[lo:hi].tobytes() for x in (own.name, own.low))
        rows.append((int(bucket[lo]), bid, int(hi - lo), rank.tobytes(), name, low, np.packbits(own.more[lo:hi]).tobytes()))
    return _table(rows, "bucket", "bid", "n", "ranks", "names", "low", "more")


def _table(rows: list[tuple], *names: str) -> pa.Table:
    kinds = dict.fromkeys(("kind", "bucket", "bid", "n"), pa.int32())
    return pa.table({n: pa.array([r[i] for r in rows], kinds.get(n, pa.binary())) for i, n in enumerate(names)})


def _bits(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p, n in zip(packed, sizes, strict=True)]).astype(bool)


def _repeats(kind: int):
    """Answers of one bucket: which keys repeat, which ranks have several names, and the least documents of the former."""

    def answer(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        column = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()])
        rank = column("ranks", np.uint32)
        more = _bits(table["more"].to_pylist(), sizes)
        name = column("names", np.uint64) if kind != ANCHOR else None
        order = np.argsort(rank, kind="stable") if name is None else np.lexsort((name, rank))
        sorted_rank = rank[order]
        new_rank = np.ones(len(rank), bool)
        new_rank[1:] = sorted_rank[1:] != sorted_rank[:-1]
        new = new_rank.copy()
        if name is not None:
            new[1:] |= name[order][1:] != name[order][:-1]
        first = np.flatnonzero(new)
        spread = lambda x: np.repeat(x, np.diff(np.append(first, len(rank))))
        repeats, several, least = np.empty(len(rank), bool), np.zeros(len(rank), bool), None
        many = np.diff(np.append(first, len(rank))) > 1
        repeats[order] = spread(many | np.logical_or.reduceat(more[order], first))
        if kind != ANCHOR:
            least = np.empty(len(rank), np.int64)
            least[order] = spread(np.minimum.reduceat(column("low", np.int64)[order], first))
        if kind == STRETCH:
            group = np.cumsum(new_rank) - 1
            names = np.bincount(group, new)
            several[order] = names[group] > 1
        rows, at = [], 0
        for bucket, bid, n in zip(table["bucket"].to_pylist(), table["bid"].to_pylist(), sizes, strict=True):
            own = slice(at, at + n)
            at += n
            if repeats[own].any() or several[own].any():
                low = b"" if least is None else least[own][repeats[own]].tobytes()
                rows.append((kind, bucket, bid, n, np.packbits(repeats[own]).tobytes(), np.packbits(several[own]).tobytes() if kind == STRETCH else b"", low))
        return _table(rows, "kind", "bucket", "bid", "n", "repeats", "several", "low")

    return answer


def _received(table: pa.Table, kind: int, own: _List, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key of the list: whether it repeats, whether its rank has several names, and the least document (or the greatest number)."""
    n = len(own.rank)
    repeats, several, low = np.zeros(n, bool), np.zeros(n, bool), np.full(n, np.iinfo(np.int64).max)
    begin = np.searchsorted(_bucket_of(own.rank, buckets), np.arange(buckets))
    t = table.filter(pc.equal(table["kind"], kind)).to_pydict()
    for bucket, size, r, s, least in zip(t["bucket"], t["n"], t["repeats"], t["several"], t["low"], strict=True):
        at = slice(begin[bucket], begin[bucket] + size)
        repeats[at] = np.unpackbits(np.frombuffer(r, np.uint8), count=size)
        if s:
            several[at] = np.unpackbits(np.frombuffer(s, np.uint8), count=size)
        if least:
            low[np.flatnonzero(repeats[at]) + begin[bucket]] = np.frombuffer(least, np.int64)
    return repeats, several, low


class _State:
    """A group's windows after as many rounds as there are answers."""

    def __init__(self, table: pa.Table, replies: pa.Table | None, length: int, buckets: int, rounds: int, slices=_slices) -> None:
        self.slices = [g for _, _, g in slices(table, length)]
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        anchor = join([g.anchor for g in self.slices], np.uint64)
        self.list = _distinct(anchor)
        if not rounds:
            return
        repeats, _, _ = _received(replies, ANCHOR, self.list, buckets)
        self.open = [np.flatnonzero(repeats[self.list.at(g.anchor)]) for g in self.slices]  # stretches whose anchor repeats
        names = [g.name_stretches(o) for g, o in zip(self.slices, self.open, strict=True)]
        ranks = [g.anchor[o] for g, o in zip(self.slices, self.open, strict=True)]
        docs = [g.doc[o] for g, o in zip(self.slices, self.open, strict=True)]
        self.list = _distinct(join(ranks, np.uint64), join(names, np.uint64), join(docs, np.int64))
        if rounds == 1:
            return
        _, several, low = _received(replies, STRETCH, self.list, buckets)
        self.whole, self.whole_low, unsettled = [], [], []
        for o, r, n, d in zip(self.open, ranks, names, docs, strict=True):
            at = self.list.at(r, n)
            earlier = low[at] < d
            self.whole.append(o[earlier])  # an earlier document has the same stretch
            self.whole_low.append(low[at][earlier])
            unsettled.append(o[several[at] & ~earlier])
        self.windows, self.keys = [], []
        for g, which in zip(self.slices, unsettled, strict=True):
            at, owner = g.windows(which)
            self.windows.append((at, g.doc[which][owner]))
            self.keys.append(g.rank_pairs(at))
        one, two = (join([k[i] for k in self.keys], np.uint64) for i in (0, 1))
        self.list = _distinct(one, two, join([doc for _, doc in self.windows], np.int64))
        if rounds == 2:
            return
        _, _, self.low = _received(replies, WINDOW, self.list, buckets)

    def gone(self, i: int, length: int) -> np.ndarray:
        """Which bytes of the slice go."""
        g, whole, (at, doc) = self.slices[i], self.whole[i], self.windows[i]
        hit = at[self.low[self.list.at(*self.keys[i])] < doc] if len(at) else at
        edge = np.zeros(len(g.buf) + 1, np.int32)
        for start, end in ((g.lo[whole], g.hi[whole] + length), (hit, hit + length)):
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1]) > 0


def _whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, and the other bytes of the UTF-8 characters it touches."""
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(gone, first), np.diff(np.append(first, len(buf))))


def in_groups(df: DataFrame, id_col: str, text_col: str, rest: list[str]) -> tuple[DataFrame, int]:
    """(bid, _id, _text, _rest): documents dealt to groups, and the number of buckets for their keys."""
    size = text_bytes(df, text_col)
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))
    texts = df.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).cast("int").alias("bid"),
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).alias("_text"),
        F.struct(*(F.col(c) for c in rest)).alias("_rest"),
    )
    return texts, buckets


def answers(texts: DataFrame, length: int, buckets: int, slices=_slices) -> DataFrame:
    """What each group learns of its keys in the three rounds; ``slices`` makes the windows of a group's texts."""

    def sender(rounds: int):
        def first(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            return _send(_State(t, None, length, buckets, 0, slices).list, key[0].as_py(), buckets)

        def later(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
            return _send(_State(t, replies, length, buckets, rounds, slices).list, key[0].as_py(), buckets)

        return later if rounds else first

    def over(fn, replies: DataFrame) -> DataFrame:
        return texts.groupBy("bid").cogroup(replies.groupBy("bid")).applyInArrow(fn, _ENTRIES)

    def answered(sent: DataFrame, kind: int) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_repeats(kind), _REPLIES)

    first = answered(texts.groupBy("bid").applyInArrow(sender(0), _ENTRIES), ANCHOR)
    second = first.unionByName(answered(over(sender(1), first), STRETCH))
    return second.unionByName(answered(over(sender(2), second), WINDOW))


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of ``df`` but the text, with n_bytes, n_removed, spans (maximal removed byte runs) and kept.

    ``kept`` are the other bytes, or with ``as_text`` a string, where characters go as a whole if a byte of them goes and
    a null stays null.

    Texts count as UTF-8 bytes, null as empty; matches never cross documents; overlaps count; strings are judged on
    the input. Rows with one id are one document to each other: their strings don't count against themselves. A null
    id counts as the greatest. Texts shorter than ``length`` and an empty table lose nothing. Columns named like a
    result are replaced by it.
    """
    results = ("n_bytes", "n_removed", "spans", "kept")
    texts, buckets = in_groups(df, id_col, text_col, [c for c in df.columns if c not in (*results, text_col)])

    def remove(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        n_bytes, n_removed, spans, kept = [], [], [], []
        state = _State(t, replies, length, buckets, 3)
        for i, g in enumerate(state.slices):
            gone = state.gone(i, length)
            for lo, hi in zip(g.offsets[:-1], g.offsets[1:], strict=True):
                own = gone[lo:hi]
                flips = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                if as_text and len(flips):
                    own = _whole_characters(g.buf[lo:hi], own)
                n_bytes.append(int(hi - lo)), n_removed.append(int((flips[1::2] - flips[::2]).sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)])
                kept.append(g.buf[lo:hi][~own].tobytes() if len(flips) else g.buf[lo:hi].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if as_text:
            kept = [k if sound else None for k, sound in zip(kept, t["_text"].is_valid().to_pylist(), strict=True)]
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string() if as_text else pa.binary())]
        return pa.table([t["_rest"], *made], names=["_rest", *results])

    kinds = f"_rest {texts.schema['_rest'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}"
    done = texts.groupBy("bid").cogroup(answers(texts, length, buckets).groupBy("bid")).applyInArrow(remove, kinds)
    return done.select("_rest.*", *results)

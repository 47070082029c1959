"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set are the 64-bit hashes of its word shingles; its sketch the ``k`` least of them. Documents with
equal sets are one class, whose smallest id stands for it. Inverted lists of the retained values bring classes
together; an estimate from the sketch of the union filters the pairs; the Jaccard index of the full sets confirms them.

Which lists: documents that reach the threshold share at least ``sure_overlap`` of their retained values (but for a
chance below 1e-12 a pair), so with values ordered by how many sketches hold them, rare first, they share one of the
first ``size - sure_overlap + 1``. Only those are listed, and a value of one sketch alone is in no list. Each list has a pivot:
the member with the fewest values of its own. Every document is first compared with the pivot that it meets most often,
which joins most of a group of mutual copies. Lists with one pivot then make one group, so any two members of a list are
in a group together. Where the members of a group are not all joined, those outside its greatest joined part (the
outsiders) are compared with all members, in blocks of bounded size, without a row for a pair: a block tells only links
between documents that are not joined yet, and no more than join them. A member's text goes to one task for each block of
outsiders, so it is copied as often as the outsiders fill blocks, not with the size of the group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import durable
from .components import components

SKETCH = 64
#: Bytes of text and documents of one block; two blocks are compared at a time.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 512


@functools.cache
def sure_overlap(percent: int, k: int, miss: float = 1e-12) -> int:
    """The greatest m such that fewer than m of k draws hit with probability below ``miss``, at ``percent`` a draw."""
    p, total = percent / 100, 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > miss:
            return m
    return k


def prefix_size(n: int, percent: int, k: int) -> int:
    """How many of a sketch's values, rare first, have to be listed."""
    if n * 100 <= percent * k:  # any partner's sketch is its whole set, too
        return n - -(-n * percent // 100) + 1
    return min(n, k) - sure_overlap(percent, k) + 1


def sketches(df: DataFrame, words: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, print, sketch): ``print`` is a 128-bit digest of the whole set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, buf = T.as_bytes(batch.column(1))
            for lo, hi in T.chunks(offsets):
                own = offsets[lo : hi + 1]
                h, at = T.shingles(buf[own[0] : own[-1]], own - own[0], words)
                h = h.view(np.int64)
                sizes, prints, kept = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    u = np.unique(h[a:b])
                    x = T.mix(u.view(np.uint64))
                    sizes.append(len(u))
                    prints.append(int(x.sum()).to_bytes(8, "little") + int(np.bitwise_xor.reduce(x)).to_bytes(8, "little") if len(u) else b"")
                    kept.append(u[:k])
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                off = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                    names=["doc_id", "n_shingles", "print", "sketch"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, print binary, sketch array<long>")


def _alike(pairs: DataFrame, members: DataFrame, percent: int, words: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; the union-sketch estimate goes first."""
    side = members.select("doc_id", "sketch", "n_shingles", "text")
    left = side.select(*(F.col(c).alias(f"a_{c}") for c in side.columns))
    right = side.select(*(F.col(c).alias(f"b_{c}") for c in side.columns))
    light = pairs.join(left.drop("a_text"), F.col("a") == F.col("a_doc_id")).join(right.drop("b_text"), F.col("b") == F.col("b_doc_id"))
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), union))
    whole = F.size(F.array_union("a_sketch", "b_sketch")) < k  # then the sketches are the sets
    enough = F.when(whole, 100 * common >= percent * F.size(F.array_union("a_sketch", "b_sketch"))).otherwise(common >= sure_overlap(percent, k))
    likely = light.where(_sizes_fit(F.col("a_n_shingles"), F.col("b_n_shingles"), percent)).where(enough).select("a", "b")
    texts = likely.join(left.select("a_doc_id", "a_text"), F.col("a") == F.col("a_doc_id")).join(right.select("b_doc_id", "b_text"), F.col("b") == F.col("b_doc_id"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ao, ab), (bo, bb) = T.as_bytes(batch.column(2)), T.as_bytes(batch.column(3))
            for lo, hi in T.chunks(ao + bo):
                sides = []
                for off, buf in ((ao, ab), (bo, bb)):
                    own = off[lo : hi + 1]
                    sides.append(T.shingles(buf[own[0] : own[-1]], own - own[0], words))
                (x, xs), (y, ys) = sides
                keep = []
                for i in range(hi - lo):
                    p, q = np.unique(x[xs[i] : xs[i + 1]]), np.unique(y[ys[i] : ys[i + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both and 100 * both >= percent * (len(p) + len(q) - both):
                        keep.append(lo + i)
                if keep:
                    yield batch.select([0, 1]).take(pa.array(keep))

    return texts.select("a", "b", "a_text", "b_text").mapInArrow(confirm, "a long, b long")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _stars(links: DataFrame) -> DataFrame:
    """Labels after the first comparison: the pivot's pivot, or the pivot. Documents with one label are linked."""
    up = links.select(F.col("b").alias("doc_id"), F.col("a").alias("p"))
    higher = links.select(F.col("b").alias("p"), F.col("a").alias("q"))
    return durable(up.join(higher, "p", "left").select("doc_id", F.coalesce("q", "p").alias("label")), "labels")


def _overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of each of the ``first`` sets (rows) with each set (columns), above the diagonal."""
    n = len(sets)
    out = np.zeros((first, n), np.float32)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")  # owners ascend within a value
    value, owner = value[order], owner[order]
    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    many = np.diff(np.append(begin, len(value)))
    many[owner[begin] >= first] = 0  # held by no row
    for d in range(2, 17):  # few owners: pair by pair
        rows = begin[many == d]
        if len(rows):
            own = owner[rows[:, None] + np.arange(d)]
            for i in range(d):
                live = own[own[:, i] < first]
                for j in range(i + 1, d):
                    np.add.at(out, (live[:, i], live[:, j]), 1)
    dense = np.flatnonzero(many > 16)  # many owners: a product of 0/1 matrices
    for at in range(0, len(dense), 2_048):
        part = dense[at : at + 2_048]
        x = np.zeros((n, len(part)), np.float32)
        index = np.repeat(begin[part], many[part]) + np.arange(many[part].sum()) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
        x[owner[index], np.repeat(np.arange(len(part)), many[part])] = 1
        out += x[:first] @ x.T
    return out


def _joins(ids: np.ndarray, labels: np.ndarray, first: int, texts: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> list[tuple[int, int]]:
    """Links of the ``first`` documents with documents of other labels, as few as connect what is connected here."""
    offsets, buf = texts
    sets = []
    for lo, hi in T.chunks(offsets):
        own = offsets[lo : hi + 1]
        h, at = T.shingles(buf[own[0] : own[-1]], own - own[0], words)
        sets += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    size = np.array([len(x) for x in sets], np.float32)
    both = _overlaps(sets, first)
    linked = (both > 0) & (100 * both >= percent * (size[:first, None] + size[None] - both)) & (labels[:first, None] != labels[None])
    a, b = np.nonzero(np.triu(linked, 1))
    _, one = np.unique(np.stack([np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in one:
        x, y = find(int(labels[a[i]])), find(int(labels[b[i]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a[i]]), int(ids[b[i]])))
    return out


def _in_blocks(named: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within groups (p, doc_id, label) of several labels: outsiders against all members, block against block.

    What is known of a group is written as a table, so that the joins on a pivot are of two plain exchanges, which Spark
    splits where a pivot is hot.
    """
    parts = named.groupBy("p", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("p").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    main = durable(main.select("p", F.col("m.label").alias("main")), "groups-main")
    size = members.select("doc_id", F.octet_length("text").cast("long").alias("size")).hint("merge")
    sides = named.join(main, "p").select("p", "doc_id", "label", (F.col("label") != F.col("main")).alias("out"))
    sides = durable(sides.join(size, "doc_id"), "groups-open")
    blocks = lambda own: F.greatest(F.ceil(F.sum(F.when(own, F.col("size"))) / BLOCK_BYTES), F.ceil(F.count_if(own) / BLOCK_ROWS), F.lit(1)).cast("int")
    counts = durable(sides.groupBy("p").agg(blocks(F.col("out")).alias("no"), blocks(~F.col("out")).alias("ni")), "groups-blocks")
    h = F.xxhash64("doc_id")
    mine = F.when(F.col("out"), F.pmod(h, F.col("no"))).otherwise(F.col("no") + F.pmod(h, F.col("ni"))).cast("int")
    met = F.when(F.col("out"), F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1))
    placed = sides.join(counts, "p").withColumn("_b", mine).withColumn("_x", F.explode(met))
    placed = placed.select("p", F.least("_b", "_x").alias("i"), F.greatest("_b", "_x").alias("j"), "doc_id", "label", (F.col("_b") <= F.col("_x")).alias("row"))
    placed = placed.join(members.select("doc_id", "text").hint("merge"), "doc_id")
    dealt = placed.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by([("row", "descending")])  # the block of outsiders comes first
            first, ids, labels = pc.sum(t["row"]).as_py(), t["doc_id"].to_numpy(), t["label"].to_numpy()
            links = _joins(ids, labels, first, T.as_bytes(t["text"]), words, percent) if first and len(t) > 1 else []
            return pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("p", "i", "j")]
            keys = np.stack(columns, 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi > lo:
                    if held and tuple(keys[lo]) != last:
                        yield solve(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = tuple(keys[lo])
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH
) -> DataFrame:
    """Per row: doc_id, n_shingles (set size), component_id (smallest doc_id reachable), kept, class_id.

    Documents whose shingle sets have a Jaccard index of at least ``percent`` / 100 are linked. Null and empty
    texts and texts without words have an empty set and stay alone. Rows of one id are one node if any of them is
    linked; null ids take no part and keep a null component. ``class_id`` is the smallest id with the same set.
    An empty table gives no row; further columns are not carried along.
    """
    rows = durable(sketches(df, words, k, id_col, text_col), "sketches")
    full = rows.where(F.col("n_shingles") > 0).where(F.col("doc_id").isNotNull())
    # written, so that the joins on the digest of a text with very many copies are of two plain exchanges, which Spark splits
    classes = durable(full.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "classes")
    # of each class the row with the smallest id stands for it; an id that repeats with several texts stands for each
    reps = classes.join(full.select("doc_id", "print", "n_shingles", "sketch"), ["print", "n_shingles"]).where(F.col("doc_id") == F.col("class_id"))
    reps = reps.select("doc_id", "n_shingles", "print", "sketch").dropDuplicates(["doc_id", "print"])

    held = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    heard = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    some = held.join(heard, "value").groupBy("doc_id", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    sizes = [prefix_size(n, percent, k) for n in range(1, k + 2)]
    listed = F.element_at(F.array(*map(F.lit, sizes)), F.least(F.col("n_shingles"), F.lit(k + 1)).cast("int"))
    alone = F.least(F.col("n_shingles"), F.lit(k)).cast("int") - F.size("shared")  # values of no other sketch come first
    first = some.select("doc_id", "n_shingles", F.slice("shared", 1, F.greatest(listed - alone, F.lit(0))).alias("shared"), F.col("shared").alias("all"))
    entry = F.struct((F.least(F.col("n_shingles"), F.lit(k)).cast("int") - F.size("all")).alias("own"), F.col("doc_id"), F.col("n_shingles"))
    lists = durable(first.select("doc_id", "n_shingles", entry.alias("e"), F.explode("shared.value").alias("value")), "lists")
    pivot = lists.groupBy("value").agg(F.min("e").alias("p"), F.count("*").alias("rows")).where("rows > 1")
    met = lists.join(pivot, "value").groupBy(F.col("p.doc_id").alias("p"), F.col("p.n_shingles").alias("pn"), "doc_id", "n_shingles").agg(F.count("*").alias("often"))
    met = durable(met, "groups")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = met.select("doc_id").distinct()
    members = durable(reps.join(wanted, "doc_id").join(texts, "doc_id"), "members")

    near = met.where("p <> doc_id").where(_sizes_fit(F.col("n_shingles"), F.col("pn"), percent))
    best = near.groupBy("doc_id").agg(F.max_by("p", F.struct("often", -F.col("p"))).alias("p"))
    found = durable(_alike(best.select(F.col("p").alias("a"), F.col("doc_id").alias("b")), members, percent, words, k), "links")
    named = met.select("p", "doc_id").join(_stars(found), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    rest = _in_blocks(durable(named, "named"), members, words, percent)
    # rows of one id may be of several classes: those classes are linked by the id
    twins = full.join(classes, ["print", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).where("a <> b")
    links = components(found.unionByName(rest).unionByName(twins))
    out = rows.select("doc_id", "n_shingles", "print").join(classes, ["print", "n_shingles"], "left").join(links.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))

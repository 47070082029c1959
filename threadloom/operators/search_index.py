"""Stored postings for keyword search: read by the terms of a query, not by scanning the messages.

An index is three tables below one folder. ``postings`` holds a row for each term and block of hot messages: how many messages and occurrences,
the greatest score, and the messages with their positions, lengths and what orders and scopes a result; in folders by a hash of the term and
sorted by term and block within. ``vocabulary`` has the terms, in files of ranges; ``totals`` one row. A search reads the
folders of its terms, scores the blocks that can reach its last place, and joins only its top rows with the messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.query_text import And, Not, Phrase, clean, parse, phrases
from threadloom.functions.stem import python_tokens, stem, tokens, word_tokens
from threadloom.operators.messages import hot, in_scope, infer_role, preview
from threadloom.plans.storage import written

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders of the postings. A term is in one of them.
BUCKETS = 64
#: Messages, about, whose terms of one folder are sorted and written by one task.
PER_DEAL = 1 << 17
#: Messages, about, whose postings a task sorts when an index follows a store, and parts that a folder's messages are dealt to, at most.
PER_PART, DEALS = 2048, 16
#: Messages of a block, about.
PER_BLOCK = 64
#: Blocks that are named one by one in a filter, at most; more come by a join.
NAMED = 1000

_ORDER = ["session_id", "message_seq", "project_id", "created_at"]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@lru_cache(maxsize=200_000)
def _bucket_number(term: str, buckets: int) -> int:
    """``_bucket`` of a term, in Python."""
    x = xxhash.xxh64_intdigest(term.encode(), 42)
    return (x - (1 << 64) if x >> 63 else x) % buckets


#: Tokens, about, that are grouped at a time where they stand, and rows of a block and folder that are opened at a time.
PIECE, OPENED = 1 << 20, 256
_CODEC = "zstd"


def _tokens(stems: bool) -> Column:
    return (word_tokens if stems else tokens)("message_text").alias("_tokens")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _packed(messages: DataFrame, stems: bool) -> DataFrame:
    """(message_id, ..., len, terms) of the hot messages, ``terms`` with their places.

    Places are grouped where the message stands: no row for a token, and no shuffle but that of texts that lie in few files.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ends, terms, begins, places = [0], [], [0], []
                for words in batch.column("_tokens").to_pylist():
                    met: dict[str, list[int]] = {}
                    for at, word in enumerate(words):
                        if term := stem(word) if stems else word:  # a stem may be empty, which is no term
                            met.setdefault(term, []).append(at)
                    for term, at in met.items():
                        terms.append(term)
                        places += at
                        begins.append(len(places))
                    ends.append(len(terms))
                struct = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(places, pa.int32()))], ["term", "positions"])
                kept = batch.select(kept_columns)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], [*kept_columns, "terms"])

    kept_columns, spark = ["message_id", *_ORDER, "len"], messages.sparkSession
    own = hot(messages).select("message_id", *_ORDER, "message_text")
    if len(own.inputFiles()) < spark.sparkContext.defaultParallelism:
        own = own.repartition(_tasks(spark))
    rows = own.select("message_id", *_ORDER, _tokens(stems)).select("message_id", *_ORDER, F.size("_tokens").alias("len"), "_tokens")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_tokens")
    return rows.mapInArrow(pack, f"{types}, terms array<struct<term:string,positions:array<int>>>")


def posting_rows(messages: DataFrame, stems: bool) -> DataFrame:
    """(term, message_id, ..., len, positions) of the hot messages, without a row for a token."""
    return _packed(messages, stems).select("*", F.inline("terms")).select("message_id", "term", *_ORDER, "len", "positions")


def dealt_postings(messages: DataFrame, stems: bool) -> DataFrame:
    """``posting_rows`` in as many partitions as their messages need, dealt by term and message: what a piece of the messages has in one travels as one row."""
    parts = min(_tasks(messages.sparkSession), max(1, -(-hot(messages).count() // PER_PART)))
    rows = _block_rows(messages, stems, BUCKETS, DEALS, whole_blocks=False).repartition(parts, "bucket", "block")
    each = _opened(rows, 1.0).select("term", F.explode("messages").alias("m"))
    return each.select("m.message_id", "term", *(f"m.{c}" for c in (*_ORDER, "len", "positions")))


def _begin(changes: np.ndarray) -> np.ndarray:
    """Where runs begin, given whether each but the first differs from the one before."""
    return np.flatnonzero(np.concatenate(([True], changes)))


def _block_rows(messages: DataFrame, stems: bool, buckets: int, blocks: int, whole_blocks: bool = True) -> DataFrame:
    """(block, bucket, messages, terms, n, numbers): what a block of hot messages has in a folder.

    ``terms`` are joined by spaces; ``numbers`` are ``n`` 32-bit integers: messages of each term, their places in ``messages``, the positions
    of each, and the gaps between positions. A block that is met in two pieces has two rows; without ``whole_blocks`` it has one for
    each piece of the messages as they lie, and texts in enough files aren't shuffled.
    """
    meta = ["message_id", *_ORDER, "len"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC)
        for whole in batches:
            ends = np.cumsum(whole.column("len").to_numpy())
            cuts = [0, *_begin(np.diff(ends // PIECE) > 0)[1:].tolist(), whole.num_rows] if whole.num_rows else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield from piece(whole.slice(lo, hi - lo), codec)

    def piece(batch: pa.RecordBatch, codec: pa.Codec) -> Iterator[pa.RecordBatch]:
        size = batch.column("len").to_numpy()
        met = batch.column("_tokens").flatten().dictionary_encode()
        names = [stem(w) if stems else w for w in met.dictionary.to_pylist()]
        terms = sorted(set(names))
        number = {t: i for i, t in enumerate(terms)}
        code = np.array([number[t] for t in names], np.int64)[met.indices.to_numpy()] if names else np.zeros(0, np.int64)
        owner, at = np.repeat(np.arange(len(size)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        if terms and not terms[0]:  # a stem may be empty, which is no term
            owner, at, code = owner[code > 0], at[code > 0], code[code > 0]
        if not len(code):
            return
        names_of, nth = np.unique(batch.column("block").to_numpy(), return_inverse=True)
        folder = np.array([_bucket_number(t, buckets) for t in terms], np.int64)
        key = (nth[owner] * buckets + folder[code]) * len(terms) + code
        order = np.argsort(key, kind="stable")  # within a term by message, within a message by position
        key, owner, at = key[order], owner[order], at[order]
        p = _begin((key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))  # postings by their first place
        gaps = np.diff(at, prepend=0)
        gaps[p] = at[p]
        p_size, p_owner, p_key = np.diff(p, append=len(key)), owner[p], key[p]
        t = _begin(p_key[1:] != p_key[:-1])  # terms of a block by their first posting
        t_docs, t_code, t_group = np.diff(t, append=len(p)), p_key[t] % len(terms), p_key[t] // len(terms)
        g = _begin(t_group[1:] != t_group[:-1])  # rows by their first term
        texts, counts, blobs, members, ends = [], [], [], [], [0]
        for a, b in zip(g, np.append(g[1:], len(t)), strict=True):
            pa_, pb = t[a], t[b] if b < len(t) else len(p)
            xa, xb = p[pa_], p[pb] if pb < len(p) else len(key)
            own, places = np.unique(p_owner[pa_:pb], return_inverse=True)
            numbers = np.concatenate((t_docs[a:b], places, p_size[pa_:pb], gaps[xa:xb])).astype(np.int32)
            texts.append(" ".join([terms[i] for i in t_code[a:b]]))
            counts.append(len(numbers))
            blobs.append(codec.compress(numbers.tobytes(), asbytes=True))
            members.append(own)
            ends.append(ends[-1] + len(own))
        taken = batch.select(meta).take(pa.array(np.concatenate(members)))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(taken.columns, meta))
        row = [pa.array(names_of[t_group[g] // buckets]), pa.array(t_group[g] % buckets, pa.int32()), listed, pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["block", "bucket", "messages", "terms", "n", "numbers"])

    block, spark = F.pmod(F.xxhash64("message_id"), F.lit(blocks)).alias("block"), messages.sparkSession
    own = hot(messages).select(block, "message_id", *_ORDER, "message_text")
    if whole_blocks:
        own = own.repartition(_tasks(spark), "block").sortWithinPartitions("block")  # few pieces of a block
    elif len(own.inputFiles()) < spark.sparkContext.defaultParallelism:
        own = own.repartition(_tasks(spark))
    rows = own.select("block", "message_id", *_ORDER, _tokens(stems)).select("block", "message_id", *_ORDER, F.size("_tokens").alias("len"), "_tokens")
    each = ",".join(f"{n}:{rows.schema[n].dataType.simpleString()}" for n in meta)
    return rows.mapInArrow(pack, f"block long, bucket int, messages array<struct<{each}>>, terms string, n int, numbers binary")


def _opened(rows: DataFrame, mean: float) -> DataFrame:
    """(term, block, bucket, doc, cnt, top, messages) of ``_block_rows``: a row for each term and block, with messages and their positions."""
    kept = [f.name for f in rows.schema["messages"].dataType.elementType]

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC)
        for whole in batches:
            for batch in (whole.slice(i, OPENED) for i in range(0, whole.num_rows, OPENED)):
                terms, docs, owners, sizes, gaps, base = [], [], [], [], [], 0
                lengths = batch.column("messages").value_lengths().to_numpy()
                listed = [x.split(" ") for x in batch.column("terms").to_pylist()]
                for own, n, blob, length in zip(listed, batch.column("n").to_pylist(), batch.column("numbers").to_pylist(), lengths, strict=True):
                    x = np.frombuffer(codec.decompress(blob, 4 * n, asbytes=True), np.int32)
                    a = len(own)
                    b = a + int(x[:a].sum())
                    terms += own
                    docs.append(x[:a])
                    owners.append(x[a:b] + base)
                    sizes.append(x[b : 2 * b - a])
                    gaps.append(x[2 * b - a :])
                    base += int(length)
                docs, owners, sizes, gaps = (np.concatenate(x).astype(np.int64) for x in (docs, owners, sizes, gaps))
                begin, first = np.cumsum(sizes) - sizes, np.cumsum(docs) - docs
                places = np.cumsum(gaps)
                places -= np.repeat(places[begin] - gaps[begin], sizes)
                met = batch.column("messages").flatten().take(pa.array(owners))
                length = K1 * (1 - B + B * met.field("len").to_numpy() / (mean or 1.0))
                top = np.maximum.reduceat(sizes * (K1 + 1) / (sizes + length), first)
                positions = pa.ListArray.from_arrays(pa.array(np.append(begin, len(places)), pa.int32()), pa.array(places, pa.int32()))
                entries = pa.StructArray.from_arrays([*(met.field(c) for c in kept), positions], [*kept, "positions"])
                entries = pa.ListArray.from_arrays(pa.array(np.append(first, len(sizes)), pa.int32()), entries)
                of_row = np.repeat(np.arange(batch.num_rows), [len(x) for x in listed])
                block, bucket = (batch.column(c).take(pa.array(of_row)) for c in ("block", "bucket"))
                row = [pa.array(terms, pa.string()), block, bucket, pa.array(docs), pa.array(np.add.reduceat(sizes, first)), pa.array(top), entries]
                yield pa.RecordBatch.from_arrays(row, ["term", "block", "bucket", "doc", "cnt", "top", "messages"])

    each = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema["messages"].dataType.elementType)
    return rows.mapInArrow(open_, f"term string, block long, bucket int, doc long, cnt long, top double, messages array<struct<{each},positions:array<int>>>")


class Index:
    """Postings of the hot messages, of stems or of whole tokens."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        t = spark.read.parquet(f"{self.path}/totals").first()  # one row
        self.stems, self.buckets, self.messages, self.mean = t["stems"], t["buckets"], t["messages"], t["mean"]
        self.blocks = max(1, -(-self.messages // t["per_block"]))
        self._counts: dict[str, int] = {}  # messages with each term that was asked for; the tables don't change
        self._opened: dict[str, DataFrame] = {}  # nor do their files, so they are listed once

    @classmethod
    def build(cls, messages: DataFrame, path: str, stems: bool = True, buckets: int = BUCKETS, per_block: int = PER_BLOCK) -> Index:
        """Write the index of ``messages`` below ``path`` (an empty folder)."""
        spark, path = messages.sparkSession, path.rstrip("/")
        length = F.size((word_tokens if stems else tokens)("message_text"))
        totals = hot(messages).agg(F.count("*").alias("messages"), F.coalesce(F.avg(length), F.lit(0.0)).alias("mean"))
        kept = (F.lit(x).alias(n) for n, x in (("stems", stems), ("buckets", buckets), ("per_block", per_block)))
        totals.select("messages", "mean", *kept).write.mode("overwrite").parquet(f"{path}/totals")
        index = cls(spark, path)
        # a frequent term is dealt to several files of its folder, more of them the more messages there are; what a block has in a
        # folder travels as one row. Within a file a term's rows stand together, block by block
        deals = F.lit(max(4, -(-index.messages // PER_DEAL)))
        rows = _block_rows(messages, stems, buckets, index.blocks).repartition(_tasks(spark), F.col("bucket"), F.pmod("block", deals))
        stored = _opened(rows, index.mean).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").option("compression", "zstd")
        stored.partitionBy("bucket").option("parquet.page.row.count.limit", 1024).option("parquet.dictionary.page.size", 4 << 20).parquet(f"{path}/postings")
        counted = index._tops().groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt"))
        counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
        return index

    def _length(self) -> Column:
        """What a message's length takes from its score."""
        return K1 * (1 - B + B * F.col("len") / F.lit(self.mean or 1.0))

    def _stored(self) -> DataFrame:
        each = "message_id:string,session_id:string,message_seq:bigint,project_id:string,created_at:bigint,len:int,positions:array<int>"
        return self._open("postings", f"term string, block long, doc long, cnt long, top double, messages array<struct<{each}>>, bucket int")

    def _tops(self) -> DataFrame:
        """What is known of each term in each block; of a block in two pieces twice."""
        return self._stored().select("term", "block", "bucket", "doc", "cnt", "top")

    def _open(self, name: str, schema: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self._opened[name]

    def postings(self) -> DataFrame:
        each = self._stored().select("term", "block", "bucket", F.explode("messages").alias("m"))
        return each.select("term", "m.message_id", *(f"m.{c}" for c in (*_ORDER, "len", "positions")), "block", "bucket")

    def differences(self, messages: DataFrame) -> DataFrame:
        """(term, message_id, state) of postings that the messages don't have (stale) or the index lacks (missing); none if it is intact."""
        key = ["term", "message_id", "positions"]
        touched = written(self._touched(messages), "touched")
        of = lambda df: df.join(touched, "message_id", "left_semi")
        stored, fresh = of(self.postings()).select(*key), posting_rows(of(messages), self.stems).select(*key)
        stale = stored.exceptAll(fresh).withColumn("state", F.lit("stale"))
        return stale.unionByName(fresh.exceptAll(stored).withColumn("state", F.lit("missing"))).drop("positions")

    def _touched(self, messages: DataFrame) -> DataFrame:
        """(message_id) whose postings differ: by their number and the sum of their hashes, so that only those are compared one by one."""
        halves = lambda h: (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))
        sums = lambda n, high, low: (F.sum(n).alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low"))
        stored = self.postings().select("message_id", F.xxhash64("term", "positions").alias("h"))
        stored = stored.groupBy("message_id").agg(*sums(F.lit(1), *halves(F.col("h"))))
        marks = F.transform("terms", lambda x: F.xxhash64(x["term"], x["positions"]))
        whole = lambda half: F.aggregate("marks", F.lit(0).cast("long"), lambda a, h: a + half(h))
        fresh = _packed(messages, self.stems).select("message_id", marks.alias("marks"))
        fresh = fresh.select("message_id", F.size("marks").alias("k"), whole(lambda h: halves(h)[0]).alias("a"), whole(lambda h: halves(h)[1]).alias("b")).where("k > 0")
        fresh = fresh.groupBy("message_id").agg(*sums("k", "a", "b"))
        same = fresh.select("message_id", F.struct("n", "high", "low").alias("made"))
        both = stored.select("message_id", F.struct("n", "high", "low").alias("held")).join(same, "message_id", "full")
        return both.where(~F.col("held").eqNullSafe(F.col("made"))).select("message_id")

    def vocabulary(self) -> DataFrame:
        """(term, doc, cnt): messages that hold the term, and occurrences."""
        return self._open("vocabulary", "term string, doc long, cnt long")

    def normal(self, text: str) -> list[str]:
        """The terms of a text as they stand in the index."""
        return [t for t in map(stem, python_tokens(text, marks=True)) if t] if self.stems else python_tokens(text)

    def _of(self, plan: object) -> DataFrame:
        """Postings of the plan's terms: folders by name, terms by the files' statistics."""
        wanted = phrases(plan)
        whole = sorted({t for p in wanted for t in (p.tokens[:-1] if p.prefix else p.tokens)})
        begins = sorted({p.tokens[-1] for p in wanted if p.prefix})
        fits = self._named(whole)
        if begins:
            starts = reduce(lambda a, b: a | b, (F.startswith("term", F.lit(t)) for t in begins))
            # which folders hold terms that begin so: the vocabulary's files are ranges of terms, and there are no more folders than buckets
            held = self.vocabulary().where(starts).select(_bucket(F.col("term"), self.buckets).alias("bucket")).distinct().collect()
            fits = fits | (starts & F.col("bucket").isin([r["bucket"] for r in held]))
        return self.postings().where(fits)

    def _named(self, terms: list[str]) -> Column:
        """Rows of the terms. The folder is worked out as when writing, by constants that Spark folds before it lists folders."""
        each = (F.col("term").eqNullSafe(t) & (F.col("bucket") == _bucket(F.lit(t), self.buckets)) for t in terms)
        return reduce(lambda a, b: a | b, each, F.lit(False))

    def bounds(self, plan: object) -> tuple[DataFrame, list[int]] | None:
        """((block, bound) of the blocks that may hold a hit, messages with each distinct phrase): no message scores above its block's bound.

        Only for plans of single whole terms, whose counts the vocabulary has; others have no bounds.
        """
        each = list(dict.fromkeys(phrases(plan)))
        if any(len(p.tokens) != 1 or p.prefix for p in each):
            return None
        terms = [p.tokens[0] for p in each]
        if unknown := [t for t in terms if t not in self._counts]:
            doc = {r["term"]: r["doc"] for r in self.vocabulary().where(F.col("term").isin(unknown)).collect()}  # as many rows as terms
            self._counts |= {t: doc.get(t, 0) for t in unknown}
        counts = [self._counts[t] for t in terms]
        tops = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("top"))), F.lit(0.0)) * _idf(self.messages, F.lit(n)) for t, n in zip(terms, counts, strict=True)]
        met = self._tops().where(self._named(terms)).groupBy("block").agg(*(x.alias(f"_t{i}") for i, x in enumerate(tops)))
        bound = _bound(plan, {p: F.col(f"_t{i}") for i, p in enumerate(each)})
        return met.select("block", bound.alias("bound")).where("bound > 0"), counts

    def candidates(self, plan: object, limit: int, project: str | None = None, session: str | None = None, exclude: str | None = None) -> tuple[DataFrame, list[int] | None]:
        """(postings that have to be scored for the best ``limit`` hits, counts for ``match``).

        The blocks of the greatest bounds are scored first; then every block whose bound reaches the score of their last place.
        """
        rows, bounds = self._of(plan), self.bounds(plan) if limit > 0 else None
        if bounds is None:
            return rows, None
        bound, counts = bounds
        best = bound.orderBy(F.desc("bound"), "block").limit(NAMED + 1).collect()
        ahead = [r["block"] for r in best[: min(2 * limit, NAMED)]]
        hits = in_scope(self.match(plan, rows.where(F.col("block").isin(ahead)), counts), project, session, exclude)
        last = hits.select("rank").orderBy("rank").limit(limit).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
        # results are ordered by rounded scores, so what comes within the rounding counts, too
        least = -last["rank"] - 1e-6 if last["n"] == limit else 0.0
        if len(best) > NAMED and best[-1]["bound"] >= least:
            return rows.join(bound.where(F.col("bound") >= least), "block", "left_semi"), counts
        return rows.where(F.col("block").isin([r["block"] for r in best if r["bound"] >= least])), counts

    def match(self, plan: object | None, rows: DataFrame | None = None, counts: list[int] | None = None) -> DataFrame:
        """(message_id, session_id, message_seq, project_id, created_at, rank) of the messages that fit; rank is negative BM25.

        Counts, lengths and frequencies are those of the whole index, whatever filters follow. A null plan fits nothing.
        With ``rows`` only these postings are scored; ``counts`` then tells the messages with each distinct phrase.
        """
        if plan is None:
            return self.postings().select("message_id", *_ORDER, F.lit(0.0).alias("rank")).limit(0)
        each = list(dict.fromkeys(phrases(plan)))
        met = self.places(plan, rows)
        counted = met.select("message_id", *_ORDER, "len", *(F.size(f"_s{i}").alias(f"_f{i}") for i in range(len(each))))
        if counts is None:
            having = counted.agg(*(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(each))))
        else:
            having = self.spark.range(1).select(*(F.lit(n).alias(f"_n{i}") for i, n in enumerate(counts)))
        hits = counted.where(fit(plan, {p: F.col(f"_f{i}") for i, p in enumerate(each)})).crossJoin(F.broadcast(having))  # one row of counts
        length, score = self._length(), F.lit(0.0)
        for p in phrases(plan):
            i = each.index(p)
            score = score + _idf(self.messages, F.col(f"_n{i}")) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + length)
        return hits.select("message_id", *_ORDER, (-score).alias("rank"))

    def places(self, plan: object, rows: DataFrame | None = None) -> DataFrame:
        """(message_id, ..., len, _s0, _s1, ...): the tokens at which each distinct phrase begins, of the messages with a token of the plan."""
        each, slots = list(dict.fromkeys(phrases(plan))), []
        for i, p in enumerate(each):
            for j, t in enumerate(p.tokens):
                fits = F.startswith("term", F.lit(t)) if p.prefix and j == len(p.tokens) - 1 else F.col("term") == t
                slots.append(F.flatten(F.collect_list(F.when(fits, F.col("positions")))).alias(f"_p{i}_{j}"))
        met = (self._of(plan) if rows is None else rows).groupBy("message_id", *_ORDER, "len").agg(*slots)
        return met.select("message_id", *_ORDER, "len", *(_begins(i, p).alias(f"_s{i}") for i, p in enumerate(each)))

    def shares(self, words: list[str]) -> DataFrame:
        """(term, doc, share of the hot messages) for each of the words by its first term in the index, 0 where none holds it."""
        first = {w: min(self.normal(w), default=w.lower()) for w in words}
        total = F.lit(max(1, self.messages))
        listed = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("word"), F.lit(first[w]).alias("term")) for i, w in enumerate(words)))).alias("w")
        asked = self.spark.range(1).select(listed).select("w.*")
        known = self.vocabulary().where(F.col("term").isin(sorted(set(first.values()))))
        return asked.join(known, "term", "left").select("i", F.col("word").alias("term"), F.coalesce("doc", F.lit(0)).alias("doc"), (F.coalesce("doc", F.lit(0)) / total).alias("share"))

    def plan_of(self, query: str, skip_idf: bool = False) -> object | None:
        """Clean up and parse what a user types; the vocabulary tells how frequent its words are."""
        share = None
        if not skip_idf and (words := _words(query)):
            got = {r["term"]: r["share"] for r in self.shares(words).collect()}  # as many rows as words
            share = lambda w: got.get(w.lower(), 0.0)
        return parse(clean(query, share), self.normal)

    def search(
        self, messages: DataFrame, query: str, limit: int = 20, project: str | None = None, session: str | None = None, exclude: str | None = None,
        skip_idf: bool = False, plan: object | None = None,
    ) -> DataFrame:
        """The best hot messages by BM25; filters come after the ranking's statistics. What can't be parsed finds nothing."""
        plan = plan if plan is not None else self.plan_of(query, skip_idf)
        rows, counts = (None, None) if plan is None else self.candidates(plan, limit, project, session, exclude)
        hits = in_scope(self.match(plan, rows, counts), project, session, exclude).withColumn("_r", F.round("rank", 9))
        top = hits.orderBy("_r", "created_at", "message_id").limit(limit).select("message_id", "rank")
        found = messages.join(F.broadcast(top), "message_id")  # at most ``limit`` rows of an id and a number
        return found.select("message_id", "session_id", "message_seq", "project_id", "created_at", infer_role().alias("message_role"), *preview(), "rank")

    def counts(self, plan: object | None, project: str | None = None, exclude: str | None = None) -> DataFrame:
        """Hits of each session, and their total in a row without a session."""
        hits = in_scope(self.match(plan), project, None, exclude)
        return hits.rollup("session_id").agg(F.count("*").alias("hits"))


def _idf(messages: int, n: Column) -> Column:
    idf = F.log((F.lit(messages) - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def _bound(plan: object, top: dict[Phrase, Column]) -> Column:
    """The greatest score that the plan can have, by those of its phrases; 0 where it can't fit."""
    if isinstance(plan, Phrase):
        return top[plan]
    if isinstance(plan, Not):
        return _bound(plan.keep, top)
    parts = [_bound(p, top) for p in plan.parts]
    total = reduce(lambda a, b: a + b, parts)
    return F.when(reduce(lambda a, b: a & b, (p > 0 for p in parts)), total).otherwise(0.0) if isinstance(plan, And) else total


def _words(query: str) -> list[str]:
    """Words whose share may be asked for, in lower case."""
    import re

    return list(dict.fromkeys(w for w in re.sub(r'[*^:{}\[\]()"]', "", re.sub(r"([A-Za-z0-9_])[-_]([A-Za-z0-9_])", r"\1 \2", query)).lower().split()))


def _begins(i: int, p: Phrase) -> Column:
    """Where the phrase stands in the message: positions of its first token that the others follow."""
    shifted = lambda j: F.transform(F.col(f"_p{i}_{j}"), lambda x: x - j)
    return reduce(F.array_intersect, map(shifted, range(1, len(p.tokens))), F.array_distinct(F.col(f"_p{i}_0")))


def fit(plan: object, where: dict[Phrase, Column]) -> Column:
    """Whether a message fits, by the counts of its phrases."""
    if isinstance(plan, Phrase):
        return where[plan] > 0
    if isinstance(plan, Not):
        return fit(plan.keep, where) & ~fit(plan.drop, where)
    parts = [fit(p, where) for p in plan.parts]
    return reduce((lambda a, b: a & b) if isinstance(plan, And) else (lambda a, b: a | b), parts)

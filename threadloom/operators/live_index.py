"""A keyword index that follows the message store: each batch adds a segment in proportion to itself, nothing is rebuilt.

The index is one append-only table with three kinds of rows. ``posting``: a term in a message; the vocabulary counts those that count.
``size``: messages and tokens of a session, whose sums are the totals of the ranking.
``state``: the version of the store that is covered. Sessions that the store replaces, deletes or turns cold are hidden by the
table's own log, which takes their postings and sizes at once; single messages that are updated or dropped are hidden by their
key, and the segment holds their sizes with the sign reversed. Segments merge in tiers. Rows are sorted by kind and term within
a file, so that a term, or the terms of a prefix, are found by the statistics of its pages; a merge puts files together without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.query_text import phrases
from threadloom.functions.stem import tokens, word_tokens
from threadloom.operators.messages import hot
from threadloom.operators.search_index import Index, dealt_postings
from threadloom.operators.versioned import TIER, Versioned

_SCHEMA = (
    "kind string, term string, message_id string, session_id string, message_seq long, project_id string, created_at long, len int, "
    "positions array<int>, doc long, cnt long"
)
_POSTING = ["term", "message_id", "session_id", "message_seq", "project_id", "created_at", "len", "positions"]


class LiveIndex(Index):
    """Postings of the store's hot messages, of stems or of whole tokens; searched like an ``Index``."""

    def __init__(self, spark: SparkSession, path: str, stems: bool = True, tier: int = TIER) -> None:
        self.spark, self.path, self.stems = spark, path.rstrip("/"), stems
        self.table = Versioned(spark, self.path, _SCHEMA, "message_id", parts=("kind",), sort=("kind", "term", "message_id"), followed=False, tier=tier, ranged=False)
        self.refresh()

    def refresh(self) -> None:
        """Totals and the covered version, as of now."""
        sizes = F.col("kind") == "size"
        t = self._of_kind("size", "state").agg(F.sum(F.when(sizes, F.col("doc"))), F.sum(F.when(sizes, F.col("cnt"))), F.max(F.when(~sizes, F.col("doc")))).first()
        self.messages, self.covered = t[0] or 0, t[2] or 0
        self.mean = (t[1] or 0) / self.messages if self.messages else 0.0

    def _of_kind(self, *kinds: str) -> DataFrame:
        return self.table.read().where(F.col("kind").isin(*kinds))

    def postings(self) -> DataFrame:
        return self._of_kind("posting").select(*_POSTING)

    def vocabulary(self) -> DataFrame:
        """(term, doc, cnt): messages that hold the term, and occurrences."""
        return self.postings().groupBy("term").agg(F.count("*").alias("doc"), F.sum(F.size("positions")).alias("cnt"))

    def _of(self, plan: object) -> DataFrame:
        wanted = phrases(plan)
        whole = sorted({t for p in wanted for t in (p.tokens[:-1] if p.prefix else p.tokens)})
        begins = sorted({p.tokens[-1] for p in wanted if p.prefix})
        fits = F.col("term").isin(whole) if whole else F.lit(False)
        return self.postings().where(reduce(lambda a, b: a | b, (F.startswith("term", F.lit(t)) for t in begins), fits))

    def bounds(self, plan: object) -> None:
        """None: lengths are those of now, so no greatest score of a block could be kept."""
        return None

    def _sizes(self, messages: DataFrame, sign: int) -> DataFrame:
        """Rows of kind size for hot messages."""
        length = F.coalesce(F.size((word_tokens if self.stems else tokens)("message_text")), F.lit(0))
        sizes = hot(messages).groupBy("session_id").agg((F.count("*") * sign).alias("doc"), (F.sum(length) * sign).alias("cnt"))
        return sizes.withColumn("kind", F.lit("size"))

    def follow(self, store: Versioned) -> int:
        """Take over what the store has committed since; the version covered. A batch that was lost half-way is taken over by the next call."""
        self.refresh()
        now = store.version()
        if now == self.covered:
            return now
        new, sessions, was = store.changes(self.covered)
        state = self.spark.range(1, numPartitions=1).select(F.lit("state").alias("kind"), F.lit(now).cast("long").alias("doc"))
        rows = [dealt_postings(new, self.stems).withColumn("kind", F.lit("posting")), self._sizes(new, 1), state]
        if was is not None:  # sessions that are hidden take theirs with them
            rows.append(self._sizes(was if sessions is None else was.join(sessions, "session_id", "left_anti"), -1))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        # a row of the index belongs to a message or to none; those of kind size have none and aren't dropped by a key
        self.table.append(every.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in _SCHEMA.split(", "))), replaces=sessions, drops=was)
        self.refresh()
        return now

"""Fusing keyword and vector results: reciprocal ranks, recency, discovery boost, score gap, session rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the fusion rules.
RRF_K, BOOST, FETCH, GAP_FROM, GAP_OVER, PAGE = 60, 1.05, 3, 10, 0.15, 75
DAY_MS = 86_400_000


def recency(created: Column, now: int, decay: float | None) -> Column:
    """1 without decay; falls with the age in days otherwise. ``now`` is given, not read from a clock."""
    if not decay or decay <= 0:
        return F.lit(1.0)
    return 1 / (1 + F.greatest(F.lit(0), F.lit(now) - created) / F.lit(float(DAY_MS)) * decay)


def ranked(hits: DataFrame, path: str, *order: Column | str) -> DataFrame:
    """A list of at most a few times the limit, with its 0-based position."""
    placed = hits.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
    return placed.select("message_id", "session_id", "message_seq", "created_at", "message_preview", "pos", F.lit(path).alias("path"))


def fuse(keyword: DataFrame, semantic: DataFrame, now: int = 0, decay: float | None = None, boost: float = BOOST) -> DataFrame:
    """Union of both lists by message: score, fts_pos, sem_pos, tag and 1-based place.

    Messages of sessions without any keyword hit are boosted. Ties keep the order of the lists.
    """
    both = keyword.unionByName(semantic).withColumn("part", (1 / (F.lit(RRF_K) + F.col("pos"))) * recency(F.col("created_at"), now, decay))
    at = lambda p: F.min(F.when(F.col("path") == p, F.col("pos")))
    part = lambda p: F.coalesce(F.max(F.when(F.col("path") == p, F.col("part"))), F.lit(0.0))
    merged = both.groupBy("message_id", "session_id", "message_seq", "created_at", "message_preview").agg(
        (part("fts") + part("semantic")).alias("score"), at("fts").alias("fts_pos"), at("semantic").alias("sem_pos")
    )
    found = F.max(F.col("fts_pos").isNotNull().cast("int")).over(Window.partitionBy("session_id"))
    scored = merged.withColumn("_found", found).withColumn("score", F.when(F.col("_found") == 1, F.col("score")).otherwise(F.col("score") * boost))
    order = Window.orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("fts_pos"), F.asc_nulls_last("sem_pos"), "message_id")
    tag = F.when(F.col("fts_pos").isNotNull() & F.col("sem_pos").isNotNull(), "FTS5+SEMANTIC").when(F.col("sem_pos").isNotNull(), "SEMANTIC-ONLY").otherwise("FTS5-ONLY")
    return scored.withColumn("place", F.row_number().over(order)).withColumn("tag", tag).drop("_found")


def score_gap(scored: DataFrame) -> DataFrame:
    """Cut after the largest relative drop between neighbours from the eleventh place on, if it exceeds 15%."""
    w = Window.orderBy("place")
    drop = F.when(F.col("score") > 0, (F.col("score") - F.col("_next")) / F.col("score"))
    gaps = scored.withColumn("_next", F.lead("score").over(w)).where((F.col("place") > GAP_FROM) & F.col("_next").isNotNull()).select("place", F.round(drop, 12).alias("drop"))
    cut = gaps.where(F.col("drop") > 0).agg(F.max(F.struct(F.col("drop"), (-F.col("place")).alias("neg"))).alias("g"))
    cut = cut.select(F.when(F.col("g.drop") > GAP_OVER, -F.col("g.neg")).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col("place") <= F.col("_cut"))).drop("_cut")


def sessions(scored: DataFrame, offset: int = 0, page: int | None = PAGE) -> DataFrame:
    """One row per session by its best message: hits, and through which paths any of its messages came."""
    fts, sem = (F.max(F.col(c).isNotNull().cast("int")) for c in ("fts_pos", "sem_pos"))
    s = scored.groupBy("session_id").agg(
        F.min("place").alias("_first"), F.count("*").alias("hits"), fts.alias("_f"), sem.alias("_s"),
        F.min_by(F.struct("message_id", "message_seq", "score", "message_preview", "created_at"), "place").alias("b"),
    )
    tag = F.when((F.col("_f") == 1) & (F.col("_s") == 1), "[FTS5+SEMANTIC]").when(F.col("_s") == 1, "[SEMANTIC-ONLY]").otherwise("[FTS5-ONLY]")
    out = s.select(
        F.row_number().over(Window.orderBy("_first")).alias("rank"), "session_id", "hits", F.col("b.score").alias("score"),
        F.col("b.message_id").alias("best_message_id"), F.col("b.message_seq").alias("best_message_seq"), tag.alias("tag"),
        F.translate(F.substring("b.message_preview", 1, 400), "\n", " ").alias("snippet"),
        F.date_format(F.timestamp_millis("b.created_at"), "yyyy-MM-dd").alias("date"),
    )
    return out if page is None else out.where((F.col("rank") > offset) & (F.col("rank") <= offset + page))

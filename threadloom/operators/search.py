"""The search as a whole: keywords and vectors, fused, within a period, with what can be said when there is nothing to look for."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import vector as V
from threadloom.operators import fusion, semantic
from threadloom.operators.embedding import Embedder, query_vector
from threadloom.operators.search_index import Index


@dataclass(frozen=True)
class Found:
    """Scored messages, whether vectors took part, and the share of vectors that are current."""

    scored: DataFrame
    semantic_available: bool
    coverage: float


def day(text: str, end: bool = False) -> int:
    """Milliseconds of an ISO date or time, in UTC; of a date's last millisecond with ``end``. What is no date is an error."""
    at = datetime.fromisoformat(text)
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return int(at.timestamp() * 1000) + (86_400_000 - 1 if end else 0)


def in_period(scored: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Results of the days asked for, the last one whole; places stay as they were, as the filter follows the ranking."""
    if since:
        scored = scored.where(F.coalesce("created_at", F.lit(0)) >= day(since))
    if until:
        scored = scored.where(F.coalesce("created_at", F.lit(0)) <= day(until, end=True))
    return scored


def search(
    messages: DataFrame, index: Index, vectors: DataFrame, query: str, embedder: Embedder | None = None, limit: int = 20, project: str | None = None,
    session: str | None = None, exclude: str | None = None, now: int = 0, decay: float | None = None, skip_idf: bool = False,
) -> Found:
    """Both searches of thrice the limit, fused. A blank query finds nothing; where no query vector can be made, keywords alone count."""
    spark = messages.sparkSession
    scope = {"project": project, "session": session, "exclude": exclude}
    keyword = index.search(messages, query, limit * fusion.FETCH, skip_idf=skip_idf, **scope)
    words = fusion.ranked(keyword.withColumn("_r", F.round("rank", 9)), "fts", "_r", "created_at", "message_id")
    if not query.strip():
        return Found(fusion.fuse(words.limit(0), words.limit(0)), False, 1.0)
    share = semantic.coverage(messages, vectors).first()["coverage"]
    made = query_vector(query, embedder) if embedder else None
    if made is None:
        return Found(fusion.fuse(words, words.limit(0), now, decay), False, share)
    q = spark.createDataFrame([(made,)], "v array<double>").select(V.q8("v").alias("q"), V.l2_norm("v").alias("q_norm"), V.q8_scale("v").alias("q_scale"))
    near = semantic.search(messages, vectors, q, limit * fusion.FETCH, share < semantic.TOLERANT_BELOW, **scope)
    like = fusion.ranked(near.withColumn("_r", -F.round("similarity", 9)), "semantic", "_r", "created_at", "message_id")
    return Found(fusion.fuse(words, like, now, decay), True, share)


def search_transcript(messages: DataFrame, index: Index, session: str, query: str, limit: int = 20) -> DataFrame:
    """Keyword hits within one session."""
    return index.search(messages, query, limit, session=session)

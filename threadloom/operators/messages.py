"""Listing, reading, searching by pattern and resolving references over the message table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT = "retrieval_class = 'hot'"


def hot(messages: DataFrame) -> DataFrame:
    """What default retrieval sees."""
    return messages.where(HOT)


def in_scope(df: DataFrame, project: str | None = None, session: str | None = None, exclude: str | None = None) -> DataFrame:
    if project is not None:
        df = df.where(F.col("project_id") == project)
    if session is not None:
        df = df.where(F.col("session_id") == session)
    if exclude is not None:
        df = df.where(F.col("session_id") != exclude)
    return df


def infer_role(role: str = "message_role", seq: str = "message_seq") -> Column:
    """The role, or by parity where it is missing."""
    known = F.col(role).isin("user", "assistant")
    return F.when(known, F.col(role)).when(F.col(seq) % 2 == 0, "user").otherwise("assistant")


def preview(text: str = "message_text", size: int = 400) -> tuple[Column, Column]:
    """The first ``size`` characters and whether there are more."""
    return F.substring(text, 1, size).alias("message_preview"), (F.length(text) > size).alias("truncated")


def list_sessions(
    messages: DataFrame, limit: int | None = 50, since: int | None = None, until: int | None = None, project: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Hot sessions, most recently active first. Times filter messages before grouping."""
    m = in_scope(hot(messages), project=project, exclude=exclude)
    if since is not None:
        m = m.where(F.col("created_at") >= since)
    if until is not None:
        m = m.where(F.col("created_at") <= until)
    s = m.groupBy("session_id").agg(
        F.min("created_at").alias("first_activity"), F.max("created_at").alias("last_activity"), F.count("*").alias("message_count")
    )
    s = s.withColumn("title", F.lit(None).cast("string"))
    return s if limit is None else s.orderBy(F.desc("last_activity"), "session_id").limit(limit)


def read_session(messages: DataFrame, session: str, offset: int = 0, limit: int = 10, reverse: bool = False) -> DataFrame:
    """A page of a session with its total and whether more follow. All classes are readable by id."""
    m = in_scope(messages, session=session)
    order = F.desc("message_seq") if reverse else F.asc("message_seq")
    page = m.orderBy(order, "message_id").offset(offset).limit(limit)
    total = m.agg(F.count("*").alias("total_messages"))
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_messages") > offset + limit)


def adjacent(messages: DataFrame, session: str, seq: int, window: int = 1) -> DataFrame:
    return in_scope(messages, session=session).where(F.col("message_seq").between(max(0, seq - window), seq + window))


def turn_context(messages: DataFrame, session: str, message_id: str, context: int = 0) -> DataFrame:
    """The messages around one, ``context`` of them on either side (0 to 5)."""
    at = in_scope(messages, session=session).where(F.col("message_id") == message_id).select(F.col("message_seq").alias("_seq"))
    near = in_scope(messages, session=session).join(F.broadcast(at), F.abs(F.col("message_seq") - F.col("_seq")) <= max(0, min(5, context)))  # one row
    return near.drop("_seq")


def sessions_of(messages: DataFrame, retrieval_class: str = "agent") -> DataFrame:
    """The distinct sessions of a class."""
    return messages.where(F.col("retrieval_class") == retrieval_class).select("session_id").distinct()


def names_of(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name) by which sessions can be called: their ids and their aliases, each once."""
    return ids.select(F.col("session_id").alias("name")).union(aliases.select("alias_id")).distinct()


def read_turn(messages: DataFrame, session: str, message_id: str) -> DataFrame:
    """The user and assistant texts of the turn that a message belongs to."""
    m = in_scope(messages, session=session).select("message_id", "message_seq", "message_text", infer_role().alias("role"))
    target = m.where(F.col("message_id") == message_id).select(F.col("message_seq").alias("seq"), F.col("role").alias("target_role"))
    near = m.join(F.broadcast(target), F.abs(F.col("message_seq") - F.col("seq")) <= 1)
    at = lambda d: F.max(F.when(F.col("message_seq") == F.col("seq") + d, F.col("message_text")))
    user = F.col("target_role") == "user"
    return near.groupBy("seq", "target_role").agg(at(-1).alias("prev"), at(0).alias("own"), at(1).alias("next")).select(
        F.col("seq").alias("message_seq"),
        F.when(user, F.col("own")).otherwise(F.coalesce("prev", F.lit(""))).alias("user_text"),
        F.when(user, F.coalesce("next", F.lit(""))).otherwise(F.col("own")).alias("assistant_text"),
    )


def _pattern(spark, pattern: str) -> str:
    """A Java expression, case-insensitive; an invalid one counts as literal text."""
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return r"(?i)" + re.escape(pattern)
    return "(?i)" + pattern


def grep(
    messages: DataFrame, pattern: str, limit: int = 20, session: str | None = None, project: str | None = None, exclude: str | None = None,
    scan: int | None = None, context: int = 40,
) -> DataFrame:
    """Newest messages that match, with the text around the first match.

    The newest 2000 messages are looked through, 10000 within a session; agent messages only within a session.
    """
    m = messages if session else hot(messages)
    newest = in_scope(m, project, session, exclude).orderBy(F.desc("created_at"), "message_id").limit(scan or (10_000 if session else 2_000))
    p = F.lit(_pattern(messages.sparkSession, pattern))
    found = newest.where(F.regexp_like("message_text", p)).withColumn("_hit", F.regexp_substr("message_text", p))
    found = found.withColumn("_at", F.instr("message_text", F.col("_hit")) - 1)
    start = F.greatest(F.lit(0), F.col("_at") - context)
    end = F.least(F.length("message_text"), F.col("_at") + F.length("_hit") + context)
    text = F.concat(
        F.when(start > 0, "...").otherwise(""), F.substring("message_text", start + 1, end - start), F.when(end < F.length("message_text"), "...").otherwise("")
    )
    return found.orderBy(F.desc("created_at"), "message_id").limit(limit).select(
        "session_id", "message_id", "message_seq", text.alias("match_context"), "created_at", "message_role"
    )


def status(messages: DataFrame) -> DataFrame:
    is_hot = F.col("retrieval_class") == "hot"
    return messages.agg(
        F.coalesce(F.sum(is_hot.cast("long")), F.lit(0)).alias("hot_count"),
        F.coalesce(F.sum((F.col("retrieval_class") == "agent").cast("long")), F.lit(0)).alias("agent_count"),
        F.max(F.when(is_hot, F.col("created_at"))).alias("last_indexed_at"),
        F.count_distinct("session_id").alias("session_count"),
    )


def resolve(ids: DataFrame, aliases: DataFrame, ref: str) -> DataFrame:
    """(session_id, how): the exact id, else the exact alias, else ids and aliases' sessions that start with ``ref``.

    Prefixes are literal. More than one row means that the reference is ambiguous, none that it is unknown.
    """
    named = ids.select("session_id", F.col("session_id").alias("name"), F.lit(0).alias("alias"))
    named = named.unionByName(aliases.select("session_id", F.col("alias_id").alias("name"), F.lit(1).alias("alias")))
    near = named.where(F.col("name").startswith(ref)).withColumn("tier", F.when(F.col("name") == ref, F.col("alias")).otherwise(2))
    best = near.agg(F.min("tier").alias("best"))
    how = F.element_at(F.array(F.lit("id"), F.lit("alias"), F.lit("prefix")), F.col("tier") + 1)
    return near.join(F.broadcast(best), F.col("tier") == F.col("best")).select("session_id", how.alias("how")).distinct()


def status_report(messages: DataFrame, vectors: DataFrame, version: int = 3) -> DataFrame:
    """One row of what the store holds: hot and other messages, the last of any class, what waits for a vector, and the vectors by version."""
    from threadloom.operators.semantic import coverage, gap

    is_hot = F.col("retrieval_class") == "hot"
    counts = messages.agg(F.count_if(is_hot).alias("message_count"), F.count_if(~is_hot).alias("agent_message_count"), F.max("created_at").alias("last_ingest"))
    waiting = gap(messages, vectors, version).select(F.col("total").alias("total_messages"), "gap_count")
    held = coverage(messages, vectors, version).select(F.col("total").alias("vectors"), "current", "stale", "coverage")
    return counts.crossJoin(waiting).crossJoin(held)  # one row each


def within_budget(messages: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """Of each session the first messages whose lengths together stay within ``budget``, but one at least."""
    w = Window.partitionBy("session_id").orderBy("message_seq", "message_id")
    used = F.sum(F.length("message_text") + overhead).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("chars_used", used).withColumn("_n", F.row_number().over(w)).where((F.col("chars_used") <= budget) | (F.col("_n") == 1)).drop("_n")


def centred(messages: DataFrame, session: str, seq: int, budget: int = 20_000, overhead: int = 80, back_share: float = 0.3) -> DataFrame:
    """Messages around ``seq``: 30% of the budget before it and 70% from it on; what one side leaves goes to the other.

    The message itself is always there, however long.
    """
    m = in_scope(messages, session=session).withColumn("_c", F.length("message_text") + overhead)
    back, fwd = int(budget * back_share), budget - int(budget * back_share)
    before = Window.partitionBy("session_id", "_side").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_side", (F.col("message_seq") >= seq).cast("int")).withColumn("_step", F.abs(F.col("message_seq") - seq))
    m = m.withColumn("_sum", F.sum("_c").over(before))
    first = m.agg(
        F.coalesce(F.max(F.when((F.col("_side") == 0) & (F.col("_sum") <= back), F.col("_sum"))), F.lit(0)).alias("_b"),
        F.coalesce(F.max(F.when((F.col("_side") == 1) & ((F.col("_sum") <= fwd) | (F.col("_step") == 0)), F.col("_sum"))), F.lit(0)).alias("_f"),
    )
    m = m.crossJoin(F.broadcast(first)).withColumn("_f_room", F.lit(fwd) + F.greatest(F.lit(0), F.lit(back) - F.col("_b")))
    second = m.agg(F.coalesce(F.max(F.when((F.col("_side") == 1) & ((F.col("_sum") <= F.col("_f_room")) | (F.col("_step") == 0)), F.col("_sum"))), F.lit(0)).alias("_f2"))
    m = m.crossJoin(F.broadcast(second)).withColumn("_b_room", F.lit(back) + F.greatest(F.lit(0), F.lit(fwd) - F.col("_f2")))
    keep = F.when(F.col("_side") == 1, F.col("_sum") <= F.greatest("_f2", F.lit(0))).otherwise(F.col("_sum") <= F.when(F.col("_b_room") > back, F.col("_b_room")).otherwise(F.col("_b")))
    return m.where(keep).drop("_c", "_side", "_step", "_sum", "_b", "_f", "_f_room", "_f2", "_b_room")

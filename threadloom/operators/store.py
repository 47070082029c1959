"""Changes to the store as functions from the current tables and what comes in to the new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.messages import hot


def insert_messages(current: DataFrame, incoming: DataFrame, replace_sessions: DataFrame | None = None) -> DataFrame:
    """First write wins by message_id, after the sessions to replace are taken out; of ids that repeat in ``incoming`` the first by session and place."""
    kept = current if replace_sessions is None else current.join(replace_sessions.select("session_id"), "session_id", "left_anti")
    first = incoming.groupBy("message_id").agg(F.min_by(F.struct(*incoming.columns), F.struct("session_id", "message_seq")).alias("r")).select("r.*")
    new = first.join(kept.select("message_id"), "message_id", "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def upsert_provenance(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vendor, kind and time are overwritten; parent, depth, meta and path keep what was known where nothing new comes."""
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, "session_id", "full_outer")
    over = [F.coalesce(f"i.{x}", f"c.{x}").alias(x) for x in current.columns if x != "session_id"]
    return both.select("session_id", *over)


def reclassify(messages: DataFrame, vectors: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions in ``agents`` become cold and lose their vectors; nothing becomes hot again."""
    marked = messages.join(agents.select("session_id", F.lit(True).alias("_a")).distinct(), "session_id", "left")
    now = marked.withColumn("retrieval_class", F.when(F.col("_a"), "agent").otherwise(F.col("retrieval_class"))).drop("_a").select(*messages.columns)
    return now, vectors.join(hot(now).select("message_id"), "message_id", "left_semi")


def insert_vectors(messages: DataFrame, current: DataFrame, incoming: DataFrame, version: int = 3) -> DataFrame:
    """Vectors of hot messages replace what is there, stamped with the version."""
    new = incoming.join(hot(messages).select("message_id"), "message_id", "left_semi").withColumn("embed_version", F.lit(version))
    return current.join(new.select("message_id"), "message_id", "left_anti").unionByName(new.select(*current.columns))


def delete_session(messages: DataFrame, vectors: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    gone = messages.where(F.col("session_id") == session).select("message_id")
    return messages.where(F.col("session_id") != session), vectors.join(gone, "message_id", "left_anti")


def changed_files(listing: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files that are new or differ in size or whole-millisecond time; a status column tells all apart."""
    w = watermark.select("path", F.col("last_mtime").alias("_m"), F.col("last_size").alias("_s"))
    same = (F.floor("mtime_ms") == F.col("_m")) & (F.col("size") == F.col("_s"))
    state = F.when(F.col("_m").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return listing.join(w, "path", "left").withColumn("state", state).drop("_m", "_s")


def advance_watermark(watermark: DataFrame, done: DataFrame) -> DataFrame:
    """``done``: (path, mtime_ms, size, vendor) of files ingested without error; others keep their mark."""
    new = done.select("path", F.floor("mtime_ms").cast("long").alias("last_mtime"), F.col("size").alias("last_size"), "vendor")
    return watermark.join(new.select("path"), "path", "left_anti").unionByName(new.select(*watermark.columns))


def repair_vectors(vectors: DataFrame) -> DataFrame:
    """No vectors; the next sweep makes them anew."""
    return vectors.limit(0)


def is_leaf(session: str = "session_id"):
    return F.startswith(session, F.lit("agent-"))


def unresolved(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions whose ids are of the second vendor's form, but of which no file tells what they are."""
    shaped = messages.where(F.startswith("message_id", F.lit("codex-jsonl-"))).select("session_id")
    return shaped.distinct().join(known.select("session_id").distinct(), "session_id", "left_anti")


def migrate_classes(messages: DataFrame, vectors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages with classes, vectors of hot ones, provenance of the agents, and a one-row report.

    ``files``: (path, vendor, session_id, meta_parent, is_child) of the known transcripts. Agents are sessions named ``agent-``
    and the second vendor's children. Sessions of that vendor of which no file tells what they are stay as they are and are counted.
    """
    if "retrieval_class" not in messages.columns:
        messages = messages.withColumn("retrieval_class", F.lit("hot"))
    leaves = messages.where(is_leaf()).select("session_id").distinct()
    folder = F.nullif(F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), r"(?i)/([^/]+)/subagents/agent-[^/]+\.jsonl$", 1), F.lit(""))
    claude = files.where("vendor = 'claude'").select(F.regexp_extract("path", r"([^/\\]+?)(?:\.jsonl)?$", 1).alias("session_id"), folder.alias("parent_session_id"), "path").where("parent_session_id is not null")
    children = files.where("vendor = 'codex' and is_child").select("session_id", F.col("meta_parent").alias("parent_session_id"), "path").dropDuplicates(["session_id"])
    own = leaves.join(claude.dropDuplicates(["session_id"]), "session_id", "left").withColumn("vendor", F.lit("claude"))
    agents = own.unionByName(children.withColumn("vendor", F.lit("codex"))).withColumn("kind", F.lit("agent"))
    now, left = reclassify(messages, vectors, agents)
    known = agents.select("session_id").union(files.where("vendor = 'codex' and not is_child").select("session_id")).distinct()
    changed = messages.where("retrieval_class <> 'agent'").join(agents.select("session_id").distinct(), "session_id", "left_semi")
    report = (
        agents.agg(F.count_distinct("session_id").alias("agent_sessions")).crossJoin(changed.agg(F.count("*").alias("agent_messages")))
        .crossJoin(unresolved(messages, known).agg(F.count("*").alias("unresolved")))
        .crossJoin(vectors.join(left.select("message_id"), "message_id", "left_anti").agg(F.count("*").alias("purged_vectors")))
    )  # one row each
    return now, left, agents, report

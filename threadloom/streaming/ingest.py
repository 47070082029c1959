"""Incremental ingest into an append-only store, scans of transcript folders, and event-time windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.live_index import LiveIndex
from threadloom.operators.store import advance_watermark, changed_files
from threadloom.operators.versioned import ConcurrentWrite, Versioned  # noqa: F401
from threadloom.plans.storage import written
from threadloom.sources import codex, transcripts
from threadloom.sources.sessions import classify_all

MESSAGE_SCHEMA = "message_id string, session_id string, message_seq long, message_text string, project_id string, created_at long, message_role string, retrieval_class string"
MARK_SCHEMA = "path string, last_mtime long, last_size long, vendor string"
#: Files that one round of a scan reads; their paths go through the driver.
FILES_A_ROUND = 10_000


def ingest_stream(stream: DataFrame, store: Versioned, checkpoint: str, index: LiveIndex | None = None):
    """Add each micro-batch of message rows to the store, then to the index; first write wins, so a replayed batch adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        store.insert(batch)
        if index is not None:
            index.follow(store)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Scan:
    scanned: int
    unchanged: int
    ingested: int
    failed: int


def session_rows(lines: DataFrame, vendor: str, project: str | None = None) -> DataFrame:
    """Message rows of transcript lines of one vendor, with ``path``."""
    entries = transcripts.claude_entries(lines) if vendor == "claude" else codex.entries(lines).withColumn("parent_tool", F.lit(None).cast("string"))
    rows = transcripts.message_rows(entries, project, keep="path")
    return rows.withColumn("project_id", normal_path(F.col("project_id")))


def normal_path(path):
    """Forward slashes, no slash at the end, drive letters in lower case."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    return F.when(F.regexp_like(p, F.lit("^[A-Z]:")), F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, F.length(p)))).otherwise(p)


def ingest_scan(
    spark: SparkSession, roots: dict[str, str], store: Versioned, marks: Versioned, provenance: Versioned, files_a_round: int = FILES_A_ROUND, force: bool = False,
    index: LiveIndex | None = None, vectors: Versioned | None = None, aliases: Versioned | None = None,
) -> Scan:
    """List the transcripts below ``roots`` (vendor -> folder), ingest those that changed since their mark, advance their marks.

    A file that can't be read keeps its mark and counts as failed. ``force`` ingests all files and replaces their sessions. Where a
    file tells that its session is a sub-agent's, the session's rows from before turn cold, and its vectors and postings go. Marks
    come last: a scan that dies is done again, and ``index`` takes over what the store has and it has not.
    """
    listing = None
    for vendor, root in roots.items():
        one = transcripts.list_files(spark, root, vendor)
        listing = one if listing is None else listing.unionByName(one)
    listing = written(listing, "listing")
    state = written(changed_files(listing, latest_marks(marks)), "changed")
    counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    todo = state if force else state.where("state <> 'unchanged'")
    ingested, wanted = 0, todo.orderBy("path").select("path", "vendor").collect()  # paths; each round reads a bounded number
    for vendor in roots:
        own = [r["path"] for r in wanted if r["vendor"] == vendor]
        for at in range(0, len(own), files_a_round):
            ingested += _ingest_files(spark, vendor, own[at : at + files_a_round], listing, store, marks, provenance, force, index, vectors, aliases)
    return Scan(sum(counts.values()), 0 if force else counts.get("unchanged", 0), ingested, len(wanted) - ingested)


def latest_marks(marks: Versioned) -> DataFrame:
    """The last mark of each path."""
    m = marks.read()
    return m.groupBy("path").agg(F.max_by(F.struct("last_mtime", "last_size", "vendor"), F.struct("last_mtime", "last_size")).alias("m")).select("path", "m.*")


def _ingest_files(
    spark: SparkSession, vendor: str, paths: list[str], listing: DataFrame, store: Versioned, marks: Versioned, provenance: Versioned, force: bool,
    index: LiveIndex | None, vectors: Versioned | None, aliases: Versioned | None,
) -> int:
    lines = written(transcripts.read_lines(spark, paths, tolerant=True), "lines")
    there = lines.select("path").distinct()
    files = transcripts.evidence(there, vendor, lines)
    stored = latest_provenance(provenance).select("transcript_path", "kind", "session_id", "parent_session_id")
    every = written(classify_all(files, stored), "classes")
    classed = every.where("not unresolvable")  # of the others nothing is taken in, and they keep their marks
    rows = session_rows(lines, vendor).join(classed.select("path", F.col("session_id").alias("_s"), "kind"), "path")
    rows = rows.withColumn("session_id", F.col("_s")).withColumn("retrieval_class", F.when(F.col("kind") == "agent", "agent").otherwise("hot"))
    late = classed.where("kind = 'agent'").select("session_id")
    store.insert(rows.drop("path", "_s", "kind"), classed.select("session_id") if force else None, late)
    if vectors is not None:
        vectors.delete(classed.select("session_id") if force else late)
    if index is not None:
        index.follow(store)
    agents = classed.withColumn("vendor", F.lit(vendor)).withColumnRenamed("path", "transcript_path")
    provenance.append(agents.select("session_id", "vendor", "kind", "parent_session_id", "transcript_path"))
    if aliases is not None:
        aliases.append(alias_rows(classed))
    done = listing.join(classed.select("path"), "path", "left_semi")
    none = spark.createDataFrame([], MARK_SCHEMA)
    marks.append(advance_watermark(none, done))
    return done.count()


ALIAS_SCHEMA = "alias_id string, session_id string, source string"


def alias_rows(classed: DataFrame) -> DataFrame:
    """(alias_id, session_id, source) of what ``classify_all`` gives; a blank alias is none."""
    rows = classed.select(F.explode("aliases").alias("alias_id"), "session_id", F.col("evidence").alias("source"))
    return rows.where(F.trim("alias_id") != "")


def latest_aliases(aliases: Versioned) -> DataFrame:
    """The last session that each alias was given."""
    a = aliases.read(versioned=True)
    return a.groupBy("alias_id").agg(F.max(F.struct("_version", "session_id", "source")).alias("a")).select("alias_id", "a.session_id", "a.source")


PROVENANCE_SCHEMA = "session_id string, vendor string, kind string, parent_session_id string, transcript_path string"


def latest_provenance(provenance: Versioned) -> DataFrame:
    """What is known of each session: the last that was told, an agent stays one, and what is known stays where nothing new is told."""
    p = provenance.read(versioned=True)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("_version", c)))[c].alias(c)
    return p.groupBy("session_id").agg(last("vendor"), F.min("kind").alias("kind"), last("parent_session_id"), last("transcript_path"))


def vendor_of(path, codex_home: str | None = None):
    """By the path: below a ``.codex`` folder or the vendor's home it is codex, else claude."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.contains(p, F.lit("/.codex/"))
    if codex_home:
        home = codex_home.replace("\\", "/").removesuffix("/")
        below = below | (p == home) | F.startswith(p, F.lit(f"{home}/"))
    return F.when(below, "codex").otherwise("claude")


def hook_targets(events: DataFrame, codex_home: str | None = None) -> DataFrame:
    """(session_id, path, vendor, hook_session, hook_agent) of stop events (value: JSON); events without a target go.

    The transcript of a sub-agent counts before that of its session.
    """
    j = events.withColumn("j", F.try_parse_json("value")).where(F.col("j").isNotNull())
    get = lambda p: F.nullif(F.try_variant_get("j", p, "string"), F.lit(""))
    agent, own, session = get("$.agent_transcript_path"), get("$.transcript_path"), get("$.session_id")
    name = F.regexp_replace(F.element_at(F.split(F.replace(agent, F.lit("\\"), F.lit("/")), "/"), -1), r"(?i)\.jsonl$", "")
    out = j.select(
        F.when(agent.isNotNull(), F.nullif(name, F.lit(""))).otherwise(F.when(own.isNotNull(), session)).alias("session_id"), F.coalesce(agent, own).alias("path"),
        session.alias("hook_session"), F.when(agent.isNotNull(), F.coalesce(get("$.agent_id"), F.lit(""))).alias("hook_agent"),
    )
    return out.where(F.col("session_id").isNotNull()).withColumn("vendor", vendor_of(F.col("path"), codex_home))


def unindexed(listing: DataFrame, messages: DataFrame) -> DataFrame:
    """Listed transcripts whose session has no message yet."""
    known = messages.select(F.col("session_id").alias("_s")).distinct()
    return listing.withColumn("_s", transcripts.session_of(F.col("path"))).join(known, "_s", "left_anti").withColumnRenamed("_s", "session_id")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of values by event type and window; rows later than ``late`` are dropped once the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity of each user, split where nothing happens for ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there and return it; for tests and backfills."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)

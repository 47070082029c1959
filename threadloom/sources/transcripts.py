"""JSONL transcripts of two vendors: listing, parsing and adapting to message rows.

Vendor "claude" writes one entry a line; vendor "codex" wraps payloads in envelopes. Lines are read as text and parsed
to VARIANT, so a content that is now a string, now an array needs no inferred schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BLOCKS = "array<struct<type:string,text:string,name:string,id:string,input:string,tool_use_id:string>>"

#: What a tool is for, by its name.
TOOL_CATEGORIES = {
    "Read": "file_read", "Write": "file_write", "Edit": "file_edit", "MultiEdit": "file_edit", "Bash": "shell", "Grep": "search", "Glob": "search", "LS": "search",
    "Task": "agent", "Agent": "agent", "TaskOutput": "agent", "TaskStop": "agent", "WebFetch": "browser", "WebSearch": "search", "NotebookEdit": "notebook",
    "TodoWrite": "planning", "EnterPlanMode": "planning", "ExitPlanMode": "planning", "AskUserQuestion": "interaction", "Skill": "interaction",
    "EnterWorktree": "other", "ListMcpResources": "mcp", "ReadMcpResource": "mcp",
}
#: How texts begin that a tool puts in the user's name.
SYSTEM_OPENINGS = (
    "<system-reminder>", "<environment_context>", "<INSTRUCTIONS>", "# AGENTS.md instructions for", "<context>", "<task-notification>", "<command-name>",
    "<local-command-stdout>", "<local-command-caveat>",
)
TOOL_NAMES = {"exec_command": "Bash", "shell_command": "Bash", "write_stdin": "Bash", "view_image": "Read", "update_plan": "TodoWrite"}


def list_files(spark: SparkSession, root: str, vendor: str) -> DataFrame:
    """(path, mtime_ms, size, vendor) of the transcripts below ``root``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    return f.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), F.lit(vendor).alias("vendor"))


def newest_first(files: DataFrame) -> DataFrame:
    """The listing, the newest file first."""
    return files.orderBy(F.desc("mtime_ms"), "path")


def file_of(files: DataFrame, uuid: str) -> DataFrame:
    """The listed files of one session."""
    return files.where(F.lower(session_of(F.col("path"))) == uuid.lower())


def new_lines(whole: DataFrame, state: DataFrame) -> DataFrame:
    """(path, line_no, offset, value, next) of complete lines that ``state`` (path, offset, size) hasn't seen.

    ``whole`` (path, value): files with their text. A file that shrank is read anew; a last line without its line feed waits.
    ``offset`` is where a line begins, ``next`` where the next begins, in bytes; the greatest ``next`` of a file is its new state.
    """
    s = state.select("path", F.col("offset").alias("_from"), F.col("size").alias("_size"))
    f = whole.join(s, "path", "left").withColumn("_from", F.when(F.octet_length("value") >= F.coalesce("_size", F.lit(0)), F.coalesce("_from", F.lit(0))).otherwise(0))
    lines = F.split("value", "\n")
    f = f.select("path", "_from", F.posexplode(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line_no", "raw"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("next", F.sum(F.octet_length("raw") + 1).over(w)).withColumn("offset", F.col("next") - F.octet_length("raw") - 1)
    kept = f.where(F.col("offset") >= F.col("_from")).withColumn("value", F.trim("raw"))
    return kept.where(F.col("value") != "").select("path", "line_no", "offset", "value", "next")


def next_state(state: DataFrame, listing: DataFrame, read: DataFrame) -> DataFrame:
    """(path, mtime_ms, size, offset) after ``new_lines`` gave ``read``: listed files as they are now, up to where they were read.

    Files that are listed no more are forgotten; one of which nothing new could be read keeps its offset, unless it shrank.
    """
    far = read.groupBy("path").agg(F.max("next").alias("_next"))
    old = state.select("path", F.col("offset").alias("_offset"), F.col("size").alias("_size"))
    kept = F.when(F.col("size") >= F.coalesce("_size", F.lit(0)), F.col("_offset"))
    return listing.join(far, "path", "left").join(old, "path", "left").select("path", "mtime_ms", "size", F.coalesce("_next", kept, F.lit(0)).alias("offset"))


def session_of(path: Column) -> Column:
    """The file's base name, or the trailing uuid of a ``rollout-`` file."""
    name = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    uuid = F.regexp_extract(name, r"^rollout-.*?([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1)
    return F.when(uuid != "", uuid).otherwise(name)


def read_lines(spark: SparkSession, paths: str | list[str], tolerant: bool = False) -> DataFrame:
    """(path, line_no, value, offset): non-blank lines in file order; ``offset`` is where a line begins, in bytes.

    Each file is one row of the reader, so that lines keep their order: transcripts are MBs, not GBs. With ``tolerant`` files that
    are gone or can't be read have no lines.
    """
    missing = str(tolerant).lower()
    whole = spark.read.option("wholetext", True).option("ignoreMissingFiles", missing).option("ignoreCorruptFiles", missing).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(paths)
    lines = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0)))
    return at.withColumn("value", F.trim("raw")).where(F.col("value") != "").drop("raw")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``j``; malformed lines go."""
    return lines.withColumn("j", F.try_parse_json("value")).where(F.col("j").isNotNull())


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("j", path, kind)


def millis(ts: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(ts))


def joined_text(content: Column, kind: Column) -> Column:
    """A string trimmed, or the trimmed text blocks joined by a blank line."""
    blocks = F.filter(F.transform(F.filter(F.from_json(content, _BLOCKS), lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.trim(b["text"])), lambda t: t != "")
    return F.when(kind.startswith("ARRAY"), F.array_join(blocks, "\n\n")).otherwise(F.trim(content))


def is_system_context(text: Column) -> Column:
    """Whether a user's first text was put there by a tool."""
    found = F.lit(False)
    for opening in SYSTEM_OPENINGS:
        found = found | F.startswith(text, F.lit(opening))
    return F.coalesce(found, F.lit(False))


def claude_entries(lines: DataFrame) -> DataFrame:
    """Entries: type, uuid, parent, session, time, cwd, role, text, model, whether meta, and whether they belong to a tool's sub-agent.

    Queue operations, untyped lines and progress entries without content go; progress entries with content count as the message
    inside them. An entry without a message, but with a text of its own, is the assistant's.
    """
    j = parse_lines(lines).withColumn("_progress", _get("$.type") == "progress")
    pick = lambda inner, plain: F.when(F.col("_progress"), _get(inner)).otherwise(_get(plain))
    part = F.when(F.col("_progress"), F.try_variant_get("j", "$.data.message.message.content", "variant")).otherwise(F.try_variant_get("j", "$.message.content", "variant"))
    alone = ~F.col("_progress") & F.try_variant_get("j", "$.message", "variant").isNull()
    e = j.select(
        "path", "line_no", "offset", F.when(F.col("_progress"), F.coalesce(_get("$.data.message.type"), F.lit("assistant"))).otherwise(_get("$.type")).alias("type"),
        F.coalesce(_get("$.uuid"), _get("$.id")).alias("uuid"), F.coalesce(_get("$.parentUuid"), _get("$.parent_uuid")).alias("parent_uuid"),
        F.coalesce(_get("$.sessionId"), _get("$.session_id")).alias("entry_session"), millis(_get("$.timestamp")).alias("created_at"), _get("$.cwd").alias("cwd"),
        F.coalesce(_get("$.parentToolUseID"), _get("$.parent_tool_use_id")).alias("parent_tool"),
        F.coalesce(pick("$.data.message.message.content", "$.message.content"), F.when(alone, _get("$.content"))).alias("content"),
        F.coalesce(F.schema_of_variant(part), F.lit("STRING")).alias("kind"), pick("$.data.message.message.model", "$.message.model").alias("model"),
        F.coalesce(pick("$.data.message.message.role", "$.message.role"), F.when(alone & _get("$.content").isNotNull(), "assistant")).alias("role"),
        F.coalesce(_get("$.isMeta", "boolean"), F.lit(False)).alias("_meta"), F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.coalesce(_get("$.agentId"), _get("$.data.agentId")).alias("agent_id"), F.coalesce(_get("$.toolUseResult.agentId"), _get("$.tool_use_result.agentId")).alias("result_agent"), "_progress",
    )
    e = e.where(F.col("type").isNotNull() & (F.col("type") != "queue-operation") & ~(F.col("_progress") & (F.coalesce("content", F.lit("")) == "")))
    first = F.get(F.filter(F.from_json("content", _BLOCKS), lambda b: b["type"] == "text"), F.lit(0))["text"]
    opening = F.when(F.col("kind").startswith("ARRAY"), first).otherwise(F.col("content"))
    meta = F.col("_meta") | (~F.col("_progress") & (F.col("type") == "user") & (F.coalesce("role", F.lit("")) == "user") & is_system_context(opening))
    e = e.withColumn("is_meta", meta).drop("_meta", "_progress")
    return e.withColumn("session_id", session_of(F.col("path"))).withColumn("text", joined_text(F.col("content"), F.col("kind")))


def codex_entries(lines: DataFrame) -> DataFrame:
    """Message envelopes as entries; the working folder is carried forward from the envelopes before. See ``codex`` for all emitters."""
    j = parse_lines(lines).withColumn("type", _get("$.type")).withColumn("sub", _get("$.payload.type"))
    session = session_of(F.col("path"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cwd = F.when(F.col("type") == "session_meta", F.coalesce(_get("$.payload.cwd"), F.lit(""))).when((F.col("type") == "turn_context") & (_get("$.payload.cwd") != ""), _get("$.payload.cwd"))
    emitted = (F.col("type") == "response_item") & F.col("sub").isin("message", "function_call", "custom_tool_call", "reasoning", "web_search_call") & (F.coalesce(_get("$.payload.role"), F.lit("")) != "developer")
    e = j.withColumn("cwd", F.nullif(F.last(cwd, ignorenulls=True).over(w), F.lit(""))).withColumn("_emit", emitted)
    n = F.sum(F.col("_emit").cast("int")).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("n", F.coalesce(n, F.lit(0))).where("_emit")
    kind = F.schema_of_variant(F.try_variant_get("j", "$.payload.content", "variant"))
    return e.select(
        "path", "line_no", "offset", F.when(F.col("sub") == "message", _get("$.payload.role")).otherwise("assistant").alias("type"),
        F.concat(F.lit("codex-jsonl-"), F.substring(session, 1, 8), F.lit("-"), F.col("n").cast("string")).alias("uuid"),
        session.alias("session_id"), millis(_get("$.timestamp")).alias("created_at"), "cwd", F.lit(None).cast("string").alias("parent_tool"),
        F.when(F.col("sub") == "message", joined_text(_get("$.payload.content"), F.coalesce(kind, F.lit("STRING")))).alias("text"), "sub",
        _get("$.payload.call_id").alias("call_id"), _get("$.payload.name").alias("tool"), F.coalesce(_get("$.payload.arguments"), _get("$.payload.input")).alias("input"),
    )


def tool_calls(lines: DataFrame) -> DataFrame:
    """Vendor codex: each call with its last output, and outputs without a call. Keys are the file and the call id."""
    j = parse_lines(lines).select("path", "line_no", _get("$.payload.type").alias("sub"), _get("$.payload.call_id").alias("call_id"), _get("$.payload.name").alias("name"), _get("$.payload.arguments").alias("input"), _get("$.payload.output").alias("output"))
    calls = j.where(F.col("sub").isin("function_call", "custom_tool_call")).select("path", "call_id", "line_no", tool_name(F.col("name")).alias("tool"), "input")
    outs = j.where(F.col("sub").isin("function_call_output", "custom_tool_call_output")).groupBy("path", "call_id").agg(F.max_by("output", "line_no").alias("output"))
    code = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("output", r"(?:Exit code:|exited with code) (-?\d+)", 1), F.lit("")), F.lit("S9999")), F.lit(None)).cast("int")
    body = F.when(F.contains("output", F.lit("Output:\n")), F.expr("substring(output, locate('Output:\n', output) + 8)")).otherwise(F.col("output"))
    return calls.join(outs, ["path", "call_id"], "full_outer").withColumn("exit_code", code).withColumn("body", body).withColumn("orphan", F.col("tool").isNull())


def tool_name(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TOOL_NAMES.items() for x in kv))
    return F.coalesce(F.get(F.array(F.try_element_at(known, name)), F.lit(0)), name)


def tool_category(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TOOL_CATEGORIES.items() for x in kv))
    return F.when(name.startswith("mcp__"), "mcp").otherwise(F.coalesce(F.try_element_at(known, name), F.lit("other")))


def evidence(files: DataFrame, vendor: str, lines: DataFrame) -> DataFrame:
    """What ``classify`` takes for ``files`` (path): no hook, and for the second vendor the meta data of the first line."""
    from threadloom.sources.codex import file_meta

    nothing = F.lit(None).cast("string")
    own = files.select("path", F.lit(vendor).alias("vendor"), session_of(F.col("path")).alias("session_id"), nothing.alias("hook_agent"), nothing.alias("hook_session"))
    if vendor == "claude":
        return own.withColumn("meta_id", nothing).withColumn("meta_parent", nothing)
    return own.join(file_meta(lines).select("path", F.col("id").alias("meta_id"), F.col("parent_id").alias("meta_parent")), "path", "left")


def text_blocks(entries: DataFrame) -> DataFrame:
    """User and assistant entries with text that belong to no tool's sub-agent."""
    return entries.where(F.col("type").isin("user", "assistant") & F.col("parent_tool").isNull() & (F.coalesce("text", F.lit("")) != ""))


def message_rows(entries: DataFrame, project: str | None = None, keep: str | None = None) -> DataFrame:
    """Message rows of user and assistant entries with text; the seq is the place among them before rows without uuid or text go."""
    kept = text_blocks(entries)
    w = Window.partitionBy("path").orderBy("line_no")
    first_cwd = F.first("cwd", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leaf = F.contains("path", F.lit("/subagents/")) | F.col("session_id").startswith("agent-")
    rows = kept.withColumn("message_seq", (F.row_number().over(w) - 1).cast("long")).withColumn("project_id", F.lit(project) if project else first_cwd)
    return rows.where(F.col("uuid").isNotNull()).select(
        *([keep] if keep else []), F.col("uuid").alias("message_id"), "session_id", "message_seq", F.col("text").alias("message_text"), "project_id",
        F.coalesce("created_at", F.lit(0)).alias("created_at"), F.col("type").alias("message_role"), F.when(leaf, "agent").otherwise("hot").alias("retrieval_class"),
    )


def session_edits(lines: DataFrame, root: str) -> DataFrame:
    """(session, file, content, ts) of Edit, Write and MultiEdit calls below ``root``; edits without a valid time go."""
    j = parse_lines(lines).select("path", millis(_get("$.timestamp")).alias("ts"), F.from_json(F.try_variant_get("j", "$.message.content", "string"), _BLOCKS).alias("blocks"))
    b = j.select("path", "ts", F.explode("blocks").alias("b")).where((F.col("b.type") == "tool_use") & F.col("b.name").isin("Edit", "Write", "MultiEdit"))
    arg = lambda p, t="string": F.try_variant_get(F.try_parse_json("b.input"), p, t)
    contents = F.when(F.col("b.name") == "Edit", F.array(arg("$.new_string"))).when(F.col("b.name") == "Write", F.array(arg("$.content"))).otherwise(
        F.from_json(arg("$.edits"), "array<struct<new_string:string>>")["new_string"]
    )
    base = root.rstrip("/") + "/"
    e = b.select(session_of(F.col("path")).alias("session"), arg("$.file_path").alias("file"), F.explode(contents).alias("content"), "ts")
    return e.where(F.col("ts").isNotNull() & F.col("content").isNotNull() & F.col("file").startswith(base)).withColumn("file", F.expr(f"substring(file, {len(base) + 1})"))

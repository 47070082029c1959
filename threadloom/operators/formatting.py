"""Messages and entries as text: a header each, tool blocks in short, long texts clipped, pages by count and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the format.
CLIP, RESULT_CLIP, INPUT_CLIP, THOUGHT_CLIP = 2_000, 400, 60, 200
LIMIT, BUDGET = 50, 30_000
CUT = "\n... [truncated]"


def header(label: Column, ms: Column) -> Column:
    when = F.coalesce(F.date_format(F.timestamp_millis(F.nullif(ms, F.lit(0))), "MM/dd/yyyy, hh:mm:ss a"), F.lit("unknown time"))
    return F.concat(F.lit("--- "), label, F.lit(" ["), when, F.lit("] ---\n"))


def clipped(text: Column, n: int = CLIP, mark: str = CUT) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def tool_line(name: Column, arguments: Column) -> Column:
    """``[Tool: name] key: value, ...`` with values clipped, of a JSON object."""
    pairs = F.transform(F.map_entries(F.from_json(arguments, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), F.substring(F.coalesce(e["value"], F.lit("null")), 1, INPUT_CLIP)))
    said = F.coalesce(F.array_join(pairs, ", "), F.lit(""))
    return F.concat(F.lit("[Tool: "), F.coalesce(name, F.lit("unknown")), F.lit("]"), F.when(said != "", F.concat(F.lit(" "), said)).otherwise(""))


def format_messages(messages: DataFrame) -> DataFrame:
    """Adds ``shown`` to stored messages: null for blank ones and other roles."""
    role = F.when(F.col("message_role") == "assistant", "ASSISTANT").when(F.col("message_role").isin("user", "human"), "USER")
    text = F.trim("message_text")
    return messages.withColumn("shown", F.when((text != "") & role.isNotNull(), F.concat(header(role, F.col("created_at")), clipped(text))))


def format_entries(entries: DataFrame) -> DataFrame:
    """Adds ``shown`` to entries (type, created_at, text, tool, input) of either vendor; tool calls and results in short."""
    tool = F.col("tool")
    body = (
        F.when(tool == "thinking", F.concat(F.lit("[Thinking: "), F.substring("text", 1, THOUGHT_CLIP), F.lit("...]")))
        .when(tool.isNotNull(), tool_line(tool, F.col("input"))).when(F.col("type") == "result", F.concat(F.lit("[Tool Result]\n"), clipped(F.col("text"), RESULT_CLIP, "... [truncated]")))
        .otherwise(F.trim("text"))
    )
    label = F.when(F.col("type") == "user", "USER").when(F.col("type") == "assistant", "ASSISTANT").when(F.col("type") == "result", "RESULT")
    shown = F.when((F.coalesce(body, F.lit("")) != "") & label.isNotNull(), F.concat(header(label, F.col("created_at")), F.when(F.col("type") == "result", body).otherwise(clipped(body))))
    return entries.withColumn("shown", shown)


def page(formatted: DataFrame, group: str, order: list[str], offset: int = 0, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """Per group: content, offset, total, shown, truncated and next_offset of one page of ``formatted`` (with ``shown``).

    A page ends after ``limit`` shown entries, or before the one that would go beyond ``budget`` characters (a line feed counts with each).
    """
    at = Window.partitionBy(group).orderBy(*order)
    rows = formatted.withColumn("i", F.row_number().over(at) - 1).withColumn("_total", F.count("*").over(Window.partitionBy(group)))
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    on_page = (F.col("i") >= offset) & F.col("shown").isNotNull()
    rows = rows.withColumn("_n", F.sum(on_page.cast("int")).over(so_far)).withColumn("_chars", F.sum(F.when(on_page, F.length("shown") + 1).otherwise(0)).over(so_far))
    kept = on_page & (F.col("_n") <= limit) & (F.col("_chars") <= budget)
    parts = F.sort_array(F.collect_list(F.when(kept, F.struct("i", "shown"))))
    p = rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["shown"]), "\n\n").alias("_text"), F.max("_total").alias("total"), F.count_if(kept).alias("shown"), F.coalesce(F.max(F.when(kept, F.col("i"))), F.lit(offset - 1)).alias("_last"), F.coalesce(F.max(F.when(kept, F.col("_chars"))), F.lit(0)).alias("_c"))
    truncated = F.col("_last") < F.col("total") - 1
    rule = "─" * 40
    foot = F.concat(F.lit(f"\n{rule}\nShowing messages {offset}–"), F.col("_last").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" (~"), F.col("_c").cast("string"), F.lit(" chars)"))
    foot = F.concat(foot, F.when(truncated, F.concat(F.lit("\nNext page: offset="), (F.col("_last") + 1).cast("string"))).otherwise(""))
    return p.select(group, F.concat("_text", foot).alias("content"), F.lit(offset).alias("offset"), "total", "shown", truncated.alias("truncated"), F.when(truncated, F.col("_last") + 1).alias("next_offset"))


#: Keys that the JSON of a tool's input or result holds, keys that it lacks, and what some of them have to be.
SHAPES: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, str]]] = {
    "file_read_input": (("file_path",), ("content", "old_string", "edits"), {}),
    "file_write_input": (("file_path", "content"), ("old_string",), {"content": "STRING"}),
    "file_edit_input": (("file_path", "old_string", "new_string"), (), {}),
    "bash_input": (("command",), (), {"command": "STRING"}),
    "glob_input": (("pattern",), ("output_mode", "type", "-A", "-B", "-C", "glob"), {}),
    "agent_input": (("prompt", "subagent_type", "description"), (), {}),
    "todo_write_input": (("todos",), (), {"todos": "ARRAY"}),
    "web_fetch_input": (("url", "prompt"), ("subagent_type",), {}),
    "web_search_input": (("query",), ("url",), {}),
    "ask_user_question_input": (("questions",), (), {"questions": "ARRAY"}),
    "skill_input": (("skill",), (), {"skill": "STRING"}),
    "bash_result": (("output", "exitCode"), (), {"exitCode": "NUMBER"}),
    "glob_result": (("matches", "count", "search_path"), (), {}),
    "grep_result": (("matches", "total_matches"), ("search_path",), {}),
    "task_result": (("status", "agentId", "content"), (), {}),
    "web_fetch_result": (("response", "url"), (), {}),
    "web_search_result": (("results", "total_results", "query"), (), {}),
}
GREP_KEYS = ("output_mode", "type", "-A", "-B", "-C", "glob")


def has_shape(json: Column, name: str) -> Column:
    """Whether a JSON text is an input or result of that kind."""
    v = F.try_parse_json(json)
    kind = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant")), F.lit(""))
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    if name == "error_result":
        return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    if name == "grep_input":
        return F.array_contains(keys, "pattern") & F.arrays_overlap(keys, F.array(*map(F.lit, GREP_KEYS)))
    if name in ("read_result", "write_result", "edit_result"):
        want = {"read_result": "text", "write_result": "create", "edit_result": "edit"}[name]
        whole = F.coalesce(text("type") == want, F.lit(False))
        return whole & F.array_contains(keys, "file") if name == "read_result" else whole
    has, lacks, typed = SHAPES[name]
    found = F.lit(True)
    for key in has:
        found = found & F.array_contains(keys, key)
    for key in lacks:
        found = found & ~F.array_contains(keys, key)
    for key, want in typed.items():
        numbers = kind(key).isin("BIGINT", "DOUBLE") | F.startswith(kind(key), F.lit("DECIMAL"))
        found = found & (numbers if want == "NUMBER" else F.startswith(kind(key), F.lit(want)))
    return found

"""Vendor codex: envelopes to entries — messages, reasoning, tool calls with their results, patches, web searches, orphaned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.plans.storage import written
from threadloom.sources.sessions import patch_changes
from threadloom.sources.transcripts import millis, parse_lines, session_of, tool_name

_ITEMS = "array<struct<type:string,text:string,image_url:string>>"
_FILE_HEAD = r"(?m)^\*\*\* (Update|Add|Delete) File:\s*.+$"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("j", path, kind)


def content_items(content: Column) -> Column:
    """Text and image items as blocks (type, text, media_type, data); a data URI is taken apart, other items go."""
    items = F.filter(F.from_json(content, _ITEMS), lambda i: (i["type"].isin("input_text", "output_text") & (F.coalesce(i["text"], F.lit("")) != "")) | ((i["type"] == "input_image") & (F.coalesce(i["image_url"], F.lit("")) != "")))
    uri = r"(?s)^data:(image/[^;]+);base64,(.+)$"

    def block(i: Column) -> Column:
        image = i["type"] == "input_image"
        kind = F.nullif(F.regexp_extract(i["image_url"], uri, 1), F.lit(""))
        return F.struct(
            F.when(image, "image").otherwise("text").alias("type"), F.when(~image, i["text"]).alias("text"), F.when(image, kind).alias("media_type"),
            F.when(image, F.coalesce(F.nullif(F.regexp_extract(i["image_url"], uri, 2), F.lit("")), i["image_url"])).alias("data"),
        )

    return F.transform(items, block)


def output_text(output: Column) -> Column:
    """A string as it is, the texts of an array of items joined by line feeds, else empty."""
    texts = F.filter(F.transform(F.from_json(output, _ITEMS), lambda i: i["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.when(F.startswith(output, F.lit("[")), F.array_join(texts, "\n")), output, F.lit(""))


def exec_result(text: Column) -> tuple[Column, Column]:
    """Exit code and body of a command's output; without a known header the code is 0 and the body all of it."""
    now, before = F.regexp_extract(text, r"Process exited with code (\d+)", 1), F.regexp_extract(text, r"Exit code: (\d+)", 1)
    headed = (now != "") | (before != "")
    at = F.instr(text, "Output:\n")
    body = F.when(~headed, text).when(at > 0, F.substring(text, at + 8, F.length(text))).otherwise("")
    return F.coalesce(F.nullif(now, F.lit("")), F.nullif(before, F.lit("")), F.lit("0")).cast("int"), body


def tool_input(name: Column, arguments: Column) -> Column:
    """The universal input of a function call as JSON; arguments that are no JSON object are kept raw."""
    a = F.try_parse_json(arguments)
    field = lambda p: F.coalesce(F.try_variant_get(a, p, "string"), F.lit(""))
    one = lambda key, value: F.to_json(F.struct(value.alias(key)))
    plan = F.from_json(F.try_variant_get(a, "$.plan", "string"), "array<struct<step:string,status:string>>")
    todos = F.coalesce(F.transform(plan, lambda i: F.struct(i["step"].alias("content"), i["status"].alias("status"), i["step"].alias("activeForm"))), F.expr("cast(array() as array<struct<content:string,status:string,activeForm:string>>)"))
    stdin = F.concat(F.lit("(write_stdin to session "), F.coalesce(F.try_variant_get(a, "$.session_id", "string"), F.lit("unknown")), F.lit(")"))
    return (
        F.when(name == "exec_command", one("command", field("$.cmd"))).when(name == "shell_command", one("command", field("$.command")))
        .when(name == "view_image", one("file_path", field("$.path"))).when(name == "update_plan", one("todos", todos)).when(name == "write_stdin", one("command", stdin))
        .when(a.isNull(), one("raw", arguments)).otherwise(arguments)
    )


def records(lines: DataFrame) -> DataFrame:
    """The envelopes with working folder and model carried forward, and the outputs paired with their calls.

    A call gets the last output of its id, unless one came before it; outputs without a call, or before it, are orphans, of
    which the first is kept.
    """
    j = parse_lines(lines).withColumn("type", _get("$.type")).withColumn("sub", F.when(F.col("type") == "response_item", _get("$.payload.type")))
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cwd = F.when(F.col("type") == "session_meta", F.coalesce(_get("$.payload.cwd"), F.lit(""))).when((F.col("type") == "turn_context") & (_get("$.payload.cwd") != ""), _get("$.payload.cwd"))
    model = F.when((F.col("type") == "turn_context") & (_get("$.payload.model") != ""), _get("$.payload.model"))
    j = j.withColumn("cwd", F.nullif(F.last(cwd, ignorenulls=True).over(so_far), F.lit(""))).withColumn("model", F.last(model, ignorenulls=True).over(so_far))
    j = j.where(F.col("sub").isNotNull()).select(
        "path", "line_no", "offset", "sub", "cwd", "model", session_of(F.col("path")).alias("session_id"), millis(_get("$.timestamp")).alias("created_at"),
        _get("$.payload.role").alias("role"), _get("$.payload.content").alias("content"), _get("$.payload.summary").alias("summary"), F.nullif(_get("$.payload.call_id"), F.lit("")).alias("call_id"),
        _get("$.payload.name").alias("name"), F.coalesce(_get("$.payload.arguments"), _get("$.payload.input")).alias("input"), _get("$.payload.output").alias("output"),
        _get("$.payload.action.query").alias("query"), _get("$.payload.status").alias("status"),
    )
    call, out = F.col("sub").isin("function_call", "custom_tool_call"), F.col("sub").isin("function_call_output", "custom_tool_call_output")
    of = Window.partitionBy("path", "call_id")
    j = j.withColumn("_call", F.min(F.when(call, F.col("line_no"))).over(of)).withColumn("_out", F.min(F.when(out, F.col("line_no"))).over(of))
    last = F.max(F.when(out, F.struct("line_no", "output", "created_at"))).over(of)
    paired = call & (F.col("line_no") == F.col("_call")) & (F.col("_out") > F.col("_call")) & F.col("call_id").isNotNull()
    orphan = out & F.col("call_id").isNotNull() & (F.col("line_no") == F.col("_out")) & (F.col("_call").isNull() | (F.col("_out") < F.col("_call")))
    return j.withColumn("result", F.when(paired, last)).withColumn("orphan", F.coalesce(orphan, F.lit(False))).withColumnRenamed("output", "own_output").drop("_call", "_out")


_THINKING = "array<struct<type:string,text:string>>"
_BASE = ["path", "line_no", "session_id", "cwd"]


def entries(lines: DataFrame) -> DataFrame:
    """(path, line_no, part, type, uuid, parent_uuid, session_id, created_at, cwd, model, tool, input, text, is_error, exit_code).

    ``type`` is user, assistant or result. Ids without a call id count the entries made before in the file.
    """
    r = records(lines)
    thoughts = F.filter(F.from_json("summary", _THINKING), lambda s: (s["type"] == "summary_text") & (F.coalesce(s["text"], F.lit("")) != ""))
    r = r.withColumn("thoughts", F.transform(thoughts, lambda s: s["text"]))
    said = (F.col("sub") == "message") & F.col("role").isin("user", "assistant")
    thought = (F.col("sub") == "reasoning") & (F.coalesce(F.size("thoughts"), F.lit(0)) > 0)
    called, custom, searched = F.col("sub") == "function_call", F.col("sub") == "custom_tool_call", F.col("sub") == "web_search_call"
    patched = custom & (F.col("name") == "apply_patch")
    files = F.when(patched, F.greatest(F.regexp_count(F.coalesce("input", F.lit("")), F.lit(_FILE_HEAD)), F.lit(1))).otherwise(1)
    answered = F.col("result").isNotNull().cast("int")
    made = F.when(said | thought | F.col("orphan"), 1).when(called | custom, files + answered).when(searched, 1 + (F.coalesce("status", F.lit("")) == "completed").cast("int")).otherwise(0)
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("n", F.coalesce(F.sum(made).over(before), F.lit(0))).withColumn("files", files)
    own_id = F.concat(F.lit("codex-jsonl-"), F.substring("session_id", 1, 8), F.lit("-"), F.col("n").cast("string"))
    r = written(r.withColumn("own_id", own_id), "records")  # read by every emitter below

    nothing = F.lit(None).cast("string")

    def row(df: DataFrame, part: Column, type_: Column | str, uuid: Column, parent: Column = nothing, at: Column | str = "created_at", **more: Column) -> DataFrame:
        given = {"model": nothing, "tool": nothing, "input": nothing, "text": nothing, "is_error": F.lit(None).cast("boolean"), "exit_code": F.lit(None).cast("int")} | more
        kind = F.lit(type_) if isinstance(type_, str) else type_
        when = F.col(at) if isinstance(at, str) else at
        return df.select(*_BASE, part.cast("int").alias("part"), kind.alias("type"), uuid.alias("uuid"), parent.alias("parent_uuid"), when.alias("created_at"), *(c.alias(k) for k, c in given.items()))

    texts = F.array_join(F.filter(F.transform(content_items(F.col("content")), lambda b: F.trim(b["text"])), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    zero, call_id = F.lit(0), F.col("call_id")
    message = row(r.where(said), zero, F.col("role"), F.col("own_id"), model=F.when(F.col("role") == "assistant", F.col("model")), text=F.coalesce(texts, F.lit("")))
    reasoning = row(r.where(thought), zero, "assistant", F.col("own_id"), text=F.array_join("thoughts", "\n"), tool=F.lit("thinking"))
    calls = r.where(called)
    call = row(calls, zero, "assistant", call_id, tool=tool_name(F.col("name")), input=tool_input(F.col("name"), F.col("input")))
    code, body = exec_result(output_text(F.col("result.output")))
    answer = row(calls.where(F.col("result").isNotNull()), F.lit(1), "result", F.concat(call_id, F.lit("-result")), call_id, F.col("result.created_at"), text=body, is_error=code != 0, exit_code=code)
    plain = row(r.where(custom & ~patched), zero, "assistant", call_id, tool=F.col("name"), input=F.to_json(F.struct(F.col("input").alias("raw"))))

    key = F.to_json(F.struct("path", "line_no"))
    patches = r.where(patched).withColumn("id", key)
    changes = patch_changes(patches.select("id", F.col("input").alias("patch"))).withColumnRenamed("path", "file").withColumnRenamed("id", "_id")
    each = patches.join(changes, F.col("id") == F.col("_id"), "left")
    number = F.coalesce(F.col("change_no"), F.lit(1)) - 1
    patch_id = F.when(number == 0, call_id).otherwise(F.concat(call_id, F.lit("-file-"), number.cast("string")))
    change = (
        F.when(F.col("kind").isNull(), F.to_json(F.struct(F.col("input").alias("patch"))))
        .when(F.col("kind") == "add", F.to_json(F.struct(F.col("file").alias("file_path"), F.col("new").alias("content"))))
        .when(F.col("kind") == "delete", F.to_json(F.struct(F.col("file").alias("file_path"))))
        .otherwise(F.to_json(F.struct(F.col("file").alias("file_path"), F.col("old").alias("old_string"), F.col("new").alias("new_string"))))
    )
    patch = row(each, number, "assistant", patch_id, tool=F.when(F.col("kind") == "add", "Write").otherwise("Edit"), input=change)
    last_id = F.when(F.col("files") > 1, F.concat(call_id, F.lit("-file-"), (F.col("files") - 1).cast("string"))).otherwise(call_id)
    raw = output_text(F.col("result.output"))
    parsed = F.try_parse_json(raw)
    failed = F.coalesce(~F.try_variant_get(parsed, "$.success", "boolean"), F.lit(False)) | F.coalesce(~F.try_variant_get(parsed, "$.error", "string").isin("", "false", "0"), F.lit(False))
    done = r.where(custom & F.col("result").isNotNull())
    custom_answer = row(done, F.col("files"), "result", F.concat(last_id, F.lit("-result")), last_id, F.col("result.created_at"), text=F.coalesce(F.try_variant_get(parsed, "$.output", "string"), raw), is_error=failed)

    web = row(r.where(searched), zero, "assistant", F.col("own_id"), tool=F.lit("WebSearch"), input=F.to_json(F.struct(F.coalesce("query", F.lit("")).alias("query"))))
    found = row(r.where(searched & (F.col("status") == "completed")), F.lit(1), "result", F.concat("own_id", F.lit("-result")), F.col("own_id"), text=F.lit(""), is_error=F.lit(False))
    lone = r.where("orphan")
    own = output_text(F.col("own_output"))
    lone_code, lone_body = exec_result(own)
    exec_ = F.col("sub") == "function_call_output"
    left = row(lone, zero, "result", F.concat(call_id, F.lit("-result")), call_id, text=F.when(exec_, lone_body).otherwise(own), is_error=F.when(exec_, lone_code != 0).otherwise(False), exit_code=F.when(exec_, lone_code))
    out = message
    for df in (reasoning, call, answer, plain, patch, custom_answer, web, found, left):
        out = out.unionByName(df)
    return out


def file_meta(lines: DataFrame) -> DataFrame:
    """(path, id, cwd, cli_version, git_branch, parent_id) of each file's first line, where that is the session's meta data."""
    first = parse_lines(lines.where(F.col("line_no") == 0)).where((_get("$.type") == "session_meta") & (F.octet_length("value") <= 8_192))
    parent = _get("$.payload.source.subagent.thread_spawn.parent_thread_id")
    return first.select("path", _get("$.payload.id").alias("id"), _get("$.payload.cwd").alias("cwd"), _get("$.payload.cli_version").alias("cli_version"), _get("$.payload.git.branch").alias("git_branch"), parent.alias("parent_id"))

"""Queries over transcripts of both vendors, whose lines are made of the conversations; and over what ingest does with them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import embedding, formatting, messages, store
from threadloom.plans import views
from threadloom.plans.registry import _WAIT, D, M, _vectors_cte, query
from threadloom.plans.views import EPOCH, doc_messages, table
from threadloom.sources import codex, sessions, transcripts
from threadloom.sources.transcripts import SYSTEM_OPENINGS
from threadloom.streaming import ingest

_TIME = "strftime(epoch_ms({e} + conv_id * 3600000 + turn * 60000), '%Y-%m-%dT%H:%M:%S')".format(e=EPOCH)


def _json(**parts):
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))


def _sources(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    ms = F.lit(EPOCH) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000
    opening = F.element_at(F.array(*map(F.lit, SYSTEM_OPENINGS)), (F.floor(F.col("conv_id") / 4) % len(SYSTEM_OPENINGS) + 1).cast("int"))
    said = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") % 3 == 0) & (F.col("role") == "user"), F.concat(opening, F.col("text"))).otherwise(F.col("text"))
    return c.withColumn("ts", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("said", said)


def claude_lines(spark, sf_dir):
    """A file a conversation: strings, block lists and progress entries in turn, system lines without a message, queue operations."""
    c = _sources(spark, sf_dir)
    uuid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    cwd = F.concat(F.lit("/w/p"), (F.col("conv_id") % 5).cast("string"))
    role, said = F.col("role"), F.col("said")
    result = F.when(F.col("turn") % 6 == 0, F.struct(F.concat(F.lit("c"), (F.col("turn") % 4).cast("string")).alias("agentId")))
    string = _json(type=role, uuid=uuid, timestamp=F.col("ts"), cwd=cwd, toolUseResult=result, isSidechain=F.col("conv_id") % 10 == 9, message=F.struct(role.alias("role"), said.alias("content")))
    text = F.struct(F.lit("text").alias("type"), said.alias("text"), F.lit(None).cast("string").alias("name"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"))
    blocks = _json(type=role, uuid=uuid, timestamp=F.col("ts"), cwd=cwd, message=F.struct(role.alias("role"), F.array(text, tool).alias("content")))
    inner = F.struct(role.alias("type"), F.struct(role.alias("role"), said.alias("content")).alias("message"))
    progress = _json(type=F.lit("progress"), uuid=uuid, timestamp=F.col("ts"), data=F.struct(inner.alias("message")), parentToolUseID=F.when(F.col("conv_id") % 2 == 0, "k"))
    system = F.when(F.col("conv_id") % 2 == 0, _json(type=F.lit("queue-operation"), content=said)).otherwise(_json(type=role, uuid=uuid, timestamp=F.col("ts"), content=said))
    turn = F.col("turn") % 3
    value = F.when(role == "system", system).when(turn == 0, string).when(turn == 1, blocks).otherwise(progress)
    path = F.concat(F.lit("/t/claude/s"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    path = F.when(F.col("conv_id") % 10 == 9, F.concat(F.lit("/t/claude/s0/subagents/agent-"), F.col("conv_id").cast("string"), F.lit(".jsonl"))).otherwise(path)
    return c.select(path.alias("path"), F.col("turn").alias("line_no"), (F.col("turn") * 1000).alias("offset"), value.alias("value"))


_OPENINGS_SQL = "[" + ", ".join(f"'{x}'" for x in SYSTEM_OPENINGS) + "]"
_CLAUDE = f"""WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN conv_id % 10 = 9 THEN '/t/claude/s0/subagents/agent-' || conv_id || '.jsonl' ELSE '/t/claude/s' || conv_id || '.jsonl' END AS path,
  CASE WHEN conv_id % 4 = 1 AND turn % 3 = 0 AND role = 'user' THEN {_OPENINGS_SQL}[conv_id // 4 % {len(SYSTEM_OPENINGS)} + 1] || coalesce(text, '') ELSE coalesce(text, '') END AS said FROM conversations),
e AS (SELECT path, conv_id, turn AS line_no, role AS type, conv_id || '-' || turn AS uuid, trim(said) AS text, role = 'user' AND turn % 3 <> 2 AND conv_id % 4 = 1 AND turn % 3 = 0 AS is_meta,
  CASE WHEN role <> 'system' AND turn % 3 = 2 AND conv_id % 2 = 0 THEN 'k' END AS parent_tool, {EPOCH} + conv_id * 3600000 + turn * 60000 AS created_at,
  CASE WHEN role = 'system' OR turn % 3 = 2 THEN NULL ELSE '/w/p' || conv_id % 5 END AS cwd
  FROM s WHERE NOT (role = 'system' AND conv_id % 2 = 0) AND NOT (role <> 'system' AND turn % 3 = 2 AND said = ''))"""


def _entries(spark, sf_dir):
    return transcripts.claude_entries(claude_lines(spark, sf_dir))


@query(_CLAUDE + " SELECT path, line_no, type, uuid, text, is_meta, parent_tool, created_at, cwd FROM e")
def adapt_a(spark, sf_dir):
    return _entries(spark, sf_dir).select("path", "line_no", "type", "uuid", "text", "is_meta", "parent_tool", "created_at", "cwd")


@query(_CLAUDE + """ SELECT e.path, sum(CASE WHEN type IN ('user', 'assistant') AND line_no % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS tool_uses, count(*) FILTER (WHERE type IN ('user', 'assistant') AND NOT is_meta) AS messages,
array_to_string(list_sort(coalesce(list(DISTINCT 'agent-c' || line_no % 4) FILTER (WHERE type = 'user' AND line_no % 6 = 0), [])), ',') AS children FROM e GROUP BY path""")
def agg_meta(spark, sf_dir):
    c = sessions.content_counts(_entries(spark, sf_dir))
    return c.select("path", F.col("tool_uses").cast("long").alias("tool_uses"), "messages", F.array_join("children", ",").alias("children"))


@query(_CLAUDE + " SELECT path, line_no FROM e WHERE is_meta")
def flt_system_ctx(spark, sf_dir):
    return _entries(spark, sf_dir).where("is_meta").select("path", "line_no")


@query(_CLAUDE + " SELECT path, line_no, text FROM e WHERE type IN ('user', 'assistant') AND text <> '' AND parent_tool IS NULL")
def flt_text_blocks(spark, sf_dir):
    return transcripts.text_blocks(_entries(spark, sf_dir)).select("path", "line_no", "text")


@query(_CLAUDE + " SELECT path, line_no, text FROM e")
def prj_entry_text(spark, sf_dir):
    return _entries(spark, sf_dir).select("path", "line_no", "text")


_ROWS = """, k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS seq, first_value(cwd IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS project FROM e WHERE type IN ('user', 'assistant') AND text <> '' AND parent_tool IS NULL)
SELECT uuid AS message_id, regexp_extract(path, '([^/]+)\\.jsonl$', 1) AS session_id, seq AS message_seq, text AS message_text, project AS project_id, created_at, type AS message_role,
CASE WHEN conv_id % 10 = 9 THEN 'agent' ELSE 'hot' END AS retrieval_class FROM k"""


@query(_CLAUDE + _ROWS)
def ingest_session(spark, sf_dir):
    """Message rows of all files, with the project from the first folder that a kept entry names."""
    return ingest.session_rows(claude_lines(spark, sf_dir), "claude").drop("path")


@query(_CLAUDE + ", " + _ROWS.split(", ", 1)[1].split("\nSELECT")[0] + " SELECT uuid AS message_id, seq AS message_seq, type AS message_role FROM k")
def prj_cast_row(spark, sf_dir):
    return transcripts.message_rows(_entries(spark, sf_dir)).select("message_id", "message_seq", "message_role")


@query("SELECT conv_id, count(*) AS good FROM conversations GROUP BY conv_id")
def src_jsonl_a(spark, sf_dir):
    """Lines that parse, among as many that are blank or malformed."""
    c = table(spark, sf_dir, "conversations")
    value = F.explode(F.array(_json(a=F.col("text")), F.lit("   "), F.lit("not json {"), F.concat(F.lit('{"a": '), F.col("turn").cast("string"))))
    return transcripts.parse_lines(c.select("conv_id", value.alias("value"))).groupBy("conv_id").agg(F.count("*").alias("good"))


@query("""WITH f AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY 1), l AS (SELECT conv_id, strlen(t) AS n FROM f)
SELECT '/t/' || conv_id AS path, CASE WHEN conv_id % 3 = 1 THEN 1 ELSE 0 END + i AS line_no FROM l, (SELECT unnest(range(0, 2)) AS i) x WHERE n > 0 AND CASE WHEN conv_id % 3 = 1 THEN i = 0 ELSE true END""")
def src_tail(spark, sf_dir):
    """Files of two whole lines and a half one. Of every third file one line was read before; of another the file has shrunk since."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    one = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), ""), r"\s", "_")
    path = F.concat(F.lit("/t/"), F.col("conv_id").cast("string"))
    files = c.select("conv_id", path.alias("path"), one.alias("one")).where("one <> ''").withColumn("value", F.concat("one", F.lit("\n"), F.lit("second\nhalf")))
    seen = F.octet_length("one") + 1
    state = files.where("conv_id % 3 > 0").select("path", seen.cast("long").alias("offset"), F.when(F.col("conv_id") % 3 == 1, seen).otherwise(F.octet_length("value") + 1).cast("long").alias("size"))
    return transcripts.new_lines(files.select("path", "value"), state).select("path", "line_no")


@query("""SELECT '/t/' || conv_id || '/rollout-x-0000000' || conv_id % 10 || '-0000-0000-0000-000000000000.jsonl' AS path FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 = 3""")
def src_b_scan(spark, sf_dir):
    """The files of one session, newest first."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit("/rollout-x-0000000"), (F.col("conv_id") % 10).cast("string"), F.lit("-0000-0000-0000-000000000000.jsonl"))
    files = c.select(name.alias("path"), F.col("conv_id").alias("mtime_ms"))
    return transcripts.newest_first(transcripts.file_of(files, "00000003-0000-0000-0000-000000000000")).select("path")


# --- the second vendor ---------------------------------------------------------------------------------------------


def codex_lines(spark, sf_dir):
    """A file a conversation: meta data, a turn context, and five lines a turn: message, call, its output, and one or two of other kinds."""
    c = _sources(spark, sf_dir).withColumn("path", F.concat(F.lit("/t/codex/rollout-s"), F.col("conv_id").cast("string"), F.lit(".jsonl")))
    turn, s = F.col("turn"), lambda x: F.lit(x)
    env = lambda payload, kind="response_item": _json(timestamp=F.col("ts"), type=s(kind), payload=payload)
    obj = lambda **parts: F.struct(*(v.alias(k) for k, v in parts.items()))
    first = c.groupBy("path", "conv_id").agg(F.min("ts").alias("ts"))
    spawn = F.when(F.col("conv_id") % 10 == 9, obj(subagent=obj(thread_spawn=obj(parent_thread_id=s("s0")))))
    cwd = F.concat(s("/w/p"), (F.col("conv_id") % 5).cast("string"))
    meta = first.select("path", s(0).alias("line_no"), env(obj(id=F.concat(s("s"), F.col("conv_id").cast("string")), cwd=cwd, cli_version=s("1.0"), git=obj(branch=s("b")), source=spawn), "session_meta").alias("value"))
    context = first.select("path", s(1).alias("line_no"), env(obj(model=F.concat(s("m"), (F.col("conv_id") % 2).cast("string")), cwd=F.when(F.col("conv_id") % 3 == 0, "/x")), "turn_context").alias("value"))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    call = F.concat(s("k"), turn.cast("string"))
    item = obj(type=s("input_text"), text=F.col("text"), image_url=s(None).cast("string"))
    picture = obj(type=s("input_image"), text=s(None).cast("string"), image_url=s("data:image/png;base64,QQ=="))
    message = env(obj(type=s("message"), role=role, content=F.array(item, picture)))
    called = env(obj(type=s("function_call"), call_id=call, name=s("exec_command"), arguments=F.concat(s('{"cmd":"ls '), turn.cast("string"), s('"}'))))
    answer = F.concat(s("Process exited with code "), (turn % 2).cast("string"), s("\nOutput:\n"), F.col("text"))
    output = env(obj(type=s("function_call_output"), call_id=F.when(turn % 4 == 3, F.concat(s("lost"), turn.cast("string"))).otherwise(call), output=answer))
    thought = env(obj(type=s("reasoning"), summary=F.array(obj(type=s("summary_text"), text=s("thinking of it")))))
    web = env(obj(type=s("web_search_call"), action=obj(query=s("q")), status=F.when(F.col("conv_id") % 2 == 0, "completed").otherwise("open")))
    text = "*** Begin Patch\n*** Update File: a.py\n@@\n-old\n+new\n keep\n*** Add File: b.py\n+one\n+two\n*** End Patch"
    patch = env(obj(type=s("custom_tool_call"), call_id=F.concat(s("p"), turn.cast("string")), name=s("apply_patch"), input=s(text)))
    done = env(obj(type=s("custom_tool_call_output"), call_id=F.concat(s("p"), turn.cast("string")), output=s('{"output":"done","success":false}')))
    noise = env(obj(type=s("message"), role=s("user")), "event_msg")
    kind = turn % 4
    fourth = F.when(kind == 0, patch).when(kind == 1, thought).when(kind == 2, web).otherwise(noise)
    fifth = F.when(kind == 0, done).otherwise(noise)
    each = c.select("path", "turn", F.posexplode(F.array(message, called, output, fourth, fifth)).alias("n", "value"))
    body = each.select("path", (F.col("turn") * 5 + 2 + F.col("n")).cast("int").alias("line_no"), "value")
    return meta.unionByName(context).unionByName(body).withColumn("offset", F.col("line_no").cast("long") * 1000)


_CODEX = f"""WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, '/t/codex/rollout-s' || conv_id || '.jsonl' AS path, 'm' || conv_id % 2 AS m,
  CASE WHEN conv_id % 3 = 0 THEN '/x' ELSE '/w/p' || conv_id % 5 END AS cwd FROM conversations),
p AS (
  SELECT *, 0 AS n, 0 AS part, role AS type, NULL AS id, NULL AS tool, trim(text) AS said, NULL::INT AS code, NULL::VARCHAR AS input FROM s WHERE role <> 'system'
  UNION ALL SELECT *, 1, 0, 'assistant', 'k' || turn, 'Bash', NULL, NULL, '{{"command":"ls ' || turn || '"}}' FROM s
  UNION ALL SELECT *, 1, 1, 'result', 'k' || turn || '-result', NULL, text, turn % 2, NULL FROM s WHERE turn % 4 <> 3
  UNION ALL SELECT *, 2, 0, 'result', 'lost' || turn || '-result', NULL, text, turn % 2, NULL FROM s WHERE turn % 4 = 3
  UNION ALL SELECT *, 3, 0, 'assistant', 'p' || turn, 'Edit', NULL, NULL, '{{"file_path":"a.py","old_string":"old\\nkeep","new_string":"new\\nkeep"}}' FROM s WHERE turn % 4 = 0
  UNION ALL SELECT *, 3, 1, 'assistant', 'p' || turn || '-file-1', 'Write', NULL, NULL, '{{"file_path":"b.py","content":"one\\ntwo"}}' FROM s WHERE turn % 4 = 0
  UNION ALL SELECT *, 3, 2, 'result', 'p' || turn || '-file-1-result', NULL, 'done', NULL, NULL FROM s WHERE turn % 4 = 0
  UNION ALL SELECT *, 3, 0, 'assistant', NULL, 'thinking', 'thinking of it', NULL, NULL FROM s WHERE turn % 4 = 1
  UNION ALL SELECT *, 3, 0, 'assistant', NULL, 'WebSearch', NULL, NULL, '{{"query":"q"}}' FROM s WHERE turn % 4 = 2
  UNION ALL SELECT *, 3, 1, 'result', 'w', NULL, '', NULL, NULL FROM s WHERE turn % 4 = 2 AND conv_id % 2 = 0),
q AS (SELECT *, turn * 5 + 2 + n AS line_no, count(*) OVER (PARTITION BY path ORDER BY turn, n RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY path, turn, n) AS before FROM p),
b AS (SELECT *, 'codex-jsonl-' || substr(regexp_extract(path, '([^/]+)\\.jsonl$', 1), 1, 8) || '-' || before AS own FROM q),
e AS (SELECT path, line_no, part, type, CASE WHEN id IS NULL THEN own WHEN id = 'w' THEN own || '-result' ELSE id END AS uuid, tool, said AS text, code AS exit_code, cwd,
  CASE WHEN n = 0 AND type = 'assistant' THEN m END AS model, input FROM b)"""


@query(_CODEX + " SELECT path, line_no, part, type, uuid, tool, text, exit_code, cwd, model, input FROM e")
def adapt_b(spark, sf_dir):
    """All entries that the envelopes make, in whole."""
    return codex.entries(codex_lines(spark, sf_dir)).select("path", "line_no", "part", "type", "uuid", "tool", "text", "exit_code", "cwd", "model", "input")


@query(_CODEX + " SELECT path, line_no, uuid, exit_code FROM e WHERE type = 'result' AND exit_code IS NOT NULL")
def call_output_pair(spark, sf_dir):
    """Outputs of calls, and those without one."""
    e = codex.entries(codex_lines(spark, sf_dir)).where("type = 'result' and exit_code is not null")
    return e.select("path", "line_no", "uuid", "exit_code")


@query(_CODEX + " SELECT path, line_no, uuid, tool, input FROM e WHERE tool IN ('Edit', 'Write')")
def parse_patch(spark, sf_dir):
    return codex.entries(codex_lines(spark, sf_dir)).where("tool in ('Edit', 'Write')").select("path", "line_no", "uuid", "tool", "input")


@query(_CODEX + " SELECT path, line_no, cwd, model FROM e WHERE type IN ('user', 'assistant') AND tool IS NULL")
def win_cwd_model(spark, sf_dir):
    return codex.entries(codex_lines(spark, sf_dir)).where("type in ('user', 'assistant') and tool is null").select("path", "line_no", "cwd", "model")


@query("""SELECT '/t/codex/rollout-s' || conv_id || '.jsonl' AS path, 's' || conv_id AS id, '/w/p' || conv_id % 5 AS cwd, '1.0' AS cli_version, 'b' AS git_branch,
CASE WHEN conv_id % 10 = 9 THEN 's0' END AS parent_id FROM (SELECT DISTINCT conv_id FROM conversations)""")
def src_b_meta(spark, sf_dir):
    return codex.file_meta(codex_lines(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT '/t/claude/' || CASE WHEN conv_id % 10 = 9 THEN 's0/subagents/agent-' ELSE 's' END || conv_id || '.jsonl' AS path, CASE WHEN conv_id % 10 = 9 THEN 'agent-' ELSE 's' END || conv_id AS session_id,
CASE WHEN conv_id % 10 = 9 THEN 'agent' ELSE 'root' END AS kind, CASE WHEN conv_id % 10 = 9 THEN 's0' END AS parent_session_id, CASE WHEN conv_id % 10 = 9 THEN 'path' ELSE 'default-root' END AS evidence FROM c
UNION ALL SELECT '/t/codex/rollout-s' || conv_id || '.jsonl', 's' || conv_id, CASE WHEN conv_id % 10 = 9 THEN 'agent' ELSE 'root' END, CASE WHEN conv_id % 10 = 9 THEN 's0' END, CASE WHEN conv_id % 10 = 9 THEN 'meta' ELSE 'default-root' END FROM c""")
def classify(spark, sf_dir):
    """What each file's path, name and meta data tell of its session."""
    a, b = claude_lines(spark, sf_dir), codex_lines(spark, sf_dir)
    files = transcripts.evidence(a.select("path").distinct(), "claude", a).unionByName(transcripts.evidence(b.select("path").distinct(), "codex", b))
    return sessions.classify(files, spark.createDataFrame([], "transcript_path string, kind string, session_id string, parent_session_id string"))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT '/t/claude/' || CASE WHEN conv_id % 10 = 9 THEN 's0/subagents/agent-' ELSE 's' END || conv_id || '.jsonl' AS path, CASE WHEN conv_id % 10 = 9 THEN 'agent-' ELSE 's' END || conv_id AS session_id FROM c)
SELECT path, session_id FROM k WHERE session_id NOT IN (SELECT DISTINCT 's' || conv_id FROM conversations WHERE turn = 2 AND role <> 'system')""")
def anti_indexed(spark, sf_dir):
    """Files of sessions that have no message yet: those without a third turn, and sub-agents."""
    known = views.messages(spark, sf_dir).where("message_seq = 2")
    return ingest.unindexed(claude_lines(spark, sf_dir).select("path").distinct(), known).select("path", "session_id")


@query("""WITH e AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CASE WHEN conv_id % 3 = 0 THEN 'agent-' || conv_id ELSE 's' || conv_id END AS session_id, CASE WHEN conv_id % 3 = 0 THEN '/t/.codex/agent-' || conv_id || '.jsonl' ELSE '/t/s' || conv_id || '.jsonl' END AS path,
CASE WHEN conv_id % 3 = 0 THEN 'codex' ELSE 'claude' END AS vendor FROM e WHERE conv_id % 3 < 2""")
def stop_hook(spark, sf_dir):
    """Events to targets: a third names a sub-agent's transcript, a third its own, a third none."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n, rest = F.col("conv_id").cast("string"), F.col("conv_id") % 3
    own = F.when(rest == 1, F.concat(F.lit("/t/s"), n, F.lit(".jsonl")))
    agent = F.when(rest == 0, F.concat(F.lit("/t/.codex/agent-"), n, F.lit(".jsonl")))
    events = c.select(_json(session_id=F.concat(F.lit("s"), n), transcript_path=own, agent_transcript_path=agent).alias("value"))
    return ingest.hook_targets(events).select("session_id", "path", "vendor")


# --- upkeep --------------------------------------------------------------------------------------------------------

def _migrated(spark, sf_dir):
    m = doc_messages(spark, sf_dir).withColumn("retrieval_class", F.lit("hot"))
    leaf = F.when(F.col("session_id").isin("src3", "src4"), F.concat(F.lit("agent-"), "session_id")).otherwise(F.col("session_id"))
    m = m.withColumn("session_id", leaf).withColumn("message_id", F.when(F.col("session_id").isin("src5", "src6", "src7"), F.concat(F.lit("codex-jsonl-"), "message_id")).otherwise(F.col("message_id")))
    rows = [("/t/src1/subagents/agent-src3.jsonl", "claude", "agent-src3", None, False), ("/t/src5.jsonl", "codex", "src5", "src1", True), ("/t/src6.jsonl", "codex", "src6", None, False)]
    files = spark.createDataFrame(rows, "path string, vendor string, session_id string, meta_parent string, is_child boolean")
    vectors = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    ids = F.when(F.col("source").isin("src5", "src6", "src7"), F.concat(F.lit("codex-jsonl-d"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("d"), F.col("vec_id").cast("string")))
    return store.migrate_classes(m, vectors.select(ids.alias("message_id")), files)


@query("""SELECT 3::BIGINT AS agent_sessions, count(*) FILTER (WHERE source IN ('src3', 'src4', 'src5')) AS agent_messages, 1::BIGINT AS unresolved,
(SELECT count(*) FROM embeddings JOIN documents ON vec_id = doc_id WHERE source IN ('src3', 'src4', 'src5')) AS purged_vectors FROM documents""")
def dml_migrate(spark, sf_dir):
    """The report of a migration: two sessions are sub-agents by name, one by its file, one stays unresolved."""
    return _migrated(spark, sf_dir)[3]


@query("SELECT 'd' || doc_id AS message_id FROM documents WHERE source IN ('src3', 'src4') UNION ALL SELECT 'codex-jsonl-d' || doc_id FROM documents WHERE source = 'src5'")
def dml_migrate_flips(spark, sf_dir):
    return _migrated(spark, sf_dir)[0].where("retrieval_class = 'agent'").select("message_id")


@query(_vectors_cte(50) + _WAIT.replace("message_id NOT IN (SELECT message_id FROM vectors WHERE embed_version = 3)", "true") + " SELECT count(*) AS gap_count FROM wait")
def dml_repair(spark, sf_dir):
    """Without vectors every eligible message waits for one again."""
    from threadloom.operators import semantic

    gone = store.repair_vectors(views.vectors(spark, sf_dir))
    return semantic.gap(doc_messages(spark, sf_dir), gone).select("gap_count")


@query(_vectors_cte(50) + " SELECT message_id, embed_version FROM vectors v JOIN documents d ON d.doc_id = v.vec_id WHERE d.source <> 'src2'")
def dml_delete_vectors(spark, sf_dir):
    """The vectors that are left when a session goes."""
    return store.delete_session(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir), "src2")[1].select("message_id", "embed_version")


@query("""WITH f AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT '/t/' || conv_id AS path, (conv_id * 10)::BIGINT AS last_mtime, CASE WHEN conv_id % 2 = 0 THEN n + 5 ELSE n END AS last_size, 'claude' AS vendor FROM f""")
def dml_watermark(spark, sf_dir):
    """Marks of which every other advances; the rest keep what they had."""
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    path = F.concat(F.lit("/t/"), F.col("conv_id").cast("string"))
    marks = f.select(path.alias("path"), (F.col("conv_id") * 10).alias("last_mtime"), F.col("n").alias("last_size"), F.lit("claude").alias("vendor"))
    done = f.where("conv_id % 2 = 0").select(path.alias("path"), (F.col("conv_id") * 10 + F.lit(0.9)).alias("mtime_ms"), (F.col("n") + 5).alias("size"), F.lit("claude").alias("vendor"))
    return store.advance_watermark(marks, done)


def length_embedder(texts: list[str]) -> list[list[float]]:
    """Stands in for a model: three numbers that depend on the text."""
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


@query(D + """, w AS (SELECT *, lag(message_text) OVER (PARTITION BY session_id ORDER BY message_seq) AS prev FROM doc_messages WHERE retrieval_class = 'hot'),
t AS (SELECT message_id, message_seq, trim(message_text) AS m, prev FROM w WHERE session_id = 'src5' AND trim(message_text) <> '')
SELECT message_id, substr(CASE WHEN length(m) < 200 AND prev IS NOT NULL AND prev <> '' THEN right(prev, 512) || chr(10) || m ELSE m END, 1, 14000) AS embed_text FROM t ORDER BY message_seq, message_id LIMIT 10""")
def embed_session(spark, sf_dir):
    return embedding.session_queue(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir), "src5", force=True)


@query("""WITH m AS (SELECT conv_id || '-' || turn AS message_id, trim(substr(trim(text), 1, 14000)) AS t, substr(trim(text), 1, 14000) AS u FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 10 <> 9),
v AS (SELECT message_id, (length(u) + 17)::DOUBLE AS a, (length(u) + 17 - length(replace('search_document: ' || u, 'e', '')))::DOUBLE AS b FROM m WHERE u <> '')
SELECT message_id, round(sqrt(a * a + b * b + 1), 6) AS norm, 3 AS embed_version FROM v""")
def embed_batch(spark, sf_dir):
    """All hot messages through an embedder that counts characters, with the task's prefix."""
    rows = messages.hot(views.messages(spark, sf_dir)).select("message_id", F.col("message_text").alias("embed_text"))
    return embedding.embed_rows(rows, length_embedder).select("message_id", F.round("norm", 6).alias("norm"), "embed_version")


@query(_vectors_cte(50) + _WAIT + """ SELECT (SELECT count(*) FROM conversations WHERE turn = 0) AS missing_sessions, (SELECT count(*) FROM doc_messages WHERE retrieval_class = 'hot' AND trim(message_text) <> '') AS total,
(SELECT count(*) FROM wait) AS gap_count, (SELECT count(*) FROM wait) > 200 AS ask""")
def catchup(spark, sf_dir):
    m, v = doc_messages(spark, sf_dir), views.vectors(spark, sf_dir)
    paths = table(spark, sf_dir, "conversations").where("turn = 0").select(F.concat(F.lit("/t/s"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"))
    return embedding.catch_up(m, v, ingest.unindexed(paths, m))


# --- texts and shapes ----------------------------------------------------------------------------------------------


@query(M + """, f AS (SELECT session_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS total, '--- ' || CASE message_role WHEN 'user' THEN 'USER' ELSE 'ASSISTANT' END || ' [' || strftime(epoch_ms(created_at), '%m/%d/%Y, %I:%M:%S %p') || '] ---' || chr(10) ||
  CASE WHEN length(trim(message_text)) > 2000 THEN substr(trim(message_text), 1, 2000) || chr(10) || '... [truncated]' ELSE trim(message_text) END AS x, trim(message_text) <> '' AS ok FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY message_seq, message_id)),
c AS (SELECT *, sum(CASE WHEN ok THEN length(x) + 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chars, sum(ok::INT) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM f),
g AS (SELECT session_id, any_value(total) AS total, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (WHERE ok AND n <= 3 AND chars <= 1500), '') AS t, count(*) FILTER (WHERE ok AND n <= 3 AND chars <= 1500) AS shown,
  coalesce(max(i) FILTER (WHERE ok AND n <= 3 AND chars <= 1500), -1) AS last, coalesce(max(chars) FILTER (WHERE ok AND n <= 3 AND chars <= 1500), 0) AS ch FROM c GROUP BY session_id)
SELECT session_id, t || chr(10) || repeat('─', 40) || chr(10) || 'Showing messages 0–' || last || ' of ' || total || ' (~' || ch || ' chars)' || CASE WHEN last < total - 1 THEN chr(10) || 'Next page: offset=' || (last + 1) ELSE '' END AS content,
0 AS "offset", total, shown, last < total - 1 AS truncated, CASE WHEN last < total - 1 THEN last + 1 END AS next_offset FROM g""")
def format_transcript(spark, sf_dir):
    """The first page of every session."""
    shown = formatting.format_messages(views.messages(spark, sf_dir))
    return formatting.page(shown, "session_id", ["message_seq", "message_id"], limit=3, budget=1_500)


_INPUTS = [
    '{"file_path":"a"}', '{"file_path":"a","content":"x"}', '{"file_path":"a","content":1}', '{"file_path":"a","old_string":"x","new_string":"y"}', '{"command":"ls"}', '{"command":1}', '{"pattern":"x"}',
    '{"pattern":"x","-A":2}', '{"prompt":"p","subagent_type":"s","description":"d"}', '{"todos":[]}', '{"url":"u","prompt":"p"}', '{"query":"q"}', '{"type":"text","file":{}}', '{"type":"create"}', '{"type":"edit"}',
    '{"output":"o","exitCode":0}', '{"output":"o","exitCode":"0"}', '{"matches":[],"count":0,"search_path":"/"}', '{"matches":[],"total_matches":0}', '{"status":"s","agentId":"a","content":[]}', '{"response":"r","url":"u"}',
    '{"results":[],"total_results":0,"query":"q"}', '"boom"', '{"questions":[]}', '{"skill":"s"}', "not json",
]
_NAMES = [*formatting.SHAPES, "grep_input", "read_result", "write_result", "edit_result", "error_result"]


@query("""SELECT * FROM (VALUES (0, 'file_read_input'), (1, 'file_write_input'), (3, 'file_edit_input'), (4, 'bash_input'), (6, 'glob_input'), (7, 'grep_input'), (8, 'agent_input'), (9, 'todo_write_input'),
(10, 'web_fetch_input'), (11, 'web_search_input'), (12, 'read_result'), (13, 'write_result'), (14, 'edit_result'), (15, 'bash_result'), (17, 'glob_result'), (18, 'grep_result'), (19, 'task_result'), (20, 'web_fetch_result'),
(21, 'web_search_input'), (21, 'web_search_result'), (22, 'error_result'), (23, 'ask_user_question_input'), (24, 'skill_input')) AS t(i, name)""")
def type_guards(spark, sf_dir):
    """Which shapes each of some inputs and results has; the SQL states them."""
    df = spark.createDataFrame(list(enumerate(_INPUTS)), "i int, json string")
    each = F.array(*(F.when(formatting.has_shape(F.col("json"), n), n) for n in _NAMES))
    return df.select("i", F.explode(each).alias("name")).where("name is not null")


@query("""WITH t AS (SELECT unnest(['Bash', 'Edit', 'mcp__x', 'odd', 'exec_command', 'update_plan']) AS name) SELECT name, CASE name WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'file_edit' WHEN 'mcp__x' THEN 'mcp' ELSE 'other' END AS category,
CASE name WHEN 'exec_command' THEN 'Bash' WHEN 'update_plan' THEN 'TodoWrite' ELSE name END AS tool FROM t""")
def map_fn_call(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("Bash", "Edit", "mcp__x", "odd", "exec_command", "update_plan")], "name string")
    return df.select("name", transcripts.tool_category(F.col("name")).alias("category"), transcripts.tool_name(F.col("name")).alias("tool"))


@query("""WITH u AS (SELECT conv_id, turn, conv_id // 2 * 100 + turn AS id FROM conversations WHERE role = 'user'), p AS (SELECT id FROM u WHERE conv_id % 2 = 0 AND turn < 4),
c AS (SELECT conv_id, turn, id, id IN (SELECT id FROM p) AS shared FROM u), k AS (SELECT conv_id, min(turn) FILTER (WHERE NOT shared) AS fork FROM c GROUP BY 1)
SELECT '/t/' || conv_id AS path, fork::BIGINT AS fork_offset, max_by(id, turn) FILTER (WHERE shared AND (fork IS NULL OR turn < fork))::VARCHAR AS last_shared FROM c JOIN k USING (conv_id) GROUP BY conv_id, fork""")
def set_divergence(spark, sf_dir):
    """Where each conversation leaves the user entries that even ones begin with."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (F.floor(F.col("conv_id") / 2) * 100 + F.col("turn")).cast("string").alias("uuid"))
    child = u.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("offset"), "uuid")
    return sessions.divergence(child, u.where("conv_id % 2 = 0 and turn < 4").select("uuid"))


@query("""WITH e AS (SELECT conv_id, count(*) AS entries, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS messages, count(*) FILTER (WHERE role = 'user') AS prompts, count(*) FILTER (WHERE role = 'assistant') AS said,
trim(min_by(text, turn) FILTER (WHERE role = 'user')) AS first FROM conversations GROUP BY conv_id)
SELECT '/t/' || conv_id AS path, entries, messages, (CASE WHEN messages = 0 THEN true ELSE (prompts = 1 AND coalesce(first, '') = 'Warmup') OR (said = 0 AND entries <= 3) END) AS trivial FROM e""")
def flt_trivial(spark, sf_dir):
    """Sessions that nobody would look for again."""
    c = table(spark, sf_dir, "conversations").withColumn("path", F.concat(F.lit("/t/"), F.col("conv_id").cast("string")))
    none, no = F.lit(None).cast("string"), F.lit(False)
    e = c.select("path", F.col("turn").alias("line_no"), F.col("role").alias("type"), "text", no.alias("is_meta"), no.alias("is_tool_result"), none.alias("custom_title"), none.alias("summary"), none.alias("queue_content"), F.lit(0).alias("tool_uses"), none.alias("model"))
    sizes = c.select("path").distinct().select("path", F.lit(1_000).alias("size"), F.lit(0).alias("mtime_ms"))
    return sessions.session_facts(e, sizes).select("path", "entries", "messages", "trivial")


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(coalesce(text, '')) - 1 AS pos FROM conversations)
SELECT '/t/' || conv_id AS path, pos::BIGINT AS "offset", text FROM t WHERE role = 'user' AND turn % 3 <> 1 AND trim(text) NOT IN ('', 'Warmup')""")
def scan_prompts(spark, sf_dir):
    """What users asked and where it begins, in bytes; meta entries (here each third turn) don't count."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    e = c.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string")).alias("path"), F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).alias("offset"), F.col("role").alias("type"), "text", (F.col("turn") % 3 == 1).alias("is_meta"), F.lit(False).alias("is_tool_result"))
    return sessions.prompts(e).select("path", "offset", "text")


@query("""WITH f AS (SELECT DISTINCT conv_id FROM conversations) SELECT '/t/' || conv_id AS path, (conv_id + 5)::BIGINT AS mtime_ms, CASE WHEN conv_id % 3 = 2 THEN 4 ELSE 12 END::BIGINT AS size,
CASE WHEN conv_id % 3 = 2 THEN 4 ELSE 8 END::BIGINT AS "offset" FROM f""")
def src_incremental(spark, sf_dir):
    """States after a round: files that grew by a line and a half one, that are new, and that shrank."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    path, rest = F.concat(F.lit("/t/"), F.col("conv_id").cast("string")), F.col("conv_id") % 3
    value = F.when(rest == 2, "new\n").otherwise("one\ntwo\nhalf")
    files = c.select(path.alias("path"), value.alias("value"))
    listing = c.select(path.alias("path"), (F.col("conv_id") + 5).alias("mtime_ms"), F.length(value).cast("long").alias("size"))
    state = c.where("conv_id % 3 > 0").select(path.alias("path"), F.col("conv_id").alias("mtime_ms"), F.when(rest == 1, 4).otherwise(30).cast("long").alias("size"), F.when(rest == 1, 4).otherwise(30).cast("long").alias("offset"))
    return transcripts.next_state(state, listing, transcripts.new_lines(files, state))


@query(M + """, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_seq) > 1 AS before FROM messages WHERE retrieval_class = 'hot')
SELECT session_id, count(*) AS made FROM p WHERE trim(message_text) <> '' AND (length(message_text) >= 50 OR before) GROUP BY session_id""")
def drain(spark, sf_dir):
    """Vectors for all messages that wait, sweep by sweep."""
    m = views.messages(spark, sf_dir)
    none = spark.createDataFrame([], "message_id string, embedding_q8 array<int>, norm double, quant_scale double, embed_version int")
    made, _ = embedding.drain(m, none, length_embedder, batch=2_000)
    return made.join(m.select("message_id", "session_id"), "message_id").groupBy("session_id").agg(F.count("*").alias("made"))


def _stated(spark, names: str, *rows):
    return spark.createDataFrame(list(rows), names)


@query("SELECT * FROM (VALUES ('x-y-z', 'x y-z'), ('\"a-b\" c_d', '\"a-b\" c d'), ('-a b-', '-a b-'), ('foo_bar-baz', 'foo bar baz')) AS t(raw, text)")
def fts_normalize(spark, sf_dir):
    from threadloom.functions.query_text import joined_words

    raw = ("x-y-z", '"a-b" c_d', "-a b-", "foo_bar-baz")
    return _stated(spark, "raw string, text string", *((x, joined_words(x)) for x in raw))


@query("SELECT * FROM (VALUES (0, 'The >>>Licensed<<< >>>Clown<<<, again'), (1, 'no match here'), (2, '')) AS t(i, match_snippet)")
def fts_snippet(spark, sf_dir):
    """Short texts in whole, with the words that the stems of a query match marked."""
    from threadloom.functions.query_text import Or, Phrase
    from threadloom.operators.fulltext import with_snippet

    texts = _stated(spark, "i int, message_text string", (0, "The Licensed Clown, again"), (1, "no match here"), (2, ""))
    return with_snippet(texts, Or((Phrase(("licens",)), Phrase(("clown",)))), stems=True).drop("message_text")


@query("""SELECT * FROM (VALUES (0, 3, 'a' || chr(10) || 'b'), (1, 2, ''), (2, 0, 'plain'), (3, 0, ''), (4, 7, 'x'), (5, 1, 'joined')) AS t(i, code, body)""")
def parse_exec_header(spark, sf_dir):
    """Exit codes and bodies of outputs in both formats, without one, empty, and as items."""
    outputs = ("Process exited with code 3\nOutput:\na\nb", "Exit code: 2\nno body", "plain", "", "took 1s\nExit code: 7\nOutput:\nx", '[{"type":"t","text":"Exit code: 1"},{"text":""},{"text":"Output:\\njoined"}]')
    df = _stated(spark, "i int, output string", *enumerate(outputs))
    code, body = codex.exec_result(codex.output_text(F.col("output")))
    return df.select("i", code.alias("code"), body.alias("body"))


@query("""SELECT * FROM (VALUES (0, 'text', 'hi', NULL, NULL), (2, 'image', NULL, 'image/png', 'QQ=='), (3, 'image', NULL, NULL, 'http://x')) AS t(n, type, text, media_type, data)""")
def adapt_content_items(spark, sf_dir):
    items = '[{"type":"input_text","text":"hi"},{"type":"output_text","text":""},{"type":"input_image","image_url":"data:image/png;base64,QQ=="},{"type":"input_image","image_url":"http://x"},{"type":"odd","text":"x"}]'
    df = _stated(spark, "content string", (items,))
    kept = F.posexplode(codex.content_items(F.col("content")))
    return df.select(kept.alias("p", "b")).select(F.element_at(F.array(F.lit(0), F.lit(2), F.lit(3)), F.col("p") + 1).alias("n"), "b.*")


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity * 100 / 50)::BIGINT AS percent, ((l_quantity * 2 >= 11)::INT + (l_quantity * 2 >= 21)::INT + (l_quantity * 2 >= 41)::INT + (l_quantity * 2 >= 61)::INT + (l_quantity * 2 >= 81)::INT)::INT AS band FROM lineitem")
def agg_ctx_pct(spark, sf_dir):
    """The share of a window in use and its band, of the quantities as if they were tokens."""
    percent, band = sessions.context_share(F.col("l_quantity"), 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", percent, band)


@query(f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {EPOCH} + doc_id * 60000 AS ts FROM documents)
SELECT source AS session, 'f' || doc_id % 7 || '.py' AS file, t AS content, ts FROM d WHERE doc_id % 4 < 2 UNION ALL SELECT source, 'f' || doc_id % 7 || '.py', x, ts FROM d, (SELECT unnest(['one', 'two']) AS x) WHERE doc_id % 4 = 2""")
def src_edits(spark, sf_dir):
    """Edits of three tools made of the documents; every fourth is outside the folder."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    kind, none = F.col("doc_id") % 4, F.lit(None).cast("string")
    file = F.concat(F.when(kind == 3, "/other/f").otherwise("/w/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))
    name = F.element_at(F.array(F.lit("Edit"), F.lit("Write"), F.lit("MultiEdit"), F.lit("Write")), (kind + 1).cast("int"))
    two = F.array(F.struct(F.lit("one").alias("new_string")), F.struct(F.lit("two").alias("new_string")))
    args = F.struct(file.alias("file_path"), F.when(kind == 0, F.col("t")).alias("new_string"), F.when(kind.isin(1, 3), F.col("t")).alias("content"), F.when(kind == 2, two).alias("edits"))
    block = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), args.alias("input"))
    ts = F.date_format(F.timestamp_millis(F.lit(EPOCH) + F.col("doc_id") * 60_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = _json(type=F.lit("assistant"), timestamp=ts, message=F.struct(F.lit("assistant").alias("role"), F.array(block).alias("content")))
    lines = d.select(F.concat(F.lit("/t/"), "source", F.lit(".jsonl")).alias("path"), F.col("doc_id").alias("line_no"), value.alias("value"), none.alias("offset"))
    return transcripts.session_edits(lines, "/w")


@query("SELECT conv_id, 's' || conv_id AS a, '01234567-89ab-cdef-0123-' || lpad(conv_id::VARCHAR, 12, '0') AS b FROM (SELECT DISTINCT conv_id FROM conversations)")
def src_glob(spark, sf_dir):
    """Session ids that paths of both vendors tell."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n = F.col("conv_id").cast("string")
    a = F.concat(F.lit("/home/x/projects/p/s"), n, F.lit(".jsonl"))
    b = F.concat(F.lit("/home/x/sessions/2024/01/02/rollout-2024-01-02T03-04-05-01234567-89ab-cdef-0123-"), F.lpad(n, 12, "0"), F.lit(".jsonl"))
    return c.select("conv_id", transcripts.session_of(a).alias("a"), transcripts.session_of(b).alias("b"))


@query(_CODEX + " SELECT path, count(*) * 5 + 2 AS lines FROM s GROUP BY path")
def src_jsonl_b(spark, sf_dir):
    """Envelopes that parse."""
    return transcripts.parse_lines(codex_lines(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("lines"))

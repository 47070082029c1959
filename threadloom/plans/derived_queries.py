"""Queries of functions on single texts, over what is derived from the given tables; and of the store's status and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.query_text import clean, joined_words
from threadloom.operators import attribution, blame, formatting, messages
from threadloom.plans import storage, views
from threadloom.plans.registry import _WAIT, _vectors_cte, query
from threadloom.plans.views import doc_messages, table
from threadloom.sources import codex, sessions, tail, transcripts
from threadloom.streaming import ingest

_TOOLS = [*transcripts.TOOL_CATEGORIES, "mcp__github__list", "exec_command", "Unheard"]

_TOOL_SQL = """WITH n AS (SELECT ['Read', 'Write', 'Edit', 'MultiEdit', 'Bash', 'Grep', 'Glob', 'LS', 'Task', 'Agent', 'TaskOutput', 'TaskStop', 'WebFetch', 'WebSearch', 'NotebookEdit', 'TodoWrite',
'EnterPlanMode', 'ExitPlanMode', 'AskUserQuestion', 'Skill', 'EnterWorktree', 'ListMcpResources', 'ReadMcpResource', 'mcp__github__list', 'exec_command', 'Unheard'] AS names),
t AS (SELECT names[(conv_id * 7 + turn) % 26 + 1] AS name FROM conversations, n)
SELECT name, count(*) AS calls, CASE WHEN name = 'Read' THEN 'file_read' WHEN name = 'Write' THEN 'file_write' WHEN name IN ('Edit', 'MultiEdit') THEN 'file_edit' WHEN name = 'Bash' THEN 'shell'
WHEN name IN ('Grep', 'Glob', 'LS', 'WebSearch') THEN 'search' WHEN name IN ('Task', 'Agent', 'TaskOutput', 'TaskStop') THEN 'agent' WHEN name = 'WebFetch' THEN 'browser' WHEN name = 'NotebookEdit' THEN 'notebook'
WHEN name IN ('TodoWrite', 'EnterPlanMode', 'ExitPlanMode') THEN 'planning' WHEN name IN ('AskUserQuestion', 'Skill') THEN 'interaction'
WHEN name IN ('ListMcpResources', 'ReadMcpResource') OR starts_with(name, 'mcp__') THEN 'mcp' ELSE 'other' END AS category, CASE name WHEN 'exec_command' THEN 'Bash' ELSE name END AS tool FROM t GROUP BY name"""


@query(_TOOL_SQL)
def tool_category(spark, sf_dir):
    """Calls by tool: each turn of a conversation calls one of the known tools, of a server's, or of none."""
    c = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*map(F.lit, _TOOLS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(_TOOLS) + 1).cast("int"))
    calls = c.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("calls"))
    return calls.select("name", "calls", transcripts.tool_category(F.col("name")).alias("category"), transcripts.tool_name(F.col("name")).alias("tool"))


@query(_vectors_cte(50) + _WAIT + """ SELECT (SELECT count(*) FROM doc_messages WHERE retrieval_class = 'hot') AS message_count, (SELECT count(*) FROM doc_messages WHERE retrieval_class <> 'hot') AS agent_message_count,
(SELECT max(created_at) FROM doc_messages) AS last_ingest, (SELECT count(*) FROM doc_messages WHERE retrieval_class = 'hot' AND trim(message_text) <> '') AS total_messages,
(SELECT count(*) FROM wait) AS gap_count, (SELECT count(*) FROM vectors) AS vectors, (SELECT count(*) FROM vectors WHERE embed_version = 3) AS current,
(SELECT count(*) FROM vectors WHERE embed_version <> 3) AS stale, (SELECT count(*) FILTER (WHERE embed_version = 3) / count(*) FROM vectors) AS coverage""")
def agg_status_report(spark, sf_dir):
    return messages.status_report(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir))


_HOOKS = """WITH c AS (SELECT DISTINCT conv_id AS i FROM conversations),
f AS (SELECT i, '/t/codex/rollout-x-' || CASE WHEN i % 4 = 0 THEN 'nothing' ELSE '01234567-89ab-cdef-0123-' || lpad(i::VARCHAR, 12, '0') END || '.jsonl' AS path, 'h' || i AS session_id,
  CASE WHEN i % 2 = 0 THEN 'agent-name-' || i END AS hook_agent FROM c)"""


def _hooked(spark, sf_dir):
    """A file of the second vendor for each conversation: every second told by a hook as a sub-agent's, every fourth without an id in its name."""
    i = F.col("conv_id")
    name = F.when(i % 4 == 0, "nothing").otherwise(F.concat(F.lit("01234567-89ab-cdef-0123-"), F.lpad(i.cast("string"), 12, "0")))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.concat(F.lit("/t/codex/rollout-x-"), name, F.lit(".jsonl")).alias("path"), F.lit("codex").alias("vendor"), F.concat(F.lit("h"), i.cast("string")).alias("session_id"),
        F.when(i % 2 == 0, F.concat(F.lit("agent-name-"), i.cast("string"))).alias("hook_agent"), F.when(i % 2 == 0, "parent").alias("hook_session"),
        none.alias("meta_id"), none.alias("meta_parent"),
    )


def _classed(spark, sf_dir):
    return sessions.classify_all(_hooked(spark, sf_dir), spark.createDataFrame([], "transcript_path string, kind string, session_id string, parent_session_id string"))


@query(_HOOKS + """, k AS (SELECT *, CASE WHEN i % 4 <> 0 THEN regexp_extract(path, 'rollout-x-(.*)[.]jsonl', 1) ELSE 'rollout-x-nothing' END AS s FROM f WHERE i % 4 <> 0)
SELECT unnest(CASE WHEN hook_agent IS NULL THEN [session_id] ELSE [hook_agent, session_id] END) AS alias_id, s AS session_id, CASE WHEN hook_agent IS NULL THEN 'default-root' ELSE 'hook' END AS source FROM k""")
def ingest_aliases(spark, sf_dir):
    """The names that lead to a session, as a scan writes them; files whose id nothing tells have none."""
    return ingest.alias_rows(_classed(spark, sf_dir).where("not unresolvable"))


@query(_HOOKS + " SELECT count(*) FILTER (WHERE i % 4 = 0) AS unresolvable, count(*) FILTER (WHERE i % 2 = 0 AND i % 4 <> 0) AS agents, count(*) FILTER (WHERE i % 2 = 1) AS roots FROM f")
def classify_unresolvable(spark, sf_dir):
    c = _classed(spark, sf_dir)
    left = ~F.col("unresolvable")
    return c.agg(F.count_if("unresolvable").alias("unresolvable"), F.count_if(left & (F.col("kind") == "agent")).alias("agents"), F.count_if(left & (F.col("kind") == "root")).alias("roots"))


_WORDS = """WITH w AS (SELECT item_id, list_distinct(list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 4)) AS d, list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 4) AS l FROM benchmark),
o AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM w)"""


def _typed(spark, sf_dir):
    """The first words of every item, each once, in order."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1), 1, 4)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words).alias("l"))


@query(_WORDS + """ SELECT item_id, CASE len(l) WHEN 0 THEN NULL WHEN 1 THEN l[1] WHEN 2 THEN '"' || l[1] || '" "' || l[2] || '"' ELSE '"' || array_to_string(l, '" OR "') || '"' END AS expression FROM o""")
def fts_sanitize_items(spark, sf_dir):
    """What is looked for when the first words of an item are typed: one as it is, two together, more in any number."""
    cleaned = F.udf(lambda x: clean(x), "string")  # a query is cleaned where it is typed; here each item types one
    return _typed(spark, sf_dir).select("item_id", cleaned(F.array_join("l", " ")).alias("expression"))


@query(_WORDS + " SELECT item_id, array_to_string(l, ' ') AS text FROM o")
def fts_normalize_items(spark, sf_dir):
    """Words joined by hyphens and underscores are typed apart."""
    apart = F.udf(lambda x: joined_words(x), "string")
    two = _typed(spark, sf_dir).withColumn("raw", F.array_join(F.transform("l", lambda x, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "-").otherwise("_"), x)), ""))
    return two.select("item_id", apart("raw").alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN 0 ELSE turn END::INT AS code, sha256(CASE WHEN conv_id % 3 = 2 THEN 'said ' || text ELSE text END) AS body
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def parse_exec_header_turns(spark, sf_dir):
    """Exit codes and bodies of outputs in both formats and without a header, whose bodies are the turns' texts."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n, body = F.col("turn").cast("string"), F.concat(F.lit("\nOutput:\n"), F.col("text"))
    output = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Process exited with code "), n, body)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("took 1s\nExit code: "), n, body)).otherwise(F.concat(F.lit("said "), F.col("text")))
    code, rest = codex.exec_result(codex.output_text(output))
    return c.select("conv_id", "turn", code.alias("code"), F.sha2(rest, 256).alias("body"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, 'text' AS type, sha256(text) AS text, NULL::VARCHAR AS media_type, NULL::VARCHAR AS data FROM c WHERE text <> ''
UNION ALL SELECT conv_id, turn, 'image', NULL, CASE WHEN turn % 2 = 0 THEN 'image/png' END, CASE WHEN turn % 2 = 0 THEN 'QQ' || turn ELSE 'http://x/' || turn END FROM c""")
def adapt_content_items_turns(spark, sf_dir):
    """Every turn as items: its text, an image (as data or by address) and one of an unknown type."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.col("turn").cast("string")
    url = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data:image/png;base64,QQ"), n)).otherwise(F.concat(F.lit("http://x/"), n))
    none = F.lit(None).cast("string")
    item = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image_url"))
    items = F.to_json(F.array(item("input_text", F.col("text"), none), item("input_image", none, url), item("odd", F.col("text"), none)))
    kept = c.select("conv_id", "turn", F.explode(codex.content_items(items)).alias("b")).select("conv_id", "turn", "b.*")
    return kept.withColumn("text", F.sha2("text", 256))


@query("""SELECT name, count(*) AS n FROM (SELECT unnest(CASE conv_id % 4 WHEN 0 THEN ['file_read_input', 'file_write_input'] WHEN 1 THEN ['bash_input'] WHEN 2 THEN ['skill_input'] ELSE ['error_result'] END) AS name FROM conversations) WHERE name <> 'file_read_input' GROUP BY name""")
def type_guards_turns(spark, sf_dir):
    """Which shapes the turns have, as files to write, commands, skills and errors."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    of = lambda **parts: F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
    quoted = F.regexp_extract(of(x=text), r'(?s)^\{"x":(.*)\}$', 1)
    json = F.element_at(F.array(of(file_path=text, content=text), of(command=text), of(skill=text), quoted), (F.col("conv_id") % 4 + 1).cast("int"))
    names = ("file_write_input", "bash_input", "skill_input", "error_result", "web_fetch_input", "grep_input")
    each = F.array(*(F.when(formatting.has_shape(F.col("json"), n), n) for n in names))
    return c.select(json.alias("json")).select(F.explode(each).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/' || source || ':x' ELSE 'src/' || source END AS path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::INT END AS first_line,
CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN doc_id::INT ELSE (doc_id + 5)::INT END AS last_line FROM documents""")
def attr_spec_files(spark, sf_dir):
    """Paths, lines and ranges of lines that name a place in each document's source."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    tail = F.element_at(F.array(F.lit("x"), i, F.concat_ws("-", i, (F.col("doc_id") + 5).cast("string"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path, first, last = attribution.spec_parts(F.concat(F.lit("src/"), F.col("source"), F.lit(":"), tail))
    return d.select("doc_id", path.alias("path"), first.alias("first_line"), last.alias("last_line"))


@query("""WITH c AS (SELECT source AS file, 'c' || doc_id AS owner, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS r FROM documents),
l AS (SELECT file, 2 * r + 2 AS line_no, owner FROM c UNION ALL SELECT a.file, 2 * a.r + 1, coalesce(b.owner, a.owner) FROM c a LEFT JOIN c b ON b.file = a.file AND b.r = a.r - 1)
SELECT file, owner, count(*) AS lines, min(line_no)::BIGINT AS first_line, max(line_no)::BIGINT AS last_line FROM l GROUP BY file, owner""")
def attr_line_owners(spark, sf_dir):
    """Each document is a commit to its source's file: two lines at the top, and another in place of the line that was first."""
    d = table(spark, sf_dir, "documents")
    diff = F.concat(
        F.lit("diff --git a/x b/x\n--- a/"), "source", F.lit("\n+++ b/"), "source", F.lit("\n@@ -0,0 +1,2 @@\n+one\n+two\n"),
        F.when(F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) > 1, F.lit("@@ -1 +3 @@\n-one\n+three\n")).otherwise(F.lit("")),
    )
    diffs = d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"), F.col("doc_id").alias("ord"), diff.alias("diff"))
    return blame.line_owners(diffs).groupBy("file", "owner").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS digest, (conv_id * 31 + turn)::VARCHAR AS mark FROM conversations")
def src_tail_bytes(spark, sf_dir):
    """Every turn as a line of a file, met in two looks: when each file had half of its bytes, and when it had all. No byte is read by both but a half line's."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5(F.coalesce("text", F.lit(""))), (F.col("conv_id") * 31 + F.col("turn")).cast("string"))
    root = storage.scratch(spark, "transcripts")
    c.select(line.alias("value")).write.text(root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root)
    whole = files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    state, looks = spark.createDataFrame([], tail.STATE), []
    for listing in (whole.select("path", (F.col("mtime_ms") - 1).alias("mtime_ms"), F.floor(F.col("size") / 2).alias("size")), whole):
        ranges = storage.written(tail.to_read(listing, state, 1 << 20), "ranges")
        looks.append(storage.written(tail.read_new(ranges), "lines"))
        state = storage.written(tail.state_after(listing, state, ranges, looks[-1]), "state")
    part = F.split("value", " ")
    return looks[0].unionByName(looks[1]).select(part[0].cast("long").alias("conv_id"), part[1].cast("int").alias("turn"), part[2].alias("digest"), part[3].alias("mark"))

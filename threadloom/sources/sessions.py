"""What a transcript tells about its session: class, label, triviality, turns, patches, names derived from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First lines of sessions that tools start for themselves, and the session-id forms.
TOOL_OPENINGS = ("Consider this entire conversation so far.", "## Opening turns", "You are a project tracker.", "You are a memory recall agent.")
SESSION_FORMS = r"(?i)^(?:[0-9a-f]{8}[0-9a-f-]{0,28}|agent-[0-9a-f]+)$"
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
SMALL_FILE = 64 * 1024


def is_session_shaped(ref: Column) -> Column:
    """References of this form are read, others are searched for."""
    return F.regexp_like(ref, F.lit(SESSION_FORMS))


def project_slug(cwd: Column, narrow: bool = False) -> Column:
    return F.regexp_replace(cwd, r"[:/\\]" if narrow else "[^a-zA-Z0-9]", "-")


def url_path(path: Column, home: Column) -> Column:
    """Paths below the home folder as ``/~...``, drive letters below ``/``; ``#`` and ``?`` are escaped."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\\\\\?\\", ""), r"\\", "/")
    p, h = plain(path), plain(home)
    below = (F.lower(p) == F.lower(h)) | F.startswith(F.lower(p), F.concat(F.lower(h), F.lit("/")))
    out = F.when(below, F.concat(F.lit("/~"), F.substring(p, F.length(h) + 1, F.length(p)))).when(F.regexp_like(p, F.lit("^[A-Za-z]:/")), F.concat(F.lit("/"), p)).otherwise(p)
    return F.replace(F.replace(out, F.lit("#"), F.lit("%23")), F.lit("?"), F.lit("%3F"))


def classify(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, session_id, kind, parent_session_id, evidence): ``classify_all`` without the aliases, of files that can be resolved."""
    return classify_all(files, stored).where("not unresolvable").drop("aliases", "unresolvable")


def classify_all(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, session_id, kind, parent_session_id, evidence, aliases, unresolvable) of ``files`` (path, vendor, session_id, hook_agent, hook_session, meta_id, meta_parent).

    What is stored for a path counts first, unless a hook now says sub-agent; then the path, the name, the hook, and for the
    second vendor the file's own meta data. Whatever tells nothing is a root session. Aliases are the hook's name of the agent and the id
    that the caller proposed, where they differ from the session's. A sub-agent of the second vendor whose id nothing tells is unresolvable: it
    is never given its parent's, and whoever ingests leaves it out.
    """
    known = stored.select(F.col("transcript_path").alias("path"), F.col("kind").alias("_kind"), F.col("session_id").alias("_session"), F.col("parent_session_id").alias("_parent"))
    f = files.join(known, "path", "left").withColumn("_base", F.regexp_extract("path", r"([^/\\]+?)(?:\.jsonl)?$", 1))
    hooked, claude = F.col("hook_agent").isNotNull(), F.col("vendor") == "claude"
    agent_name = F.col("_base").startswith("agent-")
    by_store = F.col("_kind").isNotNull() & ~((F.col("_kind") != "agent") & hooked)
    by_path = claude & F.contains("path", F.lit("/subagents/")) & agent_name
    by_name = claude & (agent_name | F.col("session_id").startswith("agent-"))
    by_meta = ~claude & F.col("meta_parent").isNotNull()
    parent_folder = F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/", 1), F.lit(""))
    uuid = F.nullif(F.regexp_extract("path", rf"rollout-.*?({_UUID})", 1), F.lit(""))
    codex_id = F.coalesce(F.nullif(F.col("meta_id"), F.lit("")), uuid, F.col("session_id"))
    case = F.when(by_store, "stored").when(by_path, "path").when(by_name, "name").when(by_meta, "meta").when(hooked, "hook").otherwise("default-root")
    f = f.withColumn("evidence", case)
    is_ = lambda *names: F.col("evidence").isin(*names)
    kind = F.when(is_("stored"), F.when(F.col("_kind") == "agent", "agent").otherwise("root")).when(is_("default-root"), "root").otherwise("agent")
    session = (
        F.when(is_("stored"), F.col("_session")).when(~claude, codex_id)
        .when(is_("path", "hook") | (is_("name") & agent_name), F.col("_base")).otherwise(F.col("session_id"))
    )
    parent = F.when(is_("stored"), F.col("_parent")).when(is_("path"), F.coalesce(parent_folder, F.col("hook_session"))).when(is_("meta"), F.col("meta_parent")).when(is_("name", "hook"), F.col("hook_session"))
    lost = ~claude & is_("meta", "hook") & F.coalesce(F.nullif(F.col("meta_id"), F.lit("")), uuid).isNull() & ~F.regexp_like("session_id", F.lit(rf"(?i)^{_UUID}$"))
    session = F.when(lost, F.col("_base")).otherwise(session)
    named = F.array(F.when(hooked, F.nullif(F.col("hook_agent"), F.lit(""))), F.nullif(F.col("session_id"), F.lit("")))
    aliases = F.when(lost, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(named, lambda a: a.isNotNull() & (a != session))))
    return f.select("path", session.alias("session_id"), kind.alias("kind"), parent.alias("parent_session_id"), "evidence", aliases.alias("aliases"), lost.alias("unresolvable"))


def session_facts(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per file: label, message and tool counts, last assistant text and model, etag, and whether the session is trivial.

    ``entries``: (path, line_no, type, text, is_meta, is_tool_result, custom_title, summary, queue_content, tool_uses, model);
    ``sizes``: (path, size, mtime_ms).
    """
    message = F.col("type").isin("user", "assistant") & ~F.coalesce("is_meta", F.lit(False))
    prompt = message & (F.col("type") == "user") & ~F.coalesce("is_tool_result", F.lit(False))
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("line_no")))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("line_no")))
    text = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    facts = entries.groupBy("path").agg(
        first(F.col("custom_title"), F.col("type") == "custom-title").alias("_title"), first(F.col("summary"), F.col("type") == "summary").alias("_summary"),
        first(text, message & (F.col("type") == "user")).alias("_first"), F.count("*").alias("entries"), F.count_if(message).alias("messages"),
        F.count_if(prompt).alias("prompts"), F.count_if(message & (F.col("type") == "assistant")).alias("_assistant"), F.coalesce(F.sum("tool_uses"), F.lit(0)).alias("tool_uses"),
        first(F.trim("text"), prompt).alias("_prompt"), first(F.col("queue_content"), (F.col("type") == "queue-operation") & F.col("queue_content").isNotNull()).alias("_queue"),
        last(F.substring("text", 1, 200), (F.col("type") == "assistant") & (F.coalesce("text", F.lit("")) != "")).alias("last_response"), last(F.col("model"), F.col("model").isNotNull()).alias("model"),
    )
    own = F.lit(False)
    for opening in TOOL_OPENINGS:
        own = own | F.coalesce(F.startswith("_queue", F.lit(opening)), F.lit(False))
    f = sizes.join(facts, "path", "left")
    n = F.coalesce("entries", F.lit(0))
    trivial = (
        F.when(n == 0, F.col("size") == 0).when(F.col("messages") == 0, F.col("size") <= SMALL_FILE)
        .otherwise(((F.col("prompts") == 1) & (F.col("_prompt") == "Warmup")) | ((F.col("_assistant") == 0) & (n <= 3)) | own)
    )
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    label = F.coalesce(named("_title"), named("_summary"), named("_first"), F.lit("No prompt"))
    etag = F.substring(F.md5(F.concat_ws(":", F.col("mtime_ms").cast("string"), F.col("size").cast("string"), n.cast("string"))), 1, 8)
    return f.select("path", label.alias("label"), n.alias("entries"), F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("tool_uses", F.lit(0)).alias("tool_uses"), "last_response", "model", etag.alias("etag"), F.coalesce(trivial, F.lit(False)).alias("trivial"))


def content_counts(entries: DataFrame) -> DataFrame:
    """Per file: tool_uses, messages (user and assistant, no meta), children (ids of the sub-agents that results name), and whether it is a side chain.

    ``entries``: (path, line_no, type, is_meta, is_sidechain, content, kind, result_agent).
    """
    blocks = F.from_json("content", "array<struct<type:string>>")
    uses = F.when(F.col("kind").startswith("ARRAY"), F.size(F.filter(blocks, lambda b: b["type"] == "tool_use"))).otherwise(0)
    message = F.col("type").isin("user", "assistant") & ~F.coalesce("is_meta", F.lit(False))
    child = F.when((F.col("type") == "user") & (F.coalesce("result_agent", F.lit("")) != ""), F.concat(F.lit("agent-"), F.col("result_agent")))
    return entries.groupBy("path").agg(
        F.coalesce(F.sum(uses), F.lit(0)).alias("tool_uses"), F.count_if(message).alias("messages"), F.array_sort(F.collect_set(child)).alias("children"),
        F.coalesce(F.min_by("is_sidechain", "line_no"), F.lit(False)).alias("sidechain"),
    )


def prompts(entries: DataFrame) -> DataFrame:
    """Entries (type, text, is_meta, is_tool_result) in which a user asks something: no meta entries, tool results, warm-ups, blanks."""
    asked = (F.col("type") == "user") & ~F.coalesce("is_meta", F.lit(False)) & ~F.coalesce("is_tool_result", F.lit(False))
    return entries.where(asked & ~F.trim(F.coalesce("text", F.lit(""))).isin("", "Warmup"))


def turns(entries: DataFrame, cap: int = 8_192, preview: int = 200) -> DataFrame:
    """Per user prompt (path, turn): offset, prompt, the assistant text until the next prompt, and the start of its last part.

    ``entries``: (path, line_no, offset, type, text). A turn is a running count of prompts; texts are capped.
    """
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    user = (F.col("type") == "user") & (F.coalesce("text", F.lit("")) != "") & (F.trim("text") != "Warmup")
    e = entries.where(F.col("type").isin("user", "assistant")).withColumn("turn", F.sum(user.cast("int")).over(w)).where(F.col("turn") > 0)
    said = F.col("type") == "assistant"
    parts = F.sort_array(F.collect_list(F.when(said & (F.col("text") != ""), F.struct("line_no", "text"))))
    t = e.groupBy("path", "turn").agg(F.min("offset").alias("offset"), F.min_by("text", "line_no").alias("_p"), parts.alias("_parts"))
    texts = F.transform("_parts", lambda x: x["text"])
    return t.select("path", "turn", "offset", F.substring("_p", 1, cap).alias("prompt"), F.substring(F.array_join(texts, "\n\n"), 1, cap).alias("response"), F.substring(F.try_element_at("_parts", F.lit(-1))["text"], 1, preview).alias("preview"))


def divergence(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Per child file: where the first user entry that the parent doesn't have begins, and the last shared uuid before it.

    ``child``: (path, offset, uuid) of user entries; ``parent``: (uuid).
    """
    c = child.join(parent.select("uuid", F.lit(True).alias("_shared")).distinct(), "uuid", "left")
    fork = c.groupBy("path").agg(F.min(F.when(F.col("_shared").isNull(), F.col("offset"))).alias("fork_offset"))
    before = c.join(fork, "path").where(F.col("_shared") & (F.col("fork_offset").isNull() | (F.col("offset") < F.col("fork_offset"))))
    return fork.join(before.groupBy("path").agg(F.max_by("uuid", "offset").alias("last_shared")), "path", "left")


def patch_changes(patches: DataFrame) -> DataFrame:
    """(id, change_no, path, kind, old, new) of ``patches`` (id, patch): one row for each file section of a patch text."""
    lines = patches.select("id", F.posexplode(F.split("patch", "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^\*\*\* (Update|Add|Delete) File:\s*(.+)$", 1)
    lines = lines.withColumn("_kind", F.nullif(F.lower(head), F.lit(""))).withColumn("_path", F.trim(F.regexp_extract("line", r"^\*\*\* (Update|Add|Delete) File:\s*(.+)$", 2)))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("change_no", F.sum(F.col("_kind").isNotNull().cast("int")).over(w)).where(F.col("change_no") > 0)
    sign, rest = F.substring("line", 1, 1), F.expr("substring(line, 2)")
    body = F.col("_kind").isNull() & ~F.col("line").startswith("*** Begin Patch") & ~F.col("line").startswith("*** End Patch") & ~F.col("line").startswith("@@")
    side = lambda *signs: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(body & sign.isin(*signs), F.struct("n", rest.alias("t"))))), lambda x: x["t"]), "\n")
    return s.groupBy("id", "change_no").agg(F.max("_path").alias("path"), F.max("_kind").alias("kind"), side("-", " ").alias("old"), side("+", " ").alias("new"))


def context_share(tokens: Column, window: int) -> tuple[Column, Column]:
    """Percent of the context window in use, and its colour band from 0 to 5."""
    pct = F.floor(tokens * 100 / F.lit(window))
    return pct.alias("percent"), sum(((pct >= b).cast("int") for b in (11, 21, 41, 61, 81)), F.lit(0)).alias("band")

"""Transcripts, merges, centred reading and streams."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import messages, semantic, store
from threadloom.plans import views
from threadloom.sources import transcripts
from threadloom.streaming import ingest

SCHEMA = "message_id string, session_id string, message_seq long, message_text string, project_id string, created_at long, message_role string, retrieval_class string"


def rows(spark, *data):
    return spark.createDataFrame([(m, s, q, t, None, 1000 + q, None, c) for m, s, q, t, c in data], SCHEMA)


@pytest.fixture
def root(tmp_path):
    def write(name, lines):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")

    turn = lambda kind, uuid, content, **more: {"type": kind, "uuid": uuid, "sessionId": "x", "timestamp": "2024-01-01T00:00:01Z", "cwd": "/w", "message": {"role": kind, "content": content}} | more
    edit = {"type": "tool_use", "name": "MultiEdit", "id": "t", "input": {"file_path": "/w/a.py", "edits": [{"new_string": "one"}, {"new_string": "two"}]}}
    write("claude/sess-1.jsonl", [turn("user", "u1", " hello "), "not json", "", turn("assistant", "u2", [{"type": "text", "text": " a "}, {"type": "text", "text": ""}, edit, {"type": "text", "text": "b"}]), turn("user", "u3", [{"type": "tool_result", "tool_use_id": "t"}]), {"type": "queue-operation"}, turn("user", "u4", "side", parentToolUseID="z"), turn("user", None, "gap"), turn("assistant", "u5", "end")])
    write("claude/p/subagents/agent-ab.jsonl", [turn("user", "v1", "leaf")])
    env = lambda kind, **p: {"timestamp": "2024-01-01T00:00:02Z", "type": kind, "payload": p}
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    write(f"codex/2024/01/01/rollout-2024-01-01T00-00-00-{uuid}.jsonl", [env("session_meta", id=uuid, cwd="/c"), env("response_item", type="message", role="user", content=[{"type": "input_text", "text": "ask"}]), env("response_item", type="function_call", call_id="k", name="exec_command", arguments="{}"), env("response_item", type="function_call_output", call_id="k", output="Exit code: 3\nOutput:\nboom"), env("response_item", type="function_call_output", call_id="lost", output="x"), env("turn_context", cwd="/d"), env("response_item", type="message", role="developer", content=[]), env("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "answer"}])])
    return tmp_path


def test_claude_messages(spark, root):
    lines = transcripts.read_lines(spark, f"{root}/claude")
    got = sorted((r.session_id, r.message_seq, r.message_id, r.message_text, r.project_id, r.message_role, r.retrieval_class) for r in transcripts.message_rows(transcripts.claude_entries(lines)).collect())
    assert got == [("agent-ab", 0, "v1", "leaf", "/w", "user", "agent"), ("sess-1", 0, "u1", "hello", "/w", "user", "hot"), ("sess-1", 1, "u2", "a\n\nb", "/w", "assistant", "hot"), ("sess-1", 3, "u5", "end", "/w", "assistant", "hot")]
    assert sorted((r.session, r.file, r.content, r.ts) for r in transcripts.session_edits(lines, "/w").collect()) == [("sess-1", "a.py", "one", 1704067201000), ("sess-1", "a.py", "two", 1704067201000)]


def test_codex_messages(spark, root):
    lines = transcripts.read_lines(spark, f"{root}/codex")
    e = transcripts.codex_entries(lines)
    got = sorted((r.message_id, r.message_text, r.project_id) for r in transcripts.message_rows(e).collect())
    assert got == [("codex-jsonl-01234567-0", "ask", "/c"), ("codex-jsonl-01234567-2", "answer", "/c")]
    assert [r.cwd for r in e.orderBy("line_no").collect()] == ["/c", "/c", "/d"]
    calls = {r.call_id: r for r in transcripts.tool_calls(lines).collect()}
    assert (calls["k"].tool, calls["k"].exit_code, calls["k"].body, calls["k"].orphan) == ("Bash", 3, "boom", False)
    assert calls["lost"].orphan


def test_listing_and_watermark(spark, root):
    listing = transcripts.list_files(spark, f"{root}/claude", "claude")
    none = spark.createDataFrame([], "path string, last_mtime long, last_size long, vendor string")
    assert {r.state for r in store.changed_files(listing, none).collect()} == {"new"}
    mark = spark.createDataFrame(store.advance_watermark(none, listing.where("path like '%sess-1%'")).collect(), none.schema)
    assert sorted(r.state for r in store.changed_files(listing, mark).collect()) == ["new", "unchanged"]
    with open(f"{root}/claude/sess-1.jsonl", "a") as f:
        f.write("{}\n")
    again = transcripts.list_files(spark, f"{root}/claude", "claude")
    assert sorted(r.state for r in store.changed_files(again, mark).collect()) == ["changed", "new"]


def test_tool_names(spark):
    df = spark.createDataFrame([("exec_command",), ("Edit",), ("mcp__x",), ("odd",)], "n string")
    got = [(r.a, r.b) for r in df.select(transcripts.tool_name(F.col("n")).alias("a"), transcripts.tool_category(F.col("n")).alias("b")).collect()]
    assert got == [("Bash", "other"), ("Edit", "file_edit"), ("mcp__x", "mcp"), ("odd", "other")]


def test_reclassify_only_goes_cold(spark):
    m = rows(spark, ("a", "s1", 0, "x", "hot"), ("b", "s2", 0, "y", "agent"))
    v = spark.createDataFrame([("a", [1], 1.0, 1.0, 3), ("b", [1], 1.0, 1.0, 3)], "message_id string, embedding_q8 array<tinyint>, norm double, quant_scale double, embed_version int")
    now, left = store.reclassify(m, v, spark.createDataFrame([("s1",)], "session_id string"))
    assert {r.message_id: r.retrieval_class for r in now.collect()} == {"a": "agent", "b": "agent"} and left.count() == 0
    assert {r.message_id: r.embed_version for r in store.insert_vectors(m, v.limit(0), v.withColumn("embed_version", F.lit(1))).collect()} == {"a": 3}


def test_replaced_sessions_and_first_write(spark):
    cur = rows(spark, ("a", "s1", 0, "old", "hot"), ("b", "s2", 0, "kept", "hot"))
    new = rows(spark, ("a", "s1", 0, "new", "hot"), ("b", "s1", 1, "late", "hot"))
    assert {r.message_id: r.message_text for r in store.insert_messages(cur, new).collect()} == {"a": "old", "b": "kept"}
    got = store.insert_messages(cur, new, spark.createDataFrame([("s1",)], "session_id string"))
    assert {r.message_id: r.message_text for r in got.collect()} == {"a": "new", "b": "kept"}


def test_embed_texts(spark):
    long = "sentence " * 80
    m = rows(spark, ("p", "s", 0, long, "hot"), ("short", "s", 1, "Running", "hot"), ("orphan", "t", 0, "ok", "hot"), ("cold", "u", 0, long, "agent"))
    none = spark.createDataFrame([], "message_id string, embed_version int")
    got = {r.message_id: r.embed_text for r in semantic.embed_queue(m, none).collect()}
    assert got == {"p": long, "short": long[-512:] + "\nRunning"}
    assert semantic.coverage(m, none).first().coverage == 1
    assert tuple(semantic.gap(m, none).first()) == (3, 2)


def centre(texts, at, budget, back_share=0.3, overhead=80):
    """The same by loops."""
    back = int(budget * back_share)
    fwd, cost = budget - back, [len(t) + overhead for t in texts]
    b = f = 0
    first, last = at, at - 1
    for i in range(at - 1, -1, -1):
        if b + cost[i] > back:
            break
        b, first = b + cost[i], i
    for i in range(at, len(texts)):
        if f + cost[i] > fwd and i > at:
            break
        f, last = f + cost[i], i
    if back > b:
        for i in range(last + 1, len(texts)):
            if f + cost[i] > fwd + back - b:
                break
            f, last = f + cost[i], i
    if fwd > f:
        for i in range(first - 1, -1, -1):
            if b + cost[i] > back + fwd - f:
                break
            b, first = b + cost[i], i
    return list(range(first, last + 1))


@pytest.mark.parametrize(("at", "budget"), [(0, 500), (5, 900), (9, 700), (4, 100), (5, 5000)])
def test_centred_equals_the_loops(spark, at, budget):
    texts = ["x" * (13 * i * i % 230) for i in range(10)]
    m = rows(spark, *((f"m{i}", "s", i, t, "hot") for i, t in enumerate(texts)))
    got = sorted(r.message_seq for r in messages.centred(m, "s", at, budget).collect())
    assert got == centre(texts, at, budget)


def test_ambiguous_and_unknown_references(spark):
    ids = spark.createDataFrame([("agent-a%1",), ("agent-ab",), ("Has_x",)], "session_id string")
    aliases = spark.createDataFrame([("agent-ab", "nick")], "session_id string, alias_id string")
    find = lambda r: sorted(x.session_id for x in messages.resolve(ids, aliases, r).collect())
    assert find("agent-a") == ["agent-a%1", "agent-ab"] and find("agent-a%") == ["agent-a%1"] and find("nick") == ["agent-ab"] and find("has") == [] and find("Has_") == ["Has_x"]


def test_ingest_stream_is_idempotent(spark, root, tmp_path):
    out = ingest.Versioned(spark, f"{tmp_path}/store", SCHEMA)
    src = rows(spark, ("a", "s", 0, "one", "hot"), ("b", "s", 1, "two", "hot"))
    src.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    ingest.ingest_stream(stream(), out, f"{tmp_path}/c1").awaitTermination()
    assert out.read().count() == 2
    ingest.ingest_stream(stream(), out, f"{tmp_path}/c2").awaitTermination()  # a replay from the start
    assert out.read().count() == 2 and out.version() == 2


def test_windows_stream_like_batches(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = ingest.run_to_table(ingest.event_windows(stream), "windows", f"{tmp_path}/c", "complete")
    key = lambda df: sorted((r.window_start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(ingest.event_windows(events))


def test_predecessors_across_chunks(spark, monkeypatch):
    """A session in many chunks, with gaps, repeated places and cold rows, against a loop; the plan orders ids alone."""
    monkeypatch.setattr(semantic, "CHUNK", 5)
    rows = [(f"m{i:03}", "s" if i % 3 else "t", i * 7 % 90, None if i == 8 else f"text {i}", "p", i, "user", "agent" if i % 10 == 9 else "hot") for i in range(60)]
    rows += [("m900", "s", rows[1][2], "same place", "p", 900, "user", "hot")]
    m = spark.createDataFrame(rows, "message_id string, session_id string, message_seq long, message_text string, project_id string, created_at long, message_role string, retrieval_class string")
    own = [r for r in rows if r[7] == "hot"]
    want = {}
    for r in own:
        before = [(x[2], x[0], x[3]) for x in own if x[1] == r[1] and x[2] < r[2]]
        want[r[0]] = (max(before)[2], True) if before else (None, False)
    got = {r.message_id: (r.prev_text, r.has_previous) for r in semantic.with_previous(m).collect()}
    assert got == want
    none = spark.createDataFrame([], "message_id string, embed_version int")
    plan = semantic.unembedded(m, none)._jdf.queryExecution().optimizedPlan().toString()
    assert all("message_text" not in line for line in plan.split("\n") if "Window" in line or "Join" in line)

"""Session classes, facts, patches, forks and names."""

from pyspark.sql import functions as F

from threadloom.sources import sessions


def test_classes(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    files = [
        ("/p/x/par/subagents/agent-1a.jsonl", "claude", "agent-1a", None, None, None, None), ("/p/x/agent-2b.jsonl", "claude", "zz", None, "hs", None, None),
        ("/p/x/plain.jsonl", "claude", "plain", None, None, None, None), ("/p/x/hooked.jsonl", "claude", "q", "h1", "hs", None, None),
        (f"/c/rollout-2024-{u}.jsonl", "codex", "q", None, None, None, None), ("/c/rollout-x.jsonl", "codex", "q", None, None, "m1", "par"),
        ("/s/a.jsonl", "claude", "new", None, None, None, None), ("/s/b.jsonl", "claude", "b", "h2", "hs", None, None),
    ]
    df = spark.createDataFrame(files, "path string, vendor string, session_id string, hook_agent string, hook_session string, meta_id string, meta_parent string")
    stored = spark.createDataFrame([("/s/a.jsonl", "agent", "old", "op"), ("/s/b.jsonl", "root", "b", None)], "transcript_path string, kind string, session_id string, parent_session_id string")
    got = {r.path: (r.session_id, r.kind, r.parent_session_id, r.evidence) for r in sessions.classify(df, stored).collect()}
    assert [got[f[0]] for f in files] == [
        ("agent-1a", "agent", "par", "path"), ("agent-2b", "agent", "hs", "name"), ("plain", "root", None, "default-root"), ("hooked", "agent", "hs", "hook"),
        (u, "root", None, "default-root"), ("m1", "agent", "par", "meta"), ("old", "agent", "op", "stored"), ("b", "agent", "hs", "hook"),
    ]


def facts(spark, rows, sizes):
    names = "path string, line_no int, type string, text string, is_meta boolean, is_tool_result boolean, custom_title string, summary string, queue_content string, tool_uses int, model string"
    e = spark.createDataFrame([(p, i, t, x, m, False, c, None, q, n, None) for p, i, t, x, m, c, q, n in rows], names)
    return {r.path: r for r in sessions.session_facts(e, spark.createDataFrame([(p, s, 5) for p, s in sizes.items()], "path string, size long, mtime_ms long")).collect()}


def test_facts(spark):
    rows = [
        ("a", 0, "user", "hello\nthere ", False, None, None, 0), ("a", 1, "assistant", "x" * 300, False, None, None, 2), ("w", 0, "user", "Warmup", False, None, None, 0), ("w", 1, "assistant", "ok", False, None, None, 0),
        ("t", 0, "custom-title", None, False, "Named", None, 0), ("t", 1, "user", "p", False, None, None, 0), ("t", 2, "assistant", "r", False, None, None, 0), ("s", 0, "user", "p", False, None, None, 0),
        ("q", 0, "queue-operation", None, False, None, "You are a project tracker. Go", 0), ("q", 1, "user", "p", False, None, None, 0), ("q", 2, "assistant", "r", False, None, None, 0), ("m", 0, "user", "meta", True, None, None, 0),
    ]
    got = facts(spark, rows, {"a": 10, "w": 10, "t": 10, "s": 10, "q": 10, "m": 70_000, "none": 0, "junk": 9})
    assert {p: r.trivial for p, r in got.items()} == {"a": False, "w": True, "t": False, "s": True, "q": True, "m": False, "none": True, "junk": False}
    assert (got["a"].label, got["t"].label, got["m"].label, got["a"].tool_uses, len(got["a"].last_response), len(got["a"].etag)) == ("hello there", "Named", "No prompt", 2, 200, 8)


def test_patches(spark):
    text = "*** Begin Patch\n*** Update File: a.py\n@@\n-old\n+new\n same\n*** Add File: b.py\n+one\n+two\n*** Delete File: c.py\n*** End Patch"
    df = spark.createDataFrame([("p", text), ("e", ""), ("n", None)], "id string, patch string")
    got = [(r.id, r.path, r.kind, r.old, r.new) for r in sessions.patch_changes(df).orderBy("id", "change_no").collect()]
    assert got == [("p", "a.py", "update", "old\nsame", "new\nsame"), ("p", "b.py", "add", "", "one\ntwo"), ("p", "c.py", "delete", "", "")]


def test_forks(spark):
    child = spark.createDataFrame([("c", 0, "u1"), ("c", 10, "u2"), ("c", 20, "x"), ("c", 30, "u3"), ("d", 0, "u1")], "path string, offset long, uuid string")
    parent = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "uuid string")
    assert {r.path: (r.fork_offset, r.last_shared) for r in sessions.divergence(child, parent).collect()} == {"c": (20, "u2"), "d": (None, "u1")}


def test_names_and_context(spark):
    df = spark.createDataFrame([("/home/u/a#b?", "/home/u"), ("C:\\Users\\x", "D:\\y"), ("/etc/z", "/home/u"), ("/home/u2", "/home/u")], "p string, h string")
    assert [r.x for r in df.select(sessions.url_path(F.col("p"), F.col("h")).alias("x")).collect()] == ["/~/a%23b%3F", "/C:/Users/x", "/etc/z", "/home/u2"]
    got = spark.createDataFrame([(0,), (20_999,), (50_000,), (100_000,)], "t long").select(*sessions.context_share(F.col("t"), 100_000)).collect()
    assert [(r.percent, r.band) for r in got] == [(0, 0), (20, 1), (50, 3), (100, 5)]

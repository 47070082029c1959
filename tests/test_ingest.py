"""Scans from files to the store, versions, embedding, and stemmed search against loops."""

import json
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions.stem import stem
from threadloom.operators import embedding, fulltext, search
from threadloom.operators.search_index import Index
from threadloom.plans import registry, views
from threadloom.sources import codex, transcripts
from threadloom.streaming import ingest

SF = "/root/testdata/sf0.001"
UUID = "01234567-89ab-cdef-0123-456789abcdef"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def said(kind, uuid, content):
    return {"type": kind, "uuid": uuid, "timestamp": "2024-01-01T00:00:01Z", "cwd": "C:\\w\\", "message": {"role": kind, "content": content}}


def env(kind, **p):
    return {"timestamp": "2024-01-01T00:00:02Z", "type": kind, "payload": p}


@pytest.fixture
def stores(spark, tmp_path):
    make = lambda name, schema, key=None: ingest.Versioned(spark, f"{tmp_path}/{name}", schema, key)
    return make("messages", ingest.MESSAGE_SCHEMA, "message_id"), make("marks", ingest.MARK_SCHEMA), make("provenance", ingest.PROVENANCE_SCHEMA)


def test_scan_from_files_to_the_store(spark, tmp_path, stores):
    claude, codex_root = tmp_path / "claude", tmp_path / "codex"
    one = claude / "sess-1.jsonl"
    write(one, [said("user", "u1", "hello"), "not json", said("assistant", "u2", [{"type": "text", "text": "hi"}])])
    write(claude / "sess-1/subagents/agent-ab.jsonl", [said("user", "v1", "leaf")])
    spawn = {"subagent": {"thread_spawn": {"parent_thread_id": "p0"}}}
    write(codex_root / f"rollout-x-{UUID}.jsonl", [env("session_meta", id=UUID, cwd="/c", source=spawn), env("response_item", type="message", role="user", content=[{"type": "input_text", "text": "ask"}])])
    roots = {"claude": str(claude), "codex": str(codex_root)}
    scan = lambda **more: ingest.ingest_scan(spark, roots, *stores, **more)
    assert scan() == ingest.Scan(3, 0, 3, 0)
    got = {r.message_id: (r.session_id, r.message_text, r.project_id, r.retrieval_class) for r in stores[0].read().collect()}
    assert got == {"u1": ("sess-1", "hello", "c:/w", "hot"), "u2": ("sess-1", "hi", "c:/w", "hot"), "v1": ("agent-ab", "leaf", "c:/w", "agent"), "codex-jsonl-01234567-0": (UUID, "ask", "/c", "agent")}
    known = {r.session_id: (r.kind, r.parent_session_id) for r in ingest.latest_provenance(stores[2]).collect()}
    assert known == {"sess-1": ("root", None), "agent-ab": ("agent", "sess-1"), UUID: ("agent", "p0")}
    assert scan() == ingest.Scan(3, 3, 0, 0)
    with one.open("a") as f:
        f.write(json.dumps(said("user", "u3", "more")) + "\n")
    os.utime(one, (2_000_000_000, 2_000_000_000))
    assert scan(files_a_round=1) == ingest.Scan(3, 2, 1, 0) and stores[0].read().count() == 5
    write(one, [said("user", "u1", "changed")])
    assert scan(force=True) == ingest.Scan(3, 0, 3, 0)
    assert {r.message_id: r.message_text for r in stores[0].read().where("session_id = 'sess-1'").collect()} == {"u1": "changed"}


def test_files_that_are_gone_keep_their_mark(spark, tmp_path, stores):
    write(tmp_path / "t/a.jsonl", [said("user", "u1", "x")])
    listing = transcripts.list_files(spark, f"{tmp_path}/t", "claude")
    gone = listing.select(F.concat(F.regexp_extract("path", "(.*)/", 1), F.lit("/gone.jsonl")).alias("path"), "mtime_ms", "size", "vendor")
    both = spark.createDataFrame(listing.unionByName(gone).collect(), listing.schema)
    paths = [r.path for r in both.collect()]
    lines = transcripts.read_lines(spark, paths[:1], tolerant=True)
    assert lines.count() == 1
    assert ingest.latest_marks(stores[1]).count() == 0


def test_versions_are_claimed_once(spark, tmp_path):
    s = ingest.Versioned(spark, f"{tmp_path}/v", "message_id string, session_id string, message_seq int")
    rows = lambda *r: spark.createDataFrame(list(r), "message_id string, session_id string, message_seq int")
    assert s.insert(rows(("a", "s", 1), ("a", "s", 0), ("b", "t", 0))) == 1
    assert sorted(tuple(r) for r in s.read().collect()) == [("a", "s", 0), ("b", "t", 0)]
    path, fs = s._fs()
    fs.create(path(f"{s.path}/claim-2"), False).close()  # another writer that has not committed
    with pytest.raises(ingest.ConcurrentWrite):
        s.insert(rows(("c", "s", 2)))
    assert s.version() == 1
    s.release()
    assert s.insert(rows(("c", "t", 2), ("b", "t", 9)), rows(("-", "t", 0))) == 2
    assert sorted(tuple(r) for r in s.read().collect()) == [("a", "s", 0), ("b", "t", 9), ("c", "t", 2)]


def test_tail_reads_whole_new_lines(spark):
    files = spark.createDataFrame([("a", "one\ntwo\nhal"), ("b", "x\n"), ("c", "né\n\nlast\n")], "path string, value string")
    state = spark.createDataFrame([("a", 4, 4), ("b", 9, 9)], "path string, offset long, size long")
    got = sorted((r.path, r.offset, r.value, r.next) for r in transcripts.new_lines(files, state).collect())
    assert got == [("a", 4, "two", 8), ("b", 0, "x", 2), ("c", 0, "né", 4), ("c", 5, "last", 10)]


def test_outputs_before_their_call_are_orphans(spark):
    call = lambda i: env("response_item", type="function_call", call_id=i, name="view_image", arguments='{"path":"p"}')
    out = lambda i, text, kind="function_call_output": env("response_item", type=kind, call_id=i, output=text)
    lines = [out("early", "first"), call("early"), call("k"), out("k", "old"), out("k", [{"type": "t", "text": "Exit code: 3\nOutput:\nnew"}]), out("lost", '{"a":1}', "custom_tool_call_output"), "broken"]
    df = spark.createDataFrame([("/t/rollout-s.jsonl", i, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "path string, line_no int, offset long, value string")
    got = sorted((r.line_no, r.part, r.type, r.uuid, r.tool, r.text, r.exit_code) for r in codex.entries(df).collect())
    assert got == [
        (0, 0, "result", "early-result", None, "first", 0), (1, 0, "assistant", "early", "Read", None, None), (2, 0, "assistant", "k", "Read", None, None),
        (2, 1, "result", "k-result", None, "new", 3), (5, 0, "result", "lost-result", None, '{"a":1}', None),
    ]


def test_drain_until_nothing_waits(spark):
    m = views.messages(spark, SF)
    none = spark.createDataFrame([], "message_id string, embedding_q8 array<tinyint>, norm double, quant_scale double, embed_version int")
    want = embedding.embed_queue(m, none, 10_000).count()

    def shy(texts):
        if len(texts) > 1 or len(texts[0]) > 300:
            raise RuntimeError("too much")
        return [[1.0, 2.0, float(len(t))] for t in texts]

    vectors, made = embedding.drain(m, none, shy, batch=10_000)
    short = embedding.embed_queue(m, none, 10_000).where("length(trim(embed_text)) <= 300 - 17").count()
    assert 0 < made == short < want and vectors.count() == made

    def dead(texts):
        raise RuntimeError("gone")

    assert embedding.drain(m, none, dead)[1] == 0  # three passes, then the rest is left


def terms(text):
    return [stem(t) for t in re.findall(r"[^\W_]+", text.lower())]


def test_stemmed_search_equals_loops(spark, tmp_path):
    m = views.doc_messages(spark, SF)
    rows = [r for r in m.where("retrieval_class = 'hot'").collect()]
    docs = {r.message_id: terms(r.message_text or "") for r in rows}
    index = Index.build(m, f"{tmp_path}/index")
    got = {(r.term, r.message_id): list(r.positions) for r in index.postings().collect()}
    want = {}
    for i, ts in docs.items():
        for pos, t in enumerate(ts):
            want.setdefault((t, i), []).append(pos)
    assert got == want
    mean, n = sum(map(len, docs.values())) / len(docs), len(docs)
    plan = index.plan_of("Licensing clowns café")
    score = dict.fromkeys(docs, 0.0)
    for word in ("licens", "clown", "cafe"):
        having = sum(word in ts for ts in docs.values())
        idf = math.log((n - having + 0.5) / (having + 0.5))
        for i, ts in docs.items():
            f = ts.count(word)
            score[i] += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    order = {r.message_id: r for r in rows}
    best = sorted((i for i in docs if score[i] > 0), key=lambda i: (-round(score[i], 9), order[i].created_at, i))[:20]
    found = index.search(m, "", plan=plan).orderBy("rank", "created_at", "message_id").collect()
    assert [r.message_id for r in found] == best
    assert all(math.isclose(-r["rank"], score[r.message_id], rel_tol=1e-9) for r in found)
    text = fulltext.snippet_of("The Licensed Clown", plan, stems=True)
    assert text == "The >>>Licensed<<< >>>Clown<<<"


def test_marks_and_case_fold_alike(spark, tmp_path):
    rows = [("a", "Le Café du coin", "hot"), ("b", "cafe\u0301s", "hot"), ("c", "cafes", "agent")]
    m = spark.createDataFrame([(i, "s", n, t, None, n, "user", c) for n, (i, t, c) in enumerate(rows)], ingest.MESSAGE_SCHEMA)
    index = Index.build(m, f"{tmp_path}/i")
    assert sorted(r.message_id for r in index.search(m, "CAFÉS").collect()) == ["a", "b"]
    assert sorted(r.message_id for r in index.search(m, '"cafe du"').collect()) == ["a"]
    assert index.search(m, "nothing here at all").count() == 0 and index.search(m, "AND").count() == 0
    empty = Index.build(m.limit(0), f"{tmp_path}/e")
    assert empty.search(m.limit(0), "cafe").count() == 0


def test_dates():
    assert search.day("2024-01-01") == 1_704_067_200_000 and search.day("2024-01-01", end=True) == 1_704_067_200_000 + 86_399_999
    with pytest.raises(ValueError):
        search.day("soon")


def test_registered_search_reads_the_index(spark):
    plan = registry._index(spark, SF, True).match(registry.OR_PLAN)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]

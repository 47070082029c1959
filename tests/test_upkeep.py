"""The versioned store and the index that follows it: the four states, late evidence, merges, snapshots."""

import json
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators.live_index import LiveIndex
from threadloom.operators.search_index import Index, dealt_postings
from threadloom.operators.versioned import ConcurrentWrite, Versioned
from threadloom.streaming import ingest

VECTORS = "message_id string, session_id string, embed_version int"


@pytest.fixture
def store(spark, tmp_path):
    return Versioned(spark, f"{tmp_path}/messages", ingest.MESSAGE_SCHEMA)


@pytest.fixture
def index(spark, tmp_path):
    return LiveIndex(spark, f"{tmp_path}/index", stems=False)


def rows(spark, *messages):
    made = [(i, s, n, t, "p", n, "user", c) for n, (i, s, t, c) in enumerate(messages)]
    return spark.createDataFrame(made, ingest.MESSAGE_SCHEMA)


def hits(index, word, store):
    return sorted(r.message_id for r in index.search(store.read(), word, skip_idf=True).collect())


def intact(index, store, tmp_path, name):
    """The index equals one built anew: postings, vocabulary and totals."""
    assert index.differences(store.read()).count() == 0
    fresh = Index.build(store.read(), f"{tmp_path}/{name}", stems=False)
    words = lambda i: sorted(map(tuple, i.vocabulary().select("term", "doc", "cnt").collect()))
    assert words(index) == words(fresh) and index.messages == fresh.messages and index.mean == pytest.approx(fresh.mean)


def test_four_states(spark, store, index, tmp_path):
    """Inserts, updates and deletions of hot and cold messages, each followed by the index."""
    session = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    key = lambda *s: spark.createDataFrame([(x,) for x in s], "message_id string")
    steps = [
        (lambda: store.insert(rows(spark, ("h1", "a", "hot walrus one", "hot"), ("a1", "b", "agent walrus", "agent"), ("h2", "a", "walrus two", "hot"))), {"walrus": ["h1", "h2"]}),
        (lambda: store.update(rows(spark, ("h1", "a", "narwhal one", "hot"))), {"walrus": ["h2"], "narwhal": ["h1"], "one": ["h1"], "hot": []}),
        (lambda: store.update(rows(spark, ("a1", "b", "silent change", "agent"))), {"silent": []}),
        (lambda: store.update(rows(spark, ("h1", "a", "narwhal one", "agent"))), {"narwhal": []}),
        (lambda: store.update(rows(spark, ("a1", "b", "silent change", "hot"))), {"silent": ["a1"]}),
        (lambda: store.delete(keys=key("h2", "h1", "none")), {"walrus": [], "narwhal": [], "silent": ["a1"]}),
        (lambda: store.insert(rows(spark, ("h3", "c", "third walrus", "hot"))), {"walrus": ["h3"]}),
        (lambda: store.insert(rows(spark, ("h4", "c", "late walrus", "agent")), cold=session("c")), {"walrus": [], "third": []}),
        (lambda: store.delete(session("b")), {"silent": []}),
    ]
    for n, (change, found) in enumerate(steps):
        change()
        index.follow(store)
        assert {w: hits(index, w, store) for w in found} == found, n
    intact(index, store, tmp_path, "end")


def test_several_commits_are_taken_over_at_once(spark, store, index, tmp_path):
    """A message that was updated twice, one that came and went, and one whose session turned cold, between two calls."""
    store.insert(rows(spark, ("x", "s", "old words", "hot"), ("y", "t", "cold soon", "hot"), ("k", "u", "stays here", "hot")))
    index.follow(store)
    store.update(rows(spark, ("x", "s", "newer words", "hot")))
    store.update(rows(spark, ("x", "s", "newest words", "hot")))
    store.insert(rows(spark, ("z", "s", "came and went", "hot")))
    store.delete(keys=spark.createDataFrame([("z",)], "message_id string"))
    store.update(rows(spark, ("y", "t", "cold now", "hot")))
    store.insert(rows(spark, ("w", "t", "more", "agent")), cold=spark.createDataFrame([("t",)], "session_id string"))
    index.follow(store)
    assert hits(index, "words", store) == ["x"] and hits(index, "newer", store) == [] and hits(index, "cold", store) == []
    intact(index, store, tmp_path, "end")
    assert index.follow(store) == store.version()
    segments = index.table.segments()
    index.follow(store)
    assert index.table.segments() == segments  # nothing new, nothing written


def test_merges_bound_the_segments_and_readers_keep_theirs(spark, tmp_path):
    store = Versioned(spark, f"{tmp_path}/messages", ingest.MESSAGE_SCHEMA, tier=3)
    index = LiveIndex(spark, f"{tmp_path}/index", stems=False, tier=2)
    store.insert(rows(spark, ("m0", "s0", "word0 same", "hot")))
    opened = store.read()
    for n in range(1, 14):
        store.insert(rows(spark, (f"m{n}", f"s{n % 3}", f"word{n} same", "hot")), cold=spark.createDataFrame([("s1",)], "session_id string") if n == 11 else None)
        if n % 4 == 0:
            index.follow(store)
    index.follow(store)
    assert len(store.segments()) <= 2 * 3 and len(store.versions()) > 14
    assert opened.count() == 1 and store.read().count() == 14
    cold = {r.message_id for r in store.read().where("retrieval_class = 'agent'").collect()}
    assert cold == {f"m{n}" for n in range(1, 12) if n % 3 == 1}
    intact(index, store, tmp_path, "end")
    before = sorted(map(tuple, store.read().collect()))
    store.compact()
    store.vacuum()
    assert len(store.segments()) == 1 and sorted(map(tuple, store.read().collect())) == before
    index.table.compact()
    index.refresh()
    intact(index, store, tmp_path, "compact")


def test_a_batch_writes_in_proportion_to_itself(spark, store, index, tmp_path):
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / f"index/v={v}").rglob("*.parquet"))
    store.insert(rows(spark, *((f"m{n}", f"s{n}", " ".join(f"w{n * 50 + j}" for j in range(50)), "hot") for n in range(2_000))))
    index.follow(store)
    store.insert(rows(spark, ("last", "s", "one more", "hot")))
    index.follow(store)
    first, second = (size(s.version) for s in index.table.segments())
    assert second * 50 < first


def test_a_claim_that_is_taken(spark, store):
    path, fs = store._fs()
    store.insert(rows(spark, ("a", "s", "x", "hot")))
    fs.create(path(f"{store.path}/claim-2"), False).close()
    with pytest.raises(ConcurrentWrite):
        store.compact() if len(store.segments()) > 1 else store.insert(rows(spark, ("b", "s", "x", "hot")))
    store.release()
    assert store.insert(rows(spark, ("b", "s", "x", "hot"))) == 2


def test_prefixes_reach_the_files(spark, store, index):
    store.insert(rows(spark, ("a", "s", "license public", "hot")))
    index.follow(store)
    plan = index.match(index.plan_of("licen*", skip_idf=True))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*kind", plan) and "StringStartsWith(term,licen)" in plan


def said(uuid, text):
    return json.dumps({"type": "user", "uuid": uuid, "timestamp": "2024-01-01T00:00:01Z", "cwd": "/w", "message": {"role": "user", "content": text}}) + "\n"


def test_late_evidence_in_a_scan(spark, store, index, tmp_path):
    """A session of the second vendor is taken for a root until its file tells of a parent: old rows, vectors and postings follow."""
    marks, told = Versioned(spark, f"{tmp_path}/marks", ingest.MARK_SCHEMA, None), Versioned(spark, f"{tmp_path}/told", ingest.PROVENANCE_SCHEMA, None)
    vectors = Versioned(spark, f"{tmp_path}/vectors", VECTORS)
    claude, other = tmp_path / "claude", tmp_path / "claude/sub/subagents"
    claude.mkdir()
    (claude / "s1.jsonl").write_text(said("m1", "walrus early"))
    (claude / "s2.jsonl").write_text(said("k1", "walrus kept"))
    scan = lambda: ingest.ingest_scan(spark, {"claude": str(claude)}, store, marks, told, index=index, vectors=vectors)
    scan()
    vectors.append(spark.createDataFrame([("m1", "s1", 3), ("k1", "s2", 3)], VECTORS))
    assert hits(index, "walrus", store) == ["k1", "m1"]
    # what the scan calls when evidence comes with a later file of the session
    late = rows(spark, ("m2", "s1", "walrus late", "agent"))
    store.insert(late, cold=late.select("session_id"))
    vectors.delete(late.select("session_id"))
    index.follow(store)
    assert {r.message_id: r.retrieval_class for r in store.read().collect()} == {"m1": "agent", "m2": "agent", "k1": "hot"}
    assert hits(index, "walrus", store) == ["k1"] and [r.message_id for r in vectors.read().collect()] == ["k1"]
    # by files: the leaf's transcript names the same session
    other.mkdir(parents=True)
    (other / "agent-s9.jsonl").write_text(said("q1", "walrus leaf"))
    store.insert(rows(spark, ("q0", "agent-s9", "walrus before", "hot")))
    index.follow(store)
    assert hits(index, "walrus", store) == ["k1", "q0"]
    scan()
    assert {r.message_id: r.retrieval_class for r in store.read().where("session_id = 'agent-s9'").collect()} == {"q0": "agent", "q1": "agent"}
    assert hits(index, "walrus", store) == ["k1"]


def test_provenance_follows_the_last(spark, tmp_path):
    told = Versioned(spark, f"{tmp_path}/told", ingest.PROVENANCE_SCHEMA, None)
    tell = lambda *r: told.append(spark.createDataFrame([r], ingest.PROVENANCE_SCHEMA))
    tell("s", "codex", "root", "zzz", "/a")
    tell("s", "claude", "root", "bbb", "/b")
    assert [tuple(r) for r in ingest.latest_provenance(told).collect()] == [("s", "claude", "root", "bbb", "/b")]
    tell("s", "claude", "agent", None, None)
    assert [tuple(r) for r in ingest.latest_provenance(told).collect()] == [("s", "claude", "agent", "bbb", "/b")]


def test_a_stream_feeds_the_index(spark, store, index, tmp_path):
    source = tmp_path / "in"
    rows(spark, ("a", "s", "streamed walrus", "hot"), ("b", "t", "cold walrus", "agent")).write.parquet(str(source))
    for _ in range(2):
        ingest.ingest_stream(spark.readStream.schema(ingest.MESSAGE_SCHEMA).parquet(str(source)), store, f"{tmp_path}/check", index).awaitTermination()
    assert hits(index, "walrus", store) == ["a"] and store.read().count() == 2


def test_postings_are_dealt_before_they_are_spread(spark, store, index, tmp_path):
    """No row for a posting is shuffled, nor one for a term of a session written, when the index follows."""
    store.insert(rows(spark, *((f"m{n}", f"s{n % 3}", f"often w{n % 7} w{n}", "hot") for n in range(60))))
    index.follow(store)
    assert {p.name for p in (tmp_path / "index/v=1").iterdir() if p.is_dir()} == {"kind=posting", "kind=size", "kind=state"}
    plan = dealt_postings(store.read(), False)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate")]
    assert {(r.term, r.doc, r.cnt) for r in index.vocabulary().where("term in ('often', 'w6', 'w59')").collect()} == {("often", 60, 60), ("w6", 8, 9), ("w59", 1, 1)}


def test_a_merge_shuffles_nothing(spark, tmp_path):
    store = Versioned(spark, f"{tmp_path}/messages", ingest.MESSAGE_SCHEMA)
    index = LiveIndex(spark, f"{tmp_path}/index", stems=False, tier=2)
    for n in range(2):
        store.insert(rows(spark, (f"m{n}", f"s{n}", f"word{n} same", "hot")))
        index.follow(store)
    live = index.table.segments()
    assert [(s.first, s.level) for s in live] == [(1, 1)]
    assert not index.table.ranged  # no shuffle by ranges of rows that lie sorted in files
    intact(index, store, tmp_path, "merged")

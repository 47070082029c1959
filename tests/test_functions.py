"""Query clean-up, parsing, stems, vectors, snippets, blame specs."""

import math

import pytest

from threadloom.functions import stem, vector
from threadloom.functions.query_text import And, Not, Or, Phrase, clean, joined_words, parse
from threadloom.operators import attribution, fulltext, fusion
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("", None), ("   ", None), ("\t \n", None), ("foo bar", '"foo" "bar"'), ("claude-transcript", '"claude" "transcript"'), ("foo_bar", '"foo" "bar"'),
        ('foo"bar', "foobar"), ('"hello world"', '"hello world"'), ("walk*", "walk*"), ("one", "one"), ("a b c", '"a" OR "b" OR "c"'),
        ("a A b c", '"a" OR "b" OR "c"'), ("foo AND (bar)", "foo AND bar"), ("[*^]", None), ("x: {y}", '"x" "y"'), ("foo:bar a b", '"foobar" OR "a" OR "b"'), ("The the THE", "the"), ("(AND)", "AND"),
    ],
)
def test_clean(raw, want):
    assert clean(raw) == want


def test_frequent_words_go():
    share = {"common": 0.9, "zorptangle": 0.0, "wibblenax": 0.01, "the": 0.5, "and": 0.4}.get
    assert clean("common zorptangle wibblenax", share) == '"zorptangle" "wibblenax"'
    assert clean("common the and", share) == '"and" OR "the" OR "common"'
    assert clean("common the zorptangle", share) == "zorptangle"


def test_joined_words_do_not_overlap():
    assert joined_words("x-y-z") == "x y-z"
    assert joined_words('"a-b" c-d') == '"a-b" c d'


def test_parse_binds_not_and_or():
    t = stem.python_tokens
    a, b, c = (Phrase((x,)) for x in "abc")
    assert parse("a b OR c", t) == Or((And((a, b)), c))
    assert parse("a NOT b AND c", t) == And((Not(a, b), c))
    assert parse('"foo.ts" OR run*', t) == Or((Phrase(("foo", "ts")), Phrase(("run",), True)))
    for bad in (None, "", "foo.ts", "AND a", "a OR", "a' b", "NOT a", "(a)"):
        assert parse(bad, t) is None


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("Café", "cafe"), ("today", "todai"), ("quickly", "quickli"), ("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("adoption", "adopt"), ("controll", "control"), ("probate", "probat"),
        ("agreed", "agre"), ("generalizations", "gener"), ("中文", "中文"), ("abc1", "abc1"),
    ],
)
def test_stems(word, want):
    assert stem.stem(word) == want


def test_quantise(spark):
    rows = [(0, [1.0, -0.5, 0.25]), (1, [0.0, 0.0]), (2, [-127.0, -63.5, 63.5])]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", vector.q8("v").alias("q"), vector.q8_scale("v").alias("s"), vector.l2_norm("v").alias("n"))
    got = {r.i: (r.q, r.s, r.n) for r in df.collect()}
    assert got[0][0] == [127, -63, 32] and math.isclose(got[0][1], 1 / 127)
    assert got[1] == ([0, 0], 0.0, 0.0)
    assert got[2][0] == [-127, -63, 64]  # halves go up


def test_cosine_of_zero_is_zero(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vector.cosine("a", "b").alias("c"), vector.dot(F.array(F.lit(127), F.lit(127)), F.array(F.lit(127), F.lit(127))).alias("d")).first()
    assert r.c == 0 and r.d == 2 * 127 * 127


def test_snippet_marks_and_cuts():
    text = " ".join(f"w{i}" for i in range(200))
    s = fulltext.snippet_of(text, Phrase(("w100", "w101")))
    assert ">>>w100<<< >>>w101<<<" in s and s.startswith("...") and s.endswith("...") and len(s.split()) <= 66
    assert fulltext.snippet_of("", Phrase(("a",))) == ""


def test_blame_specs():
    assert attribution.parse_spec("a/b.py") == attribution.BlameSpec("a/b.py")
    assert attribution.parse_spec("a.py:3") == attribution.BlameSpec("a.py", 3, 3)
    assert attribution.parse_spec("a:b.py:3-9") == attribution.BlameSpec("a:b.py", 3, 9)
    assert attribution.parse_spec("a.py:x") == attribution.BlameSpec("a.py:x")


def hits(spark, rows, path):
    df = spark.createDataFrame([(m, s, 0, 0, m, i) for i, (m, s) in enumerate(rows)], "message_id string, session_id string, message_seq long, created_at long, message_preview string, pos int")
    return df.withColumn("path", F.lit(path))


def test_fusion_by_hand(spark):
    fused = fusion.fuse(hits(spark, [("m1", "s1"), ("m2", "s1")], "fts"), hits(spark, [("m1", "s1"), ("m3", "s2")], "semantic"))
    got = {r.message_id: (round(r.score, 9), r.place, r.tag) for r in fused.collect()}
    assert got == {"m1": (round(2 / 60, 9), 1, "FTS5+SEMANTIC"), "m2": (round(1 / 61, 9), 3, "FTS5-ONLY"), "m3": (round(1.05 / 61, 9), 2, "SEMANTIC-ONLY")}


def test_recency(spark):
    day = fusion.DAY_MS
    r = spark.range(1).select(*(fusion.recency(F.lit(c), 10 * day, d).alias(n) for n, c, d in (("off", 0, None), ("neg", 0, -1.0), ("ten", 0, 0.1), ("new", 20 * day, 0.1)))).first()
    assert (r.off, r.neg, r.ten, r.new) == (1.0, 1.0, 0.5, 1.0)


def test_score_gap_cuts_once(spark):
    scores = [1.0] * 12 + [0.5] * 3 + [0.25] * 2
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "place int, score double")
    assert fusion.score_gap(df).count() == 12
    flat = spark.createDataFrame([(i + 1, 1.0 / (60 + i)) for i in range(30)], "place int, score double")
    assert fusion.score_gap(flat).count() == 30


def test_trigrams_and_match(spark):
    v1, v2 = "\n".join("a b  c d e".split()), "\n".join("a x c d e f".split())
    edits = spark.createDataFrame([("s1", "f", v1, 100), ("s2", "f", v2, 200), ("s3", "g", v1, 150), ("s1", "h", "z", 120), ("s4", "f", v1, 9_000_000)], "session string, file string, content string, ts long")
    commits = spark.createDataFrame([("c", 300, 0)], "hash string, commit_ms long, parent_ms long")
    blobs = spark.createDataFrame([("c", "f", v1 + "\n\n  q")], "hash string, file string, content string")
    added = blobs.select("hash", "file", F.split("content", "\n").alias("lines"))
    got = {r.session: r for r in attribution.match_commits(edits, commits, added, blobs).collect()}
    assert set(got) == {"s1", "s2"}
    assert (got["s1"].content_hits, got["s1"].edit_count, got["s1"].last_edit, got["s1"].surviving_ratio, got["s1"].surviving_in_commit) == (3, 2, 120, 1.0, True)
    assert (got["s2"].content_hits, got["s2"].surviving_ratio, got["s2"].surviving_in_commit) == (1, 0.25, False)


def test_diff_headers(spark):
    lines = ["--- a/x.py", "+++ b/x.py", "@@ -1 +1 @@", "+new", "-old", "+++ b/y.py", "@@", "+two"]
    df = spark.createDataFrame([("h", i, x) for i, x in enumerate(lines)], "hash string, line_no int, line string")
    assert sorted((r.file, r.kind, r.line) for r in attribution.parse_diff(df).collect()) == [("x.py", "added", "new"), ("x.py", "removed", "old"), ("y.py", "added", "two")]

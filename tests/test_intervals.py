"""Interval joins and sweep counts against loops; windows of any length."""

import random

from pyspark.sql import functions as F

from threadloom.operators import attribution
from threadloom.operators.intervals import count_within, cover, stab


def made(spark, seed=3):
    rnd = random.Random(seed)
    points = [(rnd.choice("abc"), rnd.randrange(-50, 5_000)) for _ in range(400)]
    ranges = [(i, rnd.choice("abc"), lo := rnd.randrange(-60, 5_000), lo + rnd.choice([-3, 0, 1, 16, 300, 4_000])) for i in range(60)] + [(99, "a", 0, 10**9)]
    return points, ranges, spark.createDataFrame(points, "s string, t long"), spark.createDataFrame(ranges, "id int, s string, lo long, hi long")


def test_pairs_and_counts_equal_loops(spark):
    points, ranges, p, r = made(spark)
    for unit in (1, 7, 60):
        got = sorted((x.s, x.t, x.id) for x in stab(p, r, "t", "lo", "hi", ["s"], unit).collect())
        assert got == sorted((s, t, i) for s, t in points for i, k, lo, hi in ranges if k == s and lo <= t <= hi)
        found = {x.id: (x.n, x["last"]) for x in count_within(p, r.where("lo <= hi"), "t", "lo", "hi", ["s"], ["id"], unit).collect()}
        inside = {i: [t for s, t in points if k == s and lo <= t <= hi] for i, k, lo, hi in ranges}
        assert found == {i: (len(x), max(x)) for i, x in inside.items() if x}
    everywhere = sorted((x.s, x.t, x.id) for x in stab(p, r.drop("s"), "t", "lo", "hi", [], 5).collect())
    assert everywhere == sorted((s, t, i) for s, t in points for i, _, lo, hi in ranges if lo <= t <= hi)


def test_a_root_commit_has_few_nodes(spark):
    """A window from 1970 on, by the hour: 473 thousand units, under a hundred nodes, so 1,000 files are under 100,000 rows."""
    df = spark.createDataFrame([(0, 1_704_067_200_000), (1, 1_704_067_200_000), (7, 3)], "lo long, hi long")
    assert [len(r[0]) < 100 for r in df.where("lo <= hi").select(cover(F.col("lo"), F.col("hi"), 3_600_000)).collect()] == [True, True]


def test_a_root_commit_among_the_commits(spark):
    text = "one\ntwo\nthree\nfour"
    edits = spark.createDataFrame([("s", "f", text, 1_704_000_000_000), ("s", "g", "x", 1_000), ("t", "f", "no\nthing\nalike", 1_704_000_000_000)], "session string, file string, content string, ts long")
    commits = spark.createDataFrame([("root", 1_704_000_000_500, 0), ("late", 1_804_000_000_500, 1_804_000_000_000)], "hash string, commit_ms long, parent_ms long")
    lines = spark.createDataFrame([("root", "f", text.split("\n")), ("late", "f", text.split("\n"))], "hash string, file string, lines array<string>")
    blobs = spark.createDataFrame([("root", "f", text), ("late", "f", text)], "hash string, file string, content string")
    got = attribution.match_commits(edits, commits, lines, blobs).collect()
    assert [tuple(r) for r in got] == [("root", "s", 2, 2, 1_704_000_000_000, True, 1.0)]
    assert attribution.match_commits(edits.limit(0), commits, lines, blobs).count() == 0

"""Line owners and file states against git's own blame and show, on a repository made here."""

import random
import subprocess

import pytest

from threadloom.operators import attribution, blame


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Forty commits that insert, replace and delete lines of three files, one of which goes and comes back."""
    root, rnd = tmp_path_factory.mktemp("repo"), random.Random(4)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=root, check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    held = {"a.txt": [], "b.txt": [], "c d.txt": []}
    for n in range(40):
        for name, lines in held.items():
            for _ in range(rnd.randrange(0, 4)):
                at = rnd.randrange(0, len(lines) + 1)
                kind = rnd.randrange(3)
                if kind == 0 or not lines:
                    lines[at:at] = [f"line {n} {rnd.random()}", "@@ -1,2 +3,4 @@ in the text", "+++ b/odd", "-- dashes"][: rnd.randrange(1, 5)]
                elif kind == 1:
                    lines[at : at + 2] = [f"other {n} {rnd.random()}"]
                else:
                    del lines[at : at + 3]
            if n == 20 and name == "b.txt":
                lines.clear()
            path = root / name
            if lines:
                path.write_text("\n".join(lines) + "\n")
            elif path.exists():
                path.unlink()
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", f"c{n}")
    return root, git, {k for k, v in held.items() if v}


@pytest.mark.parametrize(("context", "block"), [("-U0", 3), ("-U3", 64)])
def test_owners_equal_gits(spark, repository, context, block):
    root, git, names = repository
    log = attribution.read_git(spark, str(root), "log", "--reverse", "-p", context, "--no-renames", "--format=commit:%H")
    got = blame.line_owners(blame.read_history(log), block).collect()
    want = []
    for name in names:
        head = [x.split() for x in git("blame", "--porcelain", "--", name).split("\n") if len(x.split()) >= 3 and len(x.split()[0]) == 40 and not x.startswith("\t")]
        want += [(name, int(x[2]), x[0], int(x[1])) for x in head]
    assert sorted((r.file, r.line_no, r.owner, r.owner_line) for r in got) == sorted(want)


def test_states_equal_gits(spark, repository):
    root, git, _ = repository
    log = attribution.read_git(spark, str(root), "log", "--reverse", "-p", "--no-renames", "--format=commit:%H")
    history = blame.read_history(log)
    orders = sorted((r.ord, r.hash) for r in history.select("ord", "hash").collect())
    for n in (5, 25):
        upto, name = orders[n]
        got = {}
        for r in sorted(blame.file_states(history.where(history.ord <= upto)).collect(), key=lambda r: (r.file, r.line_no)):
            got.setdefault(r.file, []).append(r.text)
        files = [f for f in git("-c", "core.quotepath=off", "ls-tree", "-r", "--name-only", name).split("\n") if f]
        assert got == {f: git("show", f"{name}:{f}").removesuffix("\n").split("\n") for f in files}


def test_no_history(spark):
    none = spark.createDataFrame([], "hash string, ord long, diff string")
    assert blame.line_owners(none).count() == 0
    assert blame.line_owners(spark.createDataFrame([("h", 1, "commit:x\nnothing")], "hash string, ord long, diff string")).count() == 0


def test_blocks_are_composed_in_the_historys_order(spark):
    """A line at the top of the file a commit, in as many rounds as partitions: blocks of a group come in the order of a shuffle, not of the history."""
    rows = [(f"c{n}", n, f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+{n}") for n in range(60)]
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows come from one partition, in order by chance
    try:
        got = {r.line_no: r.owner for r in blame.line_owners(spark.createDataFrame(rows, "hash string, ord long, diff string"), 3).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert got == {60 - n: f"c{n}" for n in range(60)}

"""Which sessions produced a commit: line-trigram overlap of their edits with the lines the commit added."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.intervals import count_within, stab
from threadloom.plans.storage import written

WINDOW_MS = 3_600_000
SURVIVES = 0.5
#: Leaves of the tree of time that edits and commits are joined by, and the units of the sweep that counts.
HOUR_MS, MINUTE_MS = 3_600_000, 60_000


@dataclass(frozen=True)
class BlameSpec:
    path: str
    first: int | None = None
    last: int | None = None


def parse_spec(spec: str) -> BlameSpec:
    """``path[:line[-line]]``; a tail that is not numeric belongs to the path."""
    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", spec)
    if not m:
        return BlameSpec(spec)
    return BlameSpec(m[1], int(m[2]), int(m[3]) if m[3] else int(m[2]))


def spec_parts(spec: Column) -> tuple[Column, Column, Column]:
    """Path, first and last line of specs in a column, as ``parse_spec`` gives them."""
    part = lambda n: F.nullif(F.regexp_extract(spec, r"^(.+):(\d+)(?:-(\d+))?$", n), F.lit(""))
    first = part(2).cast("int")
    return F.coalesce(part(1), spec), first, F.coalesce(part(3).cast("int"), first)


def normal_lines(lines: Column) -> Column:
    """Lines with white space folded and trimmed, blank ones dropped."""
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def trigrams(lines: Column) -> Column:
    """Distinct runs of three consecutive normalised lines."""
    n = normal_lines(lines)
    return F.get(
        F.transform(
            F.array(n),
            lambda a: F.when(
                F.size(a) >= 3,
                F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.concat_ws("\n", F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))),
            ).otherwise(F.slice(a, 1, 0)),
        ),
        F.lit(0),
    )


def parse_diff(lines: DataFrame) -> DataFrame:
    """(hash, file, line_no, kind, line) of the added and removed lines in ``lines`` (hash, line_no, line) of unified diffs."""
    before = Window.partitionBy("hash").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)"))
    d = lines.withColumn("file", F.last(head, ignorenulls=True).over(before)).where(F.col("file").isNotNull())
    d = d.where(~(F.col("line").startswith("+++ ") | F.col("line").startswith("--- ") | F.col("line").startswith("@@")))
    kind = F.when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed")
    return d.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("hash", "file", "line_no", "kind", F.expr("substring(line, 2)").alias("line"))


def lines_by_file(added: DataFrame) -> DataFrame:
    """(hash, file, lines) in order; trigrams may span hunks."""
    return added.groupBy("hash", "file").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))


def match_commits(edits: DataFrame, commits: DataFrame, added: DataFrame, blobs: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """One row per commit and session whose edits share a trigram with an added line run of the same file.

    ``edits`` (session, file, content, ts), ``commits`` (hash, commit_ms, parent_ms), ``added`` (hash, file, lines) and
    ``blobs`` (hash, file, content). All edits of the session in the window [parent, commit + window] count as edits; the ratio is over its
    files of the commit: distinct trigrams that stand in the committed file. Trigrams are made once a text and compared by 128 bits of hash.

    Edits and commits meet by file and trigram first, so that an edit that shares nothing with a commit is paired with none; what
    else is asked of a commit and session is asked of those that met.
    """
    name = lambda tri: F.struct(F.xxhash64(tri).alias("x"), F.xxhash64(F.reverse(tri), F.length(tri)).alias("y"))
    made = lambda lines: F.transform(trigrams(lines), name)
    windows = commits.select("hash", F.col("parent_ms").alias("low"), (F.col("commit_ms") + window_ms).alias("high")).where("low <= high")
    files = blobs.select("hash", "file").distinct().join(windows, "hash")
    tris = written(edits.select("session", "file", "ts", made(F.split("content", "\n")).alias("tris")), "edit-trigrams")  # read twice
    in_added = added.select("hash", "file", F.explode(made(F.col("lines"))).alias("tri")).join(files, ["hash", "file"])
    met = tris.select("session", "file", "ts", F.explode("tris").alias("tri")).join(in_added, ["file", "tri"]).where("ts between low and high")
    hits = met.select("hash", "session", "file", "tri").distinct().groupBy("hash", "session").agg(F.count("*").alias("content_hits"))
    hits = written(hits.join(windows, "hash"), "hits")  # as many rows as the result
    asked = hits.select("hash", "session").join(files, "hash")
    own = stab(tris, asked, "ts", "low", "high", ["session", "file"], HOUR_MS).select("hash", "session", "file", F.explode("tris").alias("tri")).distinct()
    kept = blobs.join(hits.select("hash").distinct(), "hash", "left_semi")
    in_blob = kept.select("hash", "file", F.explode(made(F.split("content", "\n"))).alias("tri"), F.lit(1).alias("stays"))
    sums = own.join(in_blob, ["hash", "file", "tri"], "left").groupBy("hash", "session").agg(
        F.coalesce(F.sum("stays"), F.lit(0)).alias("surviving"), F.count("*").alias("total_tris")
    )
    of = edits.select("session", "ts").join(hits.select("session").distinct(), "session", "left_semi")
    times = count_within(of, hits, "ts", "low", "high", ["session"], ["hash"], MINUTE_MS)
    ratio = F.col("surviving") / F.col("total_tris")
    found = hits.select("hash", "session", "content_hits").join(sums, ["hash", "session"]).join(times, ["hash", "session"])
    return found.select(
        "hash", "session", "content_hits", F.col("n").alias("edit_count"), F.col("last").alias("last_edit"), (ratio >= SURVIVES).alias("surviving_in_commit"),
        (F.floor(ratio * 100 + 0.5) / 100).alias("surviving_ratio"),
    )


def common_trigrams(edits: DataFrame, blobs: DataFrame) -> DataFrame:
    """(hash, file, session, common): distinct trigrams of a session's edits of a file that stand in the committed file."""
    own = edits.select("session", "file", F.explode(trigrams(F.split("content", "\n"))).alias("tri")).distinct()
    there = blobs.select("hash", "file", F.explode(trigrams(F.split("content", "\n"))).alias("tri"))
    return own.join(there, ["file", "tri"]).groupBy("hash", "file", "session").agg(F.count("*").alias("common"))


def blamed_commits(porcelain: DataFrame) -> DataFrame:
    """(hash) of the commits in ``porcelain`` (line), the lines of ``git blame --porcelain``; lines not committed have none."""
    found = F.regexp_extract("line", r"^([0-9a-f]{40}) \d+ \d+", 1)
    return porcelain.select(found.alias("hash")).where((F.col("hash") != "") & (F.col("hash") != "0" * 40)).distinct()


def blame_lines(lines: DataFrame, specs: list[BlameSpec]) -> DataFrame:
    """(hash) of the commits that last wrote the lines asked for; ``lines``: (file, line_no, hash), line numbers from 1.

    The specs are united. A spec whose last line is before its first is an error.
    """
    for s in specs:
        if s.first is not None and s.last < s.first:
            raise ValueError(f"lines {s.first} to {s.last} of {s.path}")
    wanted = F.lit(False)
    for s in specs:  # as many as a user names
        one = F.col("file") == s.path
        wanted = wanted | (one if s.first is None else one & F.col("line_no").between(s.first, s.last))
    return lines.where(wanted).select("hash").distinct()


def attribute(hashes: DataFrame, edits: DataFrame, commits: DataFrame, added: DataFrame, blobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches of some commits (a hash, or those of a blame), ascending by the last edit, or the last ``limit`` of them.

    Hashes that no commit has are left out.
    """
    of = lambda df: df.join(hashes.select("hash").distinct(), "hash", "left_semi")
    found = match_commits(edits, of(commits), of(added), of(blobs))
    return latest(found, limit) if limit else found.orderBy("last_edit", "session", "hash")


def commit_info(shown: DataFrame) -> DataFrame:
    """(hash, commit_ms, files) of ``shown`` (id, text): what ``git show --pretty=format:%H%n%aI --name-only`` prints."""
    lines = F.split(F.trim("text"), "\n")
    return shown.select(
        "id", F.get(lines, F.lit(0)).alias("hash"), F.coalesce(F.unix_millis(F.try_to_timestamp(F.get(lines, F.lit(1)))), F.lit(0)).alias("commit_ms"),
        F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: x != "").alias("files"),
    )


def read_git(spark: SparkSession, root: str, *args: str) -> DataFrame:
    """(line_no, line) of what git prints in ``root``; none where it fails. One call for what a user asks."""
    done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=False)
    lines = done.stdout.split("\n") if done.returncode == 0 else []
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def candidates(files: DataFrame, commits: DataFrame, before_ms: int = 60_000, after_ms: int = 86_400_000) -> DataFrame:
    """(hash, path) of the transcripts whose time fits a commit: from a minute before its parent to a day after it.

    ``files`` (path, mtime_ms), ``commits`` (hash, commit_ms, parent_ms).
    """
    ranges = commits.select("hash", (F.col("parent_ms") - before_ms).alias("low"), (F.col("commit_ms") + after_ms).alias("high"))
    return stab(files.select("path", "mtime_ms"), ranges, "mtime_ms", "low", "high", [], 24 * HOUR_MS).select("hash", "path")


def as_table(matches: DataFrame) -> DataFrame:
    """What is printed of matches: the session's first eight characters, time, hits, edits and share, ascending by time."""
    text = F.format_string(
        "%s  %s  %d hits  %d edits  %d%%%s", F.substring("session", 1, 8), F.date_format(F.timestamp_millis("last_edit"), "yyyy-MM-dd HH:mm"),
        F.col("content_hits"), F.col("edit_count"), F.floor(F.col("surviving_ratio") * 100 + 0.5), F.when(F.col("surviving_in_commit"), "").otherwise("  (superseded)"),
    )
    return matches.select("hash", "session", "last_edit", text.alias("line")).orderBy("last_edit", "session", "hash")


def latest(matches: DataFrame, n: int) -> DataFrame:
    """The last ``n`` by their last edit, ascending."""
    return matches.orderBy(F.desc("last_edit"), "session", "hash").limit(n).orderBy("last_edit", "session", "hash")

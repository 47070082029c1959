"""Who last wrote each line of a file, and its text, at a commit: hunks composed along a linear history.

A commit's change of a file is a list of segments in the order of the new file: a run of the old file's lines, or a run of lines
that the commit added. Two changes compose to one by taking the later one's old runs from the earlier one's list, and that is
associative: blocks of ``BLOCK`` commits of a file are composed apart, then blocks of blocks, so a file with a very long history is many
tasks, in as many rounds as its length has digits to that base. No text takes part; the lines' texts come by a join at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Commits, or blocks of them, that a task composes at a time.
BLOCK = 64
#: A run of old lines to the end of the file, however long.
REST = 1 << 60

#: (owner or None for old lines, first line in the owner's or the old file, number of lines)
Segment = tuple[str | None, int, int]

_SEGMENTS = "array<struct<owner:string,start:bigint,size:bigint>>"


def of_patch(owner: str, lines: list[str]) -> list[Segment]:
    """The segments of one commit's hunks of a file, with or without lines of context."""
    out: list[Segment] = []
    at, old, new = 1, 0, 0  # at: the first old line that is not accounted for
    for line in lines:
        if head := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, new = int(head[1]) + (head[2] == "0"), int(head[3]) + (head[4] == "0")  # of no lines: after that line
            if old > at:
                out.append((None, at, old - at))
            at = old
        elif line.startswith("+"):
            out.append((owner, new, 1))
            new += 1
        elif line.startswith("-"):
            at += 1
        elif line.startswith(" "):
            out.append((None, at, 1))
            at, new = at + 1, new + 1
    return _joined([*out, (None, at, REST)])


def _joined(segments: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for owner, start, size in segments:
        if out and out[-1][0] == owner and out[-1][1] + out[-1][2] == start:
            out[-1] = (owner, out[-1][1], out[-1][2] + size)
        else:
            out.append((owner, start, size))
    return out


def compose(first: list[Segment], then: list[Segment]) -> list[Segment]:
    """The change that ``first`` and ``then`` make together. Old runs ascend in both, so one pass over each does."""
    out: list[Segment] = []
    k, begin = 0, 1  # first[k] holds the lines from ``begin`` on
    for owner, start, size in then:
        if owner is not None:
            out.append((owner, start, size))
            continue
        end = start + size
        while start < end and k < len(first):
            name, there, n = first[k]
            if begin + n <= start:
                begin, k = begin + n, k + 1
                continue
            take = min(end, begin + n) - start
            out.append((name, there + start - begin, take))
            start += take
    return _joined(out)


def _patches(diffs: DataFrame) -> DataFrame:
    """(file, ord, hash, n, line) of the hunks in ``diffs`` (hash, ord, diff): their heads and lines."""
    lines = diffs.select("hash", "ord", F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    before = Window.partitionBy("hash", "ord").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    old = F.when(F.startswith("line", F.lit("--- ")), F.regexp_extract("line", r"^--- (?:a/)?(.*?)\t?$", 1))
    name = F.when(F.startswith("line", F.lit("+++ ")), F.when(F.col("line") == "+++ /dev/null", F.last(old, ignorenulls=True).over(before)).otherwise(F.regexp_extract("line", r"^[+]{3} (?:b/)?(.*?)\t?$", 1)))
    # a file's part begins at its ``diff`` line; between that and its first hunk nothing is a changed line
    kind = F.when(F.startswith("line", F.lit("diff ")), 0).when(F.startswith("line", F.lit("@@")), 1)
    d = lines.withColumn("_in", F.last(kind, ignorenulls=True).over(before))
    header = F.coalesce(F.col("_in"), F.lit(0)) == 0
    d = d.withColumn("file", F.last(F.when(header, name), ignorenulls=True).over(before))
    return d.where((F.col("_in") == 1) & F.col("file").isNotNull()).select("file", "ord", "hash", "n", "line")


def line_owners(diffs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, line_no, owner, owner_line): each line of each file after the commits in ``diffs`` (hash, ord, diff), and its line in the commit that wrote it.

    ``ord`` numbers the commits of a linear history from its root, whose files are new; the diffs are unified, with or without context, and
    renames are a deletion and a new file. For an earlier commit give the diffs up to it. Empty files and an empty table give no line.
    """

    def one_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "n"], kind="stable")
        total: list[Segment] | None = None
        for (_, owner), part in frame.groupby(["ord", "hash"], sort=True):
            step = of_patch(owner, part["line"].tolist())
            total = step if total is None else compose(total, step)
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "segments": [total]})

    def blocks(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total: list[Segment] | None = None
        for segments in frame.sort_values("block")["segments"]:
            step = [(s["owner"], s["start"], s["size"]) for s in segments]
            total = step if total is None else compose(total, step)
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "segments": [total]})

    schema = f"file string, block bigint, segments {_SEGMENTS}"
    patches = _patches(diffs)
    # blocks by a file's own changes, so that they are full however the history is spread over files
    place = patches.select("file", "ord").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1)
    longest = place.agg(F.max("nth")).first()[0]
    if longest is None:
        return diffs.sparkSession.createDataFrame([], "file string, line_no bigint, owner string, owner_line bigint")
    made = patches.join(place, ["file", "ord"]).withColumn("block", F.floor(F.col("nth") / block)).groupBy("file", "block").applyInPandas(one_block, schema)
    left = longest // block
    while left:  # rounds: the digits of the longest history to the base ``block``
        # under a name of its own: the blocks that are composed have to be told apart, as rows of a group come in any order
        made = made.withColumn("above", F.floor(F.col("block") / block)).groupBy("file", "above").applyInPandas(blocks, schema)
        left //= block
    own = F.filter("segments", lambda s: s["owner"].isNotNull())  # of the file before the root nothing is left
    runs = made.select("file", F.posexplode(own).alias("k", "s"))
    before = F.coalesce(F.sum("s.size").over(Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = runs.withColumn("_before", before).select("file", "_before", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s.size") - 1)).alias("i"))
    return each.select("file", (F.col("_before") + F.col("i") + 1).alias("line_no"), F.col("s.owner").alias("owner"), (F.col("s.start") + F.col("i")).alias("owner_line"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(file, owner, owner_line, text) of every line that a commit added."""

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, owner, lines in zip(frame["file"], frame["hash"], frame["lines"], strict=True):
                at = 0
                for line in lines:
                    if head := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line):
                        at = int(head[1]) + (head[2] == "0")
                    elif line.startswith("+"):
                        rows.append((file, owner, at, line[1:]))
                        at += 1
                    elif line.startswith(" "):
                        at += 1
            yield pd.DataFrame(rows, columns=["file", "owner", "owner_line", "text"])

    hunks = _patches(diffs).groupBy("file", "hash").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    return hunks.mapInPandas(number, "file string, owner string, owner_line bigint, text string")


def file_states(diffs: DataFrame) -> DataFrame:
    """(file, line_no, owner, text) after the commits in ``diffs``."""
    return line_owners(diffs).join(added_lines(diffs), ["file", "owner", "owner_line"]).select("file", "line_no", "owner", "text")


def read_history(log: DataFrame) -> DataFrame:
    """(hash, ord, diff) of ``log`` (line_no, line): what ``git log --reverse -p --no-renames --format=commit:%H`` prints."""
    order = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one user's repository, as git prints it
    begins = F.when(F.regexp_like("line", F.lit("^commit:[0-9a-f]{40}$")), F.col("line_no"))
    named = log.withColumn("ord", F.last(begins, ignorenulls=True).over(order)).where("ord is not null")
    return named.groupBy("ord").agg(
        F.substring(F.max(F.when(F.col("line_no") == F.col("ord"), F.col("line"))), 8, 40).alias("hash"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("diff"),
    ).select("hash", "ord", "diff")

"""An append-only table of numbered segments with logs of what they take back, merged in tiers.

A segment counts once its marker has its name, which one rename gives it; its number is claimed by creating a file, so two writers
never commit the same one. Beside its rows a segment may hold logs, which reads apply to rows of earlier versions:

- ``hide``: sessions whose earlier rows are gone (replaced or deleted),
- ``drop``: keys whose earlier rows are gone, and ``was``: those rows as they stood, for whoever follows the table,
- ``cold``: sessions whose rows up to there are of class agent, whatever they say.

When ``TIER`` segments of one level stand at the end, they are merged to one of the next level, so a row is written again once a level and
n batches leave about ``TIER * log(n)`` segments. A merged segment's marker names the versions it stands for; rows and logs keep their version
numbers. The folders of what was merged stay until ``vacuum``, so readers that were opened before keep their rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.storage import remove

#: Segments of a level that are merged.
TIER = 8


class ConcurrentWrite(Exception):
    """Another writer is committing the same version; the batch can be tried again."""


@dataclass(frozen=True)
class Segment:
    """What a marker says: versions ``first`` to ``version``, of so many merges."""

    version: int
    first: int
    level: int


class Versioned:
    """A table below ``path``; ``key`` names the column of ``insert``. Rows are written by ``sort`` and in folders by ``parts``. A table that nobody
    follows keeps no copy of dropped rows. One that isn't ``ranged`` writes rows as they are dealt: a merge reads small files together and shuffles none."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = "message_id", parts: tuple[str, ...] = (), sort: tuple[str, ...] = (), followed: bool = True, tier: int = TIER, ranged: bool = True) -> None:
        self.spark, self.path, self.schema, self.key, self.parts, self.sort, self.followed = spark, path.rstrip("/"), schema, key, parts, sort, followed
        self.tier, self.ranged = tier, ranged
        self.columns = [f.split()[0] for f in schema.split(", ")]
        self.logs = {"hide": "session_id string, before int", "cold": "session_id string, until int", "drop": f"{key} string, before int", "was": f"{schema}, _version int, before int"}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        path, fs = self._fs()
        return [s.getPath().getName() for s in (fs.globStatus(path(f"{self.path}/{pattern}")) or [])]

    def _committed(self) -> list[Segment]:
        numbers = [[int(x) for x in n.split("-")[1:]] for n in self._names("COMMIT-*")]
        return sorted((Segment(n[0], *(n[1:] or (n[0], 0))) for n in numbers), key=lambda s: s.version)

    def segments(self) -> list[Segment]:
        """Those that count, ascending: committed and not part of a merged one."""
        every = self._committed()
        merged = [s for s in every if s.first < s.version]
        return [s for s in every if not any(m.first <= s.version < m.version for m in merged)]

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return [s.version for s in self._committed()]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _rows(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{self.schema}, _version int")
        read = self.spark.read.schema(f"{self.schema}, _version int, v int").option("basePath", self.path)
        return read.parquet(*(f"{self.path}/v={s.version}" for s in segments)).drop("v")

    def _log(self, name: str, segments: list[Segment]) -> DataFrame | None:
        have = set(self._names(f"{name}-*"))
        paths = [f"{self.path}/{name}-{s.version}" for s in segments if f"{name}-{s.version}" in have]
        return self.spark.read.schema(self.logs[name]).parquet(*paths) if paths else None

    def _visible(self, rows: DataFrame, segments: list[Segment]) -> DataFrame:
        """``rows`` less what the segments' logs take back."""
        for name, key in (("hide", "session_id"), ("drop", self.key)):
            if (log := self._log(name, segments)) is not None:
                gone = log.groupBy(key).agg(F.max("before").alias("_before"))
                rows = rows.join(gone, key, "left").where(F.col("_before").isNull() | (F.col("_version") >= F.col("_before"))).drop("_before")
        if (log := self._log("cold", segments)) is not None:
            until = log.groupBy("session_id").agg(F.max("until").alias("_until"))
            now = F.when(F.col("_version") <= F.col("_until"), "agent").otherwise(F.col("retrieval_class"))
            rows = rows.join(until, "session_id", "left").withColumn("retrieval_class", now)
        return rows.select(*self.columns, "_version")

    def read(self, versioned: bool = False) -> DataFrame:
        """The rows that count, as of now; with ``versioned`` also the version that each came with."""
        segments = self.segments()
        rows = self._visible(self._rows(segments), segments)
        return rows if versioned else rows.drop("_version")

    def changes(self, since: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """What came after version ``since``: rows that count; (session_id) whose rows up to it are gone or cold; rows up to it that
        were dropped, as they stood. The latter two are None where no log speaks of any."""
        segments = self.segments()
        new = self._visible(self._rows([s for s in segments if s.version > since]), segments).where(F.col("_version") > since).drop("_version")
        touched = [df.where(F.col(c) > since).select("session_id") for n, c in (("hide", "before"), ("cold", "until")) if (df := self._log(n, segments)) is not None]
        sessions = reduce(DataFrame.unionByName, touched).distinct() if touched else None
        was = self._log("was", segments)
        if was is not None:
            was = was.where((F.col("before") > since) & (F.col("_version") <= since)).dropDuplicates([self.key]).select(*self.columns)
        return new, sessions, was

    def _claim(self) -> int:
        path, fs = self._fs()
        v = self.version() + 1
        try:
            fs.create(path(f"{self.path}/claim-{v}"), False).close()
        except Exception as e:
            raise ConcurrentWrite(v) from e
        return v

    def _commit(self, segment: Segment) -> None:
        path, fs = self._fs()
        draft = path(f"{self.path}/draft-{uuid.uuid4().hex}")
        fs.create(draft, True).close()
        name = f"COMMIT-{segment.version}" + (f"-{segment.first}-{segment.level}" if segment.level else "")
        if not fs.rename(draft, path(f"{self.path}/{name}")):
            raise ConcurrentWrite(segment.version)

    def _write(self, rows: DataFrame, v: int) -> None:
        if self.sort:  # Spark chooses how many files by their size; a key with very many rows is in several
            rows = (rows.repartitionByRange(*self.sort) if self.ranged else rows).sortWithinPartitions(*self.sort)
        rows.select(*self.columns, "_version").write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/v={v}")

    def append(self, df: DataFrame, replaces: DataFrame | None = None, cold: DataFrame | None = None, drops: DataFrame | None = None) -> int:
        """Add the rows of ``df`` as a segment; the version made.

        ``replaces`` and ``cold`` have a session_id: rows of the former before this version are gone, those of the latter up to this version are
        of class agent. ``drops`` has the key: such rows before this version are gone.
        """
        v = self._claim()
        self._write(df.withColumn("_version", F.lit(v)), v)
        logs = {}
        if replaces is not None:
            logs["hide"] = replaces.select("session_id", F.lit(v).alias("before")).distinct()
        if cold is not None:
            logs["cold"] = cold.select("session_id", F.lit(v).alias("until")).distinct()
        if drops is not None:
            logs["drop"] = drops.select(self.key, F.lit(v).alias("before")).distinct()
        if drops is not None and self.followed:
            logs["was"] = self.read(versioned=True).join(logs["drop"], self.key)
        for name, log in logs.items():
            log.select(*(f.split()[0] for f in self.logs[name].split(", "))).write.mode("overwrite").parquet(f"{self.path}/{name}-{v}")
        self._commit(Segment(v, v, 0))
        self.merge_tiers()
        return v

    def merge_tiers(self) -> None:
        """Merge the last segments while ``tier`` of them are of one level. Another writer's commit meanwhile makes it wait for the next time."""
        while True:
            live = self.segments()
            tail = [s for s in live if s.level == live[-1].level] if live else []
            if len(tail) < self.tier or tail != live[-len(tail) :]:
                return
            try:
                self._merge(tail, live)
            except ConcurrentWrite:
                return

    def compact(self) -> None:
        """Merge all segments to one."""
        if len(live := self.segments()) > 1:
            self._merge(live, live)

    def _merge(self, group: list[Segment], live: list[Segment]) -> None:
        v = self._claim()
        self._write(self._visible(self._rows(group), live), v)
        for name in self.logs:  # they may speak of rows in earlier segments, and to those who follow the table
            if (log := self._log(name, group)) is not None:
                log.write.mode("overwrite").parquet(f"{self.path}/{name}-{v}")
        self._commit(Segment(v, group[0].first, max(s.level for s in group) + 1))

    def vacuum(self) -> None:
        """Delete the folders of segments that are part of a merged one. Readers opened before lose them."""
        path, fs = self._fs()
        live = {s.version for s in self.segments()}
        for s in self._committed():
            if s.version not in live:
                for name in ("v=", *(f"{n}-" for n in self.logs)):
                    fs.delete(path(f"{self.path}/{name}{s.version}"), True)

    def release(self) -> None:
        """Give up a claim whose writer died before it committed."""
        path, fs = self._fs()
        fs.delete(path(f"{self.path}/claim-{self.version() + 1}"), False)

    def clear(self) -> None:
        """Drop all segments."""
        remove(self.spark, self.path)

    def insert(self, incoming: DataFrame, replaces: DataFrame | None = None, cold: DataFrame | None = None) -> int:
        """Append the rows whose key isn't there, of repeated keys the first by session and place. Reads keys alone, not texts."""
        new = incoming.groupBy(self.key).agg(F.min_by(F.struct(*incoming.columns), F.struct("session_id", "message_seq")).alias("r")).select("r.*")
        if self.versions():
            there = self.read()
            if replaces is not None:
                there = there.join(replaces.select("session_id").distinct(), "session_id", "left_anti")
            new = new.join(there.select(self.key), self.key, "left_anti")
        return self.append(new, replaces, cold)

    def update(self, rows: DataFrame) -> int:
        """Put ``rows`` in place of those of the same keys."""
        return self.append(rows, drops=rows)

    def delete(self, sessions: DataFrame | None = None, keys: DataFrame | None = None) -> int:
        """Take whole sessions or single keys back."""
        return self.append(self.spark.createDataFrame([], self.schema), replaces=sessions, drops=keys)

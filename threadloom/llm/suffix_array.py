"""Repeated passages by prefix doubling over all suffixes, as DataFrames.

Every byte position is a suffix with a rank, the number of the least position that starts with the same bytes; so ranks are
exact and no two strings share one. A round sorts the pairs (rank, rank at the offset) of all suffixes left, which ranks them by
twice the bytes; suffixes whose pair stands in one document alone are unique and leave. The last offset is cut so that
the rounds end at the length asked for.

Each round moves a row of some twenty bytes for every byte of text that still repeats, and the first one for every byte. That is
several times the disk that ``passages`` takes, which finds the same bytes; the README has figures. This form needs
no hash to be right and serves to check the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable

#: Bytes of the first rank, which is the string itself.
FIRST = 8


def offsets(length: int, first: int = FIRST) -> list[int]:
    """The offsets at which ranks are paired, from ``first`` ranked bytes up to ``length``."""
    out, have = [], min(first, length)
    while have < length:
        out.append(min(have, length - have))
        have += out[-1]
    return out


def repeated_windows(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos): starts of the ``length``-byte strings that also start in a document with a smaller id.

    Texts count as UTF-8 bytes, null as empty; a null id counts as the greatest. Rows with one id are one document to
    each other. Texts shorter than ``length`` and an empty table give no row.
    """
    first = min(FIRST, length)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("b"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).where(F.octet_length("b") >= length)
    rows = durable(rows, "suffix-texts")
    last = F.octet_length("b") - first
    each = rows.select("doc", "row", "b", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    # a suffix is its row and position; only those with ``length`` bytes left start a window, the others only end one
    held = each.select("doc", "row", "pos", F.substring("b", F.col("pos") + 1, first).alias("key"))
    ranked = _rerank(held, ["key"])
    for n, step in enumerate(offsets(length)):
        ranked = durable(ranked, f"suffix-ranks-{n}")
        after = ranked.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("then")).where("pos >= 0")
        ranked = _rerank(ranked.drop("least").join(after, ["row", "pos"]), ["rank", "then"])
    return ranked.where(F.col("least") < F.col("doc")).select("doc", "row", "pos")


def _rerank(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """(doc, row, pos, rank, least) of the suffixes whose key stands in several documents: the least suffix, and the least document."""
    new = F.min(F.struct("row", "pos")).alias("_new")
    seen = suffixes.groupBy(*key).agg(new, F.min("doc").alias("least"), F.max("doc").alias("_most")).where("least < _most")
    named = seen.select(*(F.col(k).alias(f"_{k}") for k in key), "_new", "least")
    met = suffixes.join(named, [F.col(k) == F.col(f"_{k}") for k in key])
    return met.select("doc", "row", "pos", F.col("_new").alias("rank"), "least")


def removed_bytes(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, n_removed, spans) of the texts that lose something: maximal runs covered by repeated windows."""
    starts = repeated_windows(df, length, id_col, text_col)
    runs = starts.groupBy("row", "doc").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    grown = F.aggregate(
        "at",
        empty,
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= p),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), (p + length).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.alias("start"), (p + length).alias("end"))))),
    )
    spans = runs.select("row", "doc", grown.alias("spans"))
    return spans.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))

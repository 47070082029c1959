"""Vectors for messages by a pluggable embedder: a session, a batch, or all that wait."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.vector import l2_norm, q8, q8_scale
from threadloom.operators.semantic import EMBED_CHARS, VERSION, embed_queue, embed_text, gap, with_previous
from threadloom.plans.storage import written

#: From texts to vectors of one length; it may raise.
Embedder = Callable[[list[str]], list[list[float]]]

#: What a text begins with, its shorter form when it fails alone, the rows of a session at a time.
DOCUMENT, QUERY = "search_document: ", "search_query: "
SAFE_CHARS, SESSION_ROWS, BATCH, FAILURES = 6_000, 10, 80, 3


def embed_rows(rows: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """(message_id, embedding_q8, norm, quant_scale, embed_version) of ``rows`` (message_id, embed_text); blank texts go.

    A batch that fails is tried text by text, and a text that fails by its first characters; what fails then is left out.
    """

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = [DOCUMENT + t for t in part["embed_text"]]
                try:
                    got: list[list[float] | None] = list(embedder(texts))
                except Exception:
                    got = [_alone(embedder, t) for t in texts]
                kept = [(i, v) for i, v in zip(part["message_id"], got, strict=True) if v is not None]
                if kept:
                    yield pd.DataFrame({"message_id": [i for i, _ in kept], "v": [list(map(float, v)) for _, v in kept]})

    texts = rows.select("message_id", F.substring(F.trim("embed_text"), 1, EMBED_CHARS).alias("embed_text")).where(F.col("embed_text") != "")
    v = texts.mapInPandas(vectors, "message_id string, v array<double>")
    return v.select("message_id", q8("v").alias("embedding_q8"), l2_norm("v").alias("norm"), q8_scale("v").alias("quant_scale"), F.lit(VERSION).alias("embed_version"))


def _alone(embedder: Embedder, text: str) -> list[float] | None:
    for t in (text, text[:SAFE_CHARS]):
        try:
            return embedder([t])[0]
        except Exception:
            continue
    return None


def session_queue(messages: DataFrame, vectors: DataFrame, session: str, force: bool = False, rows: int = SESSION_ROWS) -> DataFrame:
    """The first hot messages of a session without a current vector (or all of them), however short, with the text to embed."""
    m = with_previous(messages.where(F.col("session_id") == session)).withColumn("message_text", F.trim("message_text")).where("message_text <> ''")
    if not force:
        m = m.join(vectors.where(F.col("embed_version") == VERSION).select("message_id"), "message_id", "left_anti")
    return m.orderBy("message_seq", "message_id").limit(rows).select("message_id", F.substring(embed_text(), 1, EMBED_CHARS).alias("embed_text"))


def query_vector(query: str, embedder: Embedder) -> list[float] | None:
    """The vector of a query, or None where the embedder fails: then the search is by keywords alone."""
    try:
        return list(map(float, embedder([QUERY + query])[0]))
    except Exception:
        return None


def drain(messages: DataFrame, vectors: DataFrame, embedder: Embedder, batch: int = BATCH, attempts: int = FAILURES) -> tuple[DataFrame, int]:
    """Vectors of all messages that wait, and how many were made.

    All that wait are embedded in one pass, by batches within each task; what fails is tried again, ``attempts`` times in all. Each pass is
    written, so a lost executor repeats its own tasks alone, and the passes are as many for any number of messages.
    """
    queue, made, passes = written(embed_queue(messages, vectors, None), "queue"), 0, []
    for _ in range(attempts):
        if queue.isEmpty():
            break
        new = written(embed_rows(queue, embedder, batch), "vectors")
        passes.append(new)
        queue = written(queue.join(new.select("message_id"), "message_id", "left_anti"), "queue")
    if passes:
        new = reduce(DataFrame.unionByName, passes)
        made = new.count()
        vectors = written(vectors.join(new.select("message_id"), "message_id", "left_anti").unionByName(new.select(*vectors.columns)), "all-vectors")
    return vectors, made


def catch_up(messages: DataFrame, vectors: DataFrame, unindexed: DataFrame, ask_above: int = 200) -> DataFrame:
    """One row of what there is to do: transcripts without messages, messages that wait, and whether to ask before embedding them."""
    todo = unindexed.agg(F.count("*").alias("missing_sessions")).crossJoin(gap(messages, vectors))
    return todo.withColumn("ask", F.col("gap_count") > ask_above)

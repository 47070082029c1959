"""Vector search, coverage of embedding versions, and what is still to be embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.vector import approximate_cosine
from threadloom.operators.messages import hot, in_scope, infer_role, preview

#: Numbers of a session's places that one task puts in order.
CHUNK = 4096
#: Fixed values of the embedding rules.
VERSION, TOLERANT_BELOW = 3, 0.95
MIN_CHARS, SHORT_CHARS, PREDECESSOR_CHARS, EMBED_CHARS = 50, 200, 512, 14_000


def coverage(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> DataFrame:
    """total, current, stale and coverage over hot messages with a vector; coverage of none is 1."""
    v = vectors.join(hot(messages).select("message_id"), "message_id", "left_semi")
    got = v.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("embed_version") == version).cast("long")), F.lit(0)).alias("current"))
    share = F.when(F.col("total") > 0, F.col("current") / F.col("total")).otherwise(1.0)
    return got.select("total", "current", (F.col("total") - F.col("current")).alias("stale"), share.alias("coverage"))


def is_tolerant(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> bool:
    return coverage(messages, vectors, version).first()["coverage"] < TOLERANT_BELOW


def search(
    messages: DataFrame, vectors: DataFrame, query: DataFrame, limit: int = 20, tolerant: bool = False, project: str | None = None,
    session: str | None = None, exclude: str | None = None, version: int = VERSION,
) -> DataFrame:
    """Hot messages by approximate cosine. ``query`` is one row (q, q_norm, q_scale); vectors of other lengths and zero norms are skipped.

    Without ``tolerant`` only current vectors take part.
    """
    v = vectors if tolerant else vectors.where(F.col("embed_version") == version)
    v = v.where(F.col("norm") > 0).crossJoin(F.broadcast(query)).where(F.size("embedding_q8") == F.size("q"))
    score = approximate_cosine(F.col("q"), F.col("q_scale"), F.col("q_norm"), F.col("embedding_q8"), F.col("quant_scale"), F.col("norm"))
    scored = v.select("message_id", score.alias("similarity"))
    m = in_scope(hot(messages), project, session, exclude)
    hits = m.join(scored, "message_id").withColumn("_r", F.round("similarity", 9))
    top = hits.orderBy(F.desc("_r"), "created_at", "message_id").limit(limit)
    return top.select("message_id", "session_id", "message_seq", "project_id", "created_at", infer_role().alias("message_role"), *preview(), "similarity", (-F.col("similarity")).alias("rank"))


def previous(messages: DataFrame) -> DataFrame:
    """(session_id, message_seq, prev_id): the hot message before each place of a session, that of the next smaller seq; of several the greatest id.

    Ids alone are ordered, within chunks of ``CHUNK`` numbers; each chunk's last is handed to the session's next chunk, whose rows
    are one a chunk. So a session of any length is many tasks, and rows that repeat a place are one before they are moved.
    """
    at = hot(messages).groupBy("session_id", "message_seq").agg(F.max("message_id").alias("_id"))
    at = at.withColumn("_chunk", F.floor(F.col("message_seq") / CHUNK))
    ends = at.groupBy("session_id", "_chunk").agg(F.max_by("_id", "message_seq").alias("_end"))
    handed = ends.select("session_id", "_chunk", F.lag("_end").over(Window.partitionBy("session_id").orderBy("_chunk")).alias("_handed"))
    inside = F.lag("_id").over(Window.partitionBy("session_id", "_chunk").orderBy("message_seq"))
    own = at.withColumn("_own", inside).join(handed, ["session_id", "_chunk"])
    return own.select("session_id", "message_seq", F.coalesce("_own", "_handed").alias("prev_id"))


def with_texts(rows: DataFrame, messages: DataFrame, column: str = "prev_id", into: str = "prev_text") -> DataFrame:
    """``rows`` with the text of the message that a column names."""
    texts = hot(messages).select(F.col("message_id").alias(column), F.col("message_text").alias(into))
    return rows.join(texts, column, "left")


def with_previous(messages: DataFrame) -> DataFrame:
    """Hot messages with the text of the hot message before them in the session (strictly smaller seq), and whether there is one."""
    m = hot(messages).join(previous(messages), ["session_id", "message_seq"], "left")
    return with_texts(m, messages).withColumn("has_previous", F.col("prev_id").isNotNull()).drop("prev_id")


def unembedded(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> DataFrame:
    """(message_id, session_id, created_at, prev_id) of hot, non-empty messages without a current vector that are long enough or have a
    predecessor. What is asked of a text is asked where it is read; no text is moved."""
    current = vectors.where(F.col("embed_version") == version).select("message_id")
    m = hot(messages).where(F.trim("message_text") != "")
    m = m.select("message_id", "session_id", "message_seq", "created_at", (F.length("message_text") >= MIN_CHARS).alias("_long"))
    m = m.join(current, "message_id", "left_anti").join(previous(messages), ["session_id", "message_seq"], "left")
    return m.where(F.col("_long") | F.col("prev_id").isNotNull()).select("message_id", "session_id", "created_at", "prev_id")


def without_vector(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> DataFrame:
    """Hot messages without a current vector, eligible or not."""
    return hot(messages).join(vectors.where(F.col("embed_version") == version).select("message_id"), "message_id", "left_anti")


def has_vectors(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(session_id, has_vectors, has_messages): whether any of a session's messages has a vector, and whether any is hot."""
    v = vectors.select("message_id", F.lit(True).alias("_v"))
    is_hot = F.max(F.col("retrieval_class") == "hot")
    return messages.join(v, "message_id", "left").groupBy("session_id").agg((F.count("_v") > 0).alias("has_vectors"), is_hot.alias("has_messages"))


def gap(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> DataFrame:
    """total hot non-empty messages and how many wait for a vector."""
    total = hot(messages).where(F.trim("message_text") != "").agg(F.count("*").alias("total"))
    return total.crossJoin(unembedded(messages, vectors, version).agg(F.count("*").alias("gap_count")))


def embed_text(text: str = "message_text", previous: str = "prev_text"):
    """A short message is embedded after the end of the one before it."""
    short = (F.length(text) < SHORT_CHARS) & F.col(previous).isNotNull() & (F.col(previous) != "")
    return F.when(short, F.concat(F.right(previous, F.lit(PREDECESSOR_CHARS)), F.lit("\n"), F.col(text))).otherwise(F.col(text))


def embed_queue(messages: DataFrame, vectors: DataFrame, limit: int | None = 80, version: int = VERSION) -> DataFrame:
    """The newest messages that wait for a vector (or all of them), with the text to embed. Texts are read for these alone."""
    top = unembedded(messages, vectors, version)
    if limit is not None:
        top = top.orderBy(F.desc("created_at"), "message_id").limit(limit)
    u = with_texts(with_texts(top, messages), messages, "message_id", "message_text")
    return u.select("message_id", "session_id", "created_at", F.substring(embed_text(), 1, EMBED_CHARS).alias("embed_text"))


def gap_sessions(messages: DataFrame, vectors: DataFrame, version: int = VERSION) -> DataFrame:
    """Sessions with messages that wait, newest such message first."""
    return unembedded(messages, vectors, version).groupBy("session_id").agg(F.max("created_at").alias("newest"), F.count("*").alias("waiting")).orderBy(F.desc("newest"))

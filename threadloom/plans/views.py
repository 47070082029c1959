"""The conversation store derived from the driver's tables: messages, a second corpus from documents, vectors.

All synthetic columns (times, projects, classes, embedding versions) are fixed here, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.vector import l2_norm, q8, q8_scale
from threadloom.plans.storage import state_of, written

EPOCH = 1_704_067_200_000
EMBED_VERSION = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user or assistant turn of ``conversations``; dropping system turns leaves gaps in message_seq."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("message_seq"),
        F.col("text").alias("message_text"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project_id"),
        (F.lit(EPOCH) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).alias("created_at"),
        F.col("role").alias("message_role"),
        F.when(F.col("conv_id") % 10 == 9, "agent").otherwise("hot").alias("retrieval_class"),
    )


_stored: dict[tuple, DataFrame] = {}


def documents_state(spark: SparkSession, sf_dir: str) -> tuple:
    """What a table made of the documents depends on: the application, whose scratch folder has it, and the files."""
    return spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/documents.parquet")


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages, stored at first use, as an ingest would: a source is a session, the role alternates."""
    key = documents_state(spark, sf_dir)
    if key not in _stored:
        _stored[key] = written(_doc_messages(spark, sf_dir), "doc-messages")
    return _stored[key]


def _doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids alone are numbered by source; the texts come by a join on the id."""
    d = table(spark, sf_dir, "documents")
    seq = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    return d.join(d.select("doc_id", seq.alias("message_seq")), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"),
        F.col("source").alias("session_id"),
        "message_seq",
        F.col("text").alias("message_text"),
        F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("project_id"),
        (F.lit(EPOCH) + F.col("doc_id") * 60_000).alias("created_at"),
        F.when(F.col("message_seq") % 2 == 0, "user").otherwise("assistant").alias("message_role"),
        F.when(F.col("source") == "src19", "agent").otherwise("hot").alias("retrieval_class"),
    )


def vectors(spark: SparkSession, sf_dir: str, stale_every: int = 50) -> DataFrame:
    """Quantised vectors of the hot documents; one in ``stale_every`` carries the version before."""
    hot = table(spark, sf_dir, "documents").where(F.col("source") != "src19").select("doc_id")
    e = table(spark, sf_dir, "embeddings").join(hot, F.col("vec_id") == F.col("doc_id"), "left_semi")
    return e.select(
        F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("message_id"),
        q8("embedding").alias("embedding_q8"),
        l2_norm("embedding").alias("norm"),
        q8_scale("embedding").alias("quant_scale"),
        F.when(F.col("vec_id") % stale_every == 0, EMBED_VERSION - 1).otherwise(EMBED_VERSION).alias("embed_version"),
    )


#: The same views in SQL, for the oracle.
MESSAGES_SQL = f"""messages AS (
  SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS message_id, 's' || conv_id::VARCHAR AS session_id, turn AS message_seq, text AS message_text,
         'p' || (conv_id % 5)::VARCHAR AS project_id, {EPOCH} + conv_id * 3600000 + turn * 60000 AS created_at, role AS message_role,
         CASE WHEN conv_id % 10 = 9 THEN 'agent' ELSE 'hot' END AS retrieval_class
  FROM conversations WHERE role IN ('user', 'assistant'))"""

DOC_MESSAGES_SQL = f"""doc_messages AS (
  SELECT 'd' || doc_id::VARCHAR AS message_id, source AS session_id, seq AS message_seq, text AS message_text, 'p' || (doc_id % 3)::VARCHAR AS project_id,
         {EPOCH} + doc_id * 60000 AS created_at, CASE WHEN seq % 2 = 0 THEN 'user' ELSE 'assistant' END AS message_role,
         CASE WHEN source = 'src19' THEN 'agent' ELSE 'hot' END AS retrieval_class
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents))"""

_SCALE_SQL = "list_max(list_transform(embedding, lambda e: abs(e::DOUBLE))) / 127.0"


def vectors_sql(stale_every: int = 50) -> str:
    return f"""vectors AS (
  SELECT 'd' || vec_id::VARCHAR AS message_id,
         CASE WHEN sc > 0 THEN list_transform(embedding, lambda e: floor(e::DOUBLE / sc + 0.5)::INT) ELSE list_transform(embedding, lambda e: 0) END AS embedding_q8,
         sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS norm, sc AS quant_scale,
         CASE WHEN vec_id % {stale_every} = 0 THEN {EMBED_VERSION - 1} ELSE {EMBED_VERSION} END AS embed_version, vec_id
  FROM (SELECT *, {_SCALE_SQL} AS sc FROM embeddings)
  WHERE vec_id IN (SELECT doc_id FROM documents WHERE source <> 'src19'))"""

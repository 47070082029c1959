"""Queries over a store and an index that grow by batches: late evidence, updates, deletions, merges. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.live_index import LiveIndex
from threadloom.operators.versioned import Versioned
from threadloom.plans import storage, views
from threadloom.plans.registry import _FTS_OUT, _OR, _TOKENS, OR_PLAN, D, _bm25_sql, query
from threadloom.plans.views import DOC_MESSAGES_SQL, table
from threadloom.streaming import ingest


def _store(spark: SparkSession) -> Versioned:
    return Versioned(spark, storage.scratch(spark, "store"), ingest.MESSAGE_SCHEMA)


def _sessions(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "session_id string")


_made: dict[tuple, tuple[Versioned, LiveIndex]] = {}


def _grown(spark: SparkSession, sf_dir: str) -> tuple[Versioned, LiveIndex]:
    """The store and index of ``_grow``, made at first use."""
    key = views.documents_state(spark, sf_dir)
    if key not in _made:
        _made[key] = _grow(spark, sf_dir)
    return _made[key]


def _grow(spark: SparkSession, sf_dir: str) -> tuple[Versioned, LiveIndex]:
    """The documents in three batches by project; then src3 turns out to be a sub-agent's, src5 says something else in p1, src7 is deleted.

    The index follows at three points, so it sees single commits and several at once.
    """
    m, store = views.doc_messages(spark, sf_dir), _store(spark)
    index = LiveIndex(spark, storage.scratch(spark, "live-index"), stems=False)
    store.insert(m.where("project_id = 'p0'"))
    index.follow(store)
    store.insert(m.where("project_id = 'p1'"))
    store.insert(m.where("project_id = 'p2'"), cold=_sessions(spark, "src3"))
    index.follow(store)
    store.update(m.where("session_id = 'src5' and project_id = 'p1'").withColumn("message_text", F.concat(F.lit("walrus narwhal "), F.reverse("message_text"))))
    store.delete(_sessions(spark, "src7"))
    index.follow(store)
    return store, index


_GROWN = f"""WITH {DOC_MESSAGES_SQL.replace("doc_messages AS", "before AS", 1)},
doc_messages AS (
  SELECT * REPLACE (CASE WHEN session_id = 'src3' THEN 'agent' ELSE retrieval_class END AS retrieval_class,
                    CASE WHEN session_id = 'src5' AND project_id = 'p1' THEN 'walrus narwhal ' || reverse(message_text) ELSE message_text END AS message_text)
  FROM before WHERE session_id <> 'src7'),
t AS (SELECT *, regexp_extract_all(lower(message_text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM doc_messages WHERE retrieval_class = 'hot')"""


@query(_GROWN + " SELECT * FROM doc_messages")
def ingest_late_agent(spark, sf_dir):
    return _grown(spark, sf_dir)[0].read()


@query(_GROWN + ", x AS (SELECT message_id, unnest(toks) AS term FROM t) SELECT term, count(DISTINCT message_id) AS doc, count(*) AS cnt FROM x GROUP BY term")
def fts_upkeep(spark, sf_dir):
    return _grown(spark, sf_dir)[1].vocabulary()


@query(f"{_GROWN}, {_bm25_sql(_OR, 'f1 > 0 OR f2 > 0 OR f3 > 0', 20)}{_FTS_OUT}")
def fts_upkeep_search(spark, sf_dir):
    held, index = _grown(spark, sf_dir)
    return index.search(held.read(), "", 20, plan=OR_PLAN).withColumn("rank", F.round("rank", 6))


@query(f"{_TOKENS}, x AS (SELECT message_id, unnest(toks) AS term FROM t) SELECT term, message_id, count(*) AS tf FROM x WHERE starts_with(term, 'li') GROUP BY term, message_id")
def fts_upkeep_prefix(spark, sf_dir):
    """Postings of a prefix after three batches, of which two have been merged."""
    m, store = views.doc_messages(spark, sf_dir), _store(spark)
    index = LiveIndex(spark, storage.scratch(spark, "live-index"), stems=False, tier=2)
    for k in range(3):
        store.insert(m.where(F.pmod(F.xxhash64("message_id"), F.lit(3)) == k))
        index.follow(store)
    return index.postings().where(F.startswith("term", F.lit("li"))).select("term", "message_id", F.size("positions").cast("long").alias("tf"))


@query(D + " SELECT session_id, count(*) AS n, sum(message_seq)::BIGINT AS seqs FROM doc_messages WHERE session_id <> 'src1' GROUP BY session_id")
def store_compaction(spark, sf_dir):
    """Ten batches and a deletion, merged in tiers and then to one segment."""
    m, store = views.doc_messages(spark, sf_dir), _store(spark)
    for k in range(10):
        store.insert(m.where(F.pmod(F.xxhash64("message_id"), F.lit(10)) == k))
    store.delete(_sessions(spark, "src1"))
    store.compact()
    return store.read().groupBy("session_id").agg(F.count("*").alias("n"), F.sum("message_seq").alias("seqs"))


@query("""SELECT 's' || conv_id::VARCHAR AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'claude' ELSE 'codex' END AS vendor,
CASE WHEN conv_id % 5 = 0 THEN 'agent' ELSE 'root' END AS kind, CASE WHEN conv_id % 2 = 0 THEN 'zzz' END AS parent_session_id,
CASE WHEN conv_id % 3 = 0 THEN '/a/' ELSE '/b/' END || max(turn)::VARCHAR AS transcript_path FROM conversations GROUP BY conv_id""")
def ingest_provenance(spark, sf_dir):
    """Two scans tell of every conversation; the second of a third of them, without parents, and of every fifth that it is a sub-agent's."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("string").alias("last"))
    told = Versioned(spark, storage.scratch(spark, "provenance"), ingest.PROVENANCE_SCHEMA, None)
    row = lambda vendor, kind, parent, folder: (
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.lit(vendor).alias("vendor"), kind.alias("kind"), parent.alias("parent_session_id"),
        F.concat(F.lit(folder), "last").alias("transcript_path"),
    )
    kind = F.when(F.col("conv_id") % 5 == 0, "agent").otherwise("root")
    told.append(c.select(*row("codex", kind, F.when(F.col("conv_id") % 2 == 0, "zzz"), "/b/")))
    told.append(c.where("conv_id % 3 = 0").select(*row("claude", F.lit("root"), F.lit(None).cast("string"), "/a/")))
    return ingest.latest_provenance(told)

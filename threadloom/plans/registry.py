"""The registered queries of the conversation engine, and for each the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import vector as V
from threadloom.functions.query_text import And, Not, Or, Phrase
from threadloom.functions.stem import tokens
from threadloom.operators import attribution, fulltext, fusion, messages, search, semantic, store
from threadloom.operators.search_index import Index
from threadloom.plans import storage, views
from threadloom.plans.views import DOC_MESSAGES_SQL, EPOCH, MESSAGES_SQL, doc_messages, table, vectors_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


M, D = f"WITH {MESSAGES_SQL}", f"WITH {DOC_MESSAGES_SQL}"
HOUR = 3_600_000

# --- listing and reading -------------------------------------------------------------------------------------------

_LIST = """ SELECT session_id, min(created_at) AS first_activity, max(created_at) AS last_activity, count(*) AS message_count, NULL::VARCHAR AS title
FROM messages WHERE retrieval_class = 'hot'{where} GROUP BY session_id ORDER BY last_activity DESC, session_id LIMIT {limit}"""


@query(M + _LIST.format(where="", limit=50))
def agg_list_sessions(spark, sf_dir):
    return messages.list_sessions(views.messages(spark, sf_dir))


@query(M + _LIST.format(where=f" AND created_at >= {EPOCH + 20 * HOUR} AND created_at <= {EPOCH + 70 * HOUR}", limit=50))
def flt_since_until(spark, sf_dir):
    return messages.list_sessions(views.messages(spark, sf_dir), since=EPOCH + 20 * HOUR, until=EPOCH + 70 * HOUR)


@query(M + _LIST.format(where=" AND project_id = 'p2' AND session_id <> 's7'", limit=10))
def flt_scope(spark, sf_dir):
    return messages.list_sessions(views.messages(spark, sf_dir), limit=10, project="p2", exclude="s7")


@query(M + " SELECT session_id, count(*) AS message_count FROM messages WHERE retrieval_class = 'hot' GROUP BY session_id")
def agg_session_count(spark, sf_dir):
    return messages.hot(views.messages(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("message_count"))


@query(M + " SELECT * FROM messages WHERE retrieval_class = 'hot'")
def flt_hot(spark, sf_dir):
    return messages.hot(views.messages(spark, sf_dir))


_PAGE = """ SELECT m.*, t.n AS total_messages, t.n > {end} AS has_more FROM messages m, (SELECT count(*) AS n FROM messages WHERE session_id = 's3') t
WHERE session_id = 's3' ORDER BY message_seq {way}, message_id LIMIT 3 OFFSET {at}"""


@query(M + _PAGE.format(way="ASC", at=1, end=4))
def page_session(spark, sf_dir):
    return messages.read_session(views.messages(spark, sf_dir), "s3", 1, 3)


@query(M + _PAGE.format(way="DESC", at=0, end=3))
def page_session_reverse(spark, sf_dir):
    return messages.read_session(views.messages(spark, sf_dir), "s3", 0, 3, reverse=True)


@query(M + " SELECT * FROM messages WHERE session_id = 's5' AND message_seq BETWEEN 1 AND 5")
def win_adjacent(spark, sf_dir):
    return messages.adjacent(views.messages(spark, sf_dir), "s5", 3, 2)


@query(D + """, t AS (SELECT * FROM doc_messages WHERE message_id = 'd27'), n AS (SELECT m.*, t.message_seq AS seq, t.message_role AS r FROM doc_messages m JOIN t USING (session_id))
SELECT any_value(seq) AS message_seq,
  CASE WHEN any_value(r) = 'user' THEN max(message_text) FILTER (WHERE message_seq = seq) ELSE coalesce(max(message_text) FILTER (WHERE message_seq = seq - 1), '') END AS user_text,
  CASE WHEN any_value(r) = 'user' THEN coalesce(max(message_text) FILTER (WHERE message_seq = seq + 1), '') ELSE max(message_text) FILTER (WHERE message_seq = seq) END AS assistant_text
FROM n""")
def read_turn(spark, sf_dir):
    return messages.read_turn(doc_messages(spark, sf_dir), "src7", "d27")


@query(M + " SELECT * FROM messages WHERE session_id = 's4' AND message_id = '4-2'")
def read_message(spark, sf_dir):
    return views.messages(spark, sf_dir).where("session_id = 's4' AND message_id = '4-2'")


_GREP = """, n AS (SELECT *, regexp_extract(message_text, '(?i){p}') AS hit FROM (SELECT * FROM {view} WHERE retrieval_class = 'hot' ORDER BY created_at DESC, message_id LIMIT 2000) WHERE regexp_matches(message_text, '(?i){p}')),
p AS (SELECT *, instr(message_text, hit) - 1 AS a FROM n)
SELECT session_id, message_id, message_seq,
  (CASE WHEN a > 40 THEN '...' ELSE '' END) || substr(message_text, greatest(0, a - 40) + 1, least(length(message_text), a + length(hit) + 40) - greatest(0, a - 40)) ||
  (CASE WHEN a + length(hit) + 40 < length(message_text) THEN '...' ELSE '' END) AS match_context, created_at, message_role
FROM p ORDER BY created_at DESC, message_id LIMIT {limit}"""


@query(D + _GREP.format(p="li[cz]en[a-z]+", view="doc_messages", limit=20))
def flt_grep(spark, sf_dir):
    return messages.grep(doc_messages(spark, sf_dir), "li[cz]en[a-z]+")


@query(D + _GREP.format(p="\\*\\*\\*", view="doc_messages", limit=5))
def flt_grep_literal(spark, sf_dir):
    return messages.grep(doc_messages(spark, sf_dir), "***", limit=5)


@query(M + """ SELECT count(*) FILTER (WHERE retrieval_class = 'hot') AS hot_count, count(*) FILTER (WHERE retrieval_class = 'agent') AS agent_count,
max(created_at) FILTER (WHERE retrieval_class = 'hot') AS last_indexed_at, count(DISTINCT session_id) AS session_count FROM messages""")
def agg_status(spark, sf_dir):
    return messages.status(views.messages(spark, sf_dir))


def _aliases(spark, sf_dir):
    ids = views.messages(spark, sf_dir).select("session_id").distinct()
    return ids, ids.select("session_id", F.concat(F.lit("alias-"), F.col("session_id")).alias("alias_id"))


_RESOLVE = """, i AS (SELECT DISTINCT session_id FROM messages), n AS (SELECT session_id, session_id AS name, 0 AS alias FROM i UNION ALL SELECT session_id, 'alias-' || session_id, 1 FROM i),
t AS (SELECT *, CASE WHEN name = '{r}' THEN alias ELSE 2 END AS tier FROM n WHERE starts_with(name, '{r}'))
SELECT DISTINCT session_id, ['id', 'alias', 'prefix'][tier + 1] AS how FROM t WHERE tier = (SELECT min(tier) FROM t)"""


@query(M + _RESOLVE.format(r="s1"))
def resolve_ref(spark, sf_dir):
    return messages.resolve(*_aliases(spark, sf_dir), "s1")


@query(M + _RESOLVE.format(r="alias-s2"))
def alias_resolve(spark, sf_dir):
    return messages.resolve(*_aliases(spark, sf_dir), "alias-s2")


@query(M + _RESOLVE.format(r="alias-s"))
def flt_prefix(spark, sf_dir):
    return messages.resolve(*_aliases(spark, sf_dir), "alias-s")


@query(D + " SELECT message_id, substr(message_text, 1, 400) AS message_preview, length(message_text) > 400 AS truncated FROM doc_messages")
def prj_preview(spark, sf_dir):
    return doc_messages(spark, sf_dir).select("message_id", *messages.preview())


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE role END AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN r IN ('user', 'assistant') THEN r WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM c""")
def prj_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("r", F.when(F.col("role") != "system", F.col("role")))
    return c.select("conv_id", "turn", messages.infer_role("r", "turn").alias("role"))


@query(M + """, w AS (SELECT *, sum(length(message_text)) OVER w AS chars_used, row_number() OVER w AS n FROM messages
WINDOW w AS (PARTITION BY session_id ORDER BY message_seq, message_id ROWS UNBOUNDED PRECEDING))
SELECT * EXCLUDE (n) REPLACE (chars_used::BIGINT AS chars_used) FROM w WHERE chars_used <= 600 OR n = 1""")
def win_char_budget(spark, sf_dir):
    return messages.within_budget(views.messages(spark, sf_dir), 600)


@query()
def win_center_budget(spark, sf_dir):
    return messages.centred(doc_messages(spark, sf_dir), "src3", 5)


@query(D + " SELECT message_id, message_seq, lead(message_seq) OVER (PARTITION BY session_id ORDER BY message_seq) AS next_seq FROM doc_messages WHERE retrieval_class = 'hot'")
def win_neighbours(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("session_id").orderBy("message_seq")
    return messages.hot(doc_messages(spark, sf_dir)).select("message_id", "message_seq", F.lead("message_seq").over(w).alias("next_seq"))


# --- vectors -------------------------------------------------------------------------------------------------------

_E = f"""e AS (SELECT vec_id, embedding, sc, CASE WHEN sc > 0 THEN list_transform(embedding, lambda x: floor(x::DOUBLE / sc + 0.5)::INT) ELSE list_transform(embedding, lambda x: 0) END AS q,
sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM (SELECT *, {views._SCALE_SQL} AS sc FROM embeddings))"""
_Q0 = "z AS (SELECT q AS zq, norm AS zn, sc AS zs, embedding AS ze FROM e WHERE vec_id = 0)"


def _query_vector(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0")
    return q.select(V.q8("embedding").alias("q"), V.l2_norm("embedding").alias("q_norm"), V.q8_scale("embedding").alias("q_scale"))


@query(f"WITH {_E} SELECT vec_id, array_to_string(q, ',') AS q8, round(sc, 12) AS quant_scale FROM e")
def vec_quantize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_join(V.q8("embedding").cast("array<string>"), ",").alias("q8"), F.round(V.q8_scale("embedding"), 12).alias("quant_scale"))


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(q, lambda x: abs(x * sc))), 6) AS magnitude FROM e")
def vec_dequantize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.dequantise(V.q8("embedding"), V.q8_scale("embedding")).alias("d"))
    return e.select("vec_id", F.round(F.aggregate(F.transform("d", F.abs), F.lit(0.0), lambda s, x: s + x), 6).alias("magnitude"))


@query(f"WITH {_E} SELECT vec_id, round(norm, 9) AS norm FROM e")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.l2_norm("embedding"), 9).alias("norm"))


@query(f"WITH {_E}, {_Q0} SELECT vec_id, list_sum(list_transform(list_zip(q, zq), lambda p: p[1] * p[2]))::BIGINT AS dot FROM e, z")
def vec_dot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.q8("embedding").alias("v"))
    return e.crossJoin(F.broadcast(_query_vector(spark, sf_dir))).select("vec_id", V.dot("v", "q").alias("dot"))


@query(f"WITH {_E}, {_Q0} SELECT vec_id, round(CASE WHEN norm * zn > 0 THEN list_sum(list_transform(list_zip(embedding, ze), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (norm * zn) ELSE 0 END, 6) AS cosine FROM e, z")
def vec_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("z")))
    return e.crossJoin(q).select("vec_id", F.round(V.cosine("embedding", "z"), 6).alias("cosine"))


def _search_sql(every: int, limit: int, where: str = "") -> str:
    return f"""sem AS (
  SELECT m.*, list_sum(list_transform(list_zip(v.embedding_q8, zq), lambda p: p[1] * p[2]))::BIGINT * zs * v.quant_scale / (zn * v.norm) AS similarity
  FROM doc_messages m JOIN vectors v USING (message_id), z WHERE m.retrieval_class = 'hot' AND v.norm > 0 {where}),
top_sem AS (SELECT *, row_number() OVER (ORDER BY round(similarity, 9) DESC, created_at, message_id) - 1 AS pos FROM sem QUALIFY pos < {limit})"""


def _vectors_cte(every: int) -> str:
    return f"WITH {_E}, {_Q0}, {DOC_MESSAGES_SQL}, {vectors_sql(every)}"


_SEARCH_OUT = " SELECT message_id, session_id, message_seq, project_id, message_role, created_at, substr(message_text, 1, 400) AS message_preview, length(message_text) > 400 AS truncated, round(similarity, 6) AS similarity, round(-similarity, 6) AS rank FROM top_sem"


def _rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.round("rank", 6))


@query(f"{_vectors_cte(50)}, {_search_sql(50, 20, 'AND v.embed_version = 3')}{_SEARCH_OUT}")
def vec_search_hard(spark, sf_dir):
    return _rounded(semantic.search(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir, 50), _query_vector(spark, sf_dir)))


@query(f"{_vectors_cte(10)}, {_search_sql(10, 20)}{_SEARCH_OUT}")
def vec_search_tolerant(spark, sf_dir):
    m, v = doc_messages(spark, sf_dir), views.vectors(spark, sf_dir, 10)
    return _rounded(semantic.search(m, v, _query_vector(spark, sf_dir), tolerant=semantic.is_tolerant(m, v)))


@query(_vectors_cte(50) + """, v AS (SELECT * FROM vectors WHERE message_id IN (SELECT message_id FROM doc_messages WHERE retrieval_class = 'hot'))
SELECT count(*) AS total, count(*) FILTER (WHERE embed_version = 3) AS current, count(*) FILTER (WHERE embed_version <> 3) AS stale,
round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE embed_version = 3) / count(*) ELSE 1 END, 9) AS coverage FROM v""")
def agg_version_cov(spark, sf_dir):
    return semantic.coverage(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


_WAIT = """, p AS (SELECT *, lag(message_text) OVER w AS prev_text, row_number() OVER w > 1 AS has_previous FROM doc_messages WHERE retrieval_class = 'hot' WINDOW w AS (PARTITION BY session_id ORDER BY message_seq)),
wait AS (SELECT * FROM p WHERE trim(message_text) <> '' AND (length(message_text) >= 50 OR has_previous) AND message_id NOT IN (SELECT message_id FROM vectors WHERE embed_version = 3))"""


@query(_vectors_cte(50) + _WAIT + " SELECT (SELECT count(*) FROM doc_messages WHERE retrieval_class = 'hot' AND trim(message_text) <> '') AS total, (SELECT count(*) FROM wait) AS gap_count")
def agg_gap(spark, sf_dir):
    return semantic.gap(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir))


@query(_vectors_cte(50) + _WAIT + """ SELECT message_id, session_id, created_at,
substr(CASE WHEN length(message_text) < 200 AND prev_text IS NOT NULL AND prev_text <> '' THEN right(prev_text, 512) || chr(10) || message_text ELSE message_text END, 1, 14000) AS embed_text
FROM wait ORDER BY created_at DESC, message_id LIMIT 80""")
def embed_select(spark, sf_dir):
    return semantic.embed_queue(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir))


@query(_vectors_cte(50) + _WAIT + " SELECT session_id, max(created_at) AS newest, count(*) AS waiting FROM wait GROUP BY session_id")
def newest_gap_sessions(spark, sf_dir):
    return semantic.gap_sessions(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir))


@query(_vectors_cte(50) + " SELECT message_id FROM doc_messages WHERE retrieval_class = 'hot' AND message_id NOT IN (SELECT message_id FROM vectors WHERE embed_version = 3)")
def anti_unembedded(spark, sf_dir):
    return semantic.without_vector(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir)).select("message_id")


@query(M + """ SELECT m.message_id, (SELECT p.message_text FROM messages p WHERE p.session_id = m.session_id AND p.retrieval_class = 'hot' AND p.message_seq < m.message_seq
ORDER BY p.message_seq DESC LIMIT 1) AS prev_text FROM messages m WHERE m.retrieval_class = 'hot'""")
def asof_prev_text(spark, sf_dir):
    return semantic.with_previous(views.messages(spark, sf_dir)).select("message_id", "prev_text")


# --- keyword search ------------------------------------------------------------------------------------------------

_TOKENS = D + r""", t AS (SELECT *, regexp_extract_all(lower(message_text), '[\p{L}\p{N}]+') AS toks FROM doc_messages WHERE retrieval_class = 'hot')"""


@query(_TOKENS + " SELECT message_id, len(toks) AS n_tokens, array_to_string(list_slice(toks, 1, 5), ' ') AS first_tokens FROM t")
def fts_tokenize(spark, sf_dir):
    t = messages.hot(doc_messages(spark, sf_dir)).select("message_id", tokens("message_text").alias("t"))
    return t.select("message_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


_indexes: dict[tuple, Index] = {}


def _index(spark, sf_dir, stems=False) -> Index:
    """The stored postings of the documents' messages; written at first use."""
    key = (*views.documents_state(spark, sf_dir), stems)
    if key not in _indexes:
        _indexes[key] = Index.build(doc_messages(spark, sf_dir), storage.scratch(spark, "index"), stems)
    return _indexes[key]


@query(_TOKENS + ", x AS (SELECT message_id, unnest(toks) AS term FROM t) SELECT term, count(DISTINCT message_id) AS doc, count(*) AS cnt FROM x GROUP BY term")
def fts_vocab(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary()


@query(_TOKENS + ", x AS (SELECT message_id, unnest(toks) AS term FROM t) SELECT term, message_id, count(*) AS tf FROM x GROUP BY term, message_id")
def fts_index(spark, sf_dir):
    return _index(spark, sf_dir).postings().select("term", "message_id", F.size("positions").cast("long").alias("tf"))


@query()
def fts_index_stemmed(spark, sf_dir):
    return _index(spark, sf_dir, True).postings().select("term", "message_id", F.size("positions").cast("long").alias("tf"))


WORDS = ["the", "license", "public", "trash", "und", "clown", "nowhere"]
_SHARES = _TOKENS + f""", s AS (SELECT w.term, w.i, count(*) FILTER (WHERE list_contains(toks, w.term)) AS doc, count(*) AS n FROM t, (SELECT unnest({WORDS}) AS term, generate_subscripts({WORDS}, 1) AS i) w GROUP BY ALL)"""


def _shares(spark, sf_dir):
    return _index(spark, sf_dir).shares(WORDS)


@query(_SHARES + " SELECT term, doc, round(doc / n, 9) AS share FROM s")
def agg_df(spark, sf_dir):
    return _shares(spark, sf_dir).select("term", "doc", F.round("share", 9).alias("share"))


@query(_SHARES + " SELECT term, doc, round(doc / n, 9) AS share FROM s ORDER BY doc / n, i LIMIT 5")
def rarest5(spark, sf_dir):
    return _shares(spark, sf_dir).orderBy("share", "i").limit(5).select("term", "doc", F.round("share", 9).alias("share"))


@query(_SHARES + " SELECT term FROM s WHERE doc / n < 0.15")
def idf_filter(spark, sf_dir):
    return _shares(spark, sf_dir).where("share < 0.15").select("term")


def _bm25_sql(counts: dict[str, str], where: str, limit: int) -> str:
    """``counts``: name -> SQL over toks."""
    cols = ", ".join(f"{sql} AS {n}" for n, sql in counts.items())
    stats = ", ".join(f"count(*) FILTER (WHERE {n} > 0) AS n_{n}" for n in counts)
    idf = {n: f"(CASE WHEN ln((n - n_{n} + 0.5) / (n_{n} + 0.5)) > 0 THEN ln((n - n_{n} + 0.5) / (n_{n} + 0.5)) ELSE 1e-6 END)" for n in counts}
    score = " + ".join(f"{idf[n]} * {n} * 2.2 / ({n} + 1.2 * (1 - 0.75 + 0.75 * len(toks) / avgdl))" for n in counts)
    return f"""f AS (SELECT *, {cols} FROM t), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl, {stats} FROM f),
hits AS (SELECT f.*, -({score}) AS rank FROM f, st WHERE {where}),
top_fts AS (SELECT *, row_number() OVER (ORDER BY round(rank, 9), created_at, message_id) - 1 AS pos FROM hits QUALIFY pos < {limit})"""


def _term(w: str) -> str:
    return f"len(list_filter(toks, lambda x: x = '{w}'))"


_FTS_OUT = " SELECT message_id, session_id, message_seq, project_id, message_role, created_at, substr(message_text, 1, 400) AS message_preview, length(message_text) > 400 AS truncated, round(rank, 6) AS rank FROM top_fts"
OR_PLAN = Or((Phrase(("license",)), Phrase(("trash",)), Phrase(("clown",))))
_OR = {"f1": _term("license"), "f2": _term("trash"), "f3": _term("clown")}
_PHRASE = "CASE WHEN len(toks) >= 3 THEN len(list_filter(range(1, len(toks) - 1), lambda i: toks[i] = 'general' AND toks[i + 1] = 'public' AND toks[i + 2] = 'license')) ELSE 0 END"


def _keyword(spark, sf_dir, plan, limit=20, **scope):
    return _index(spark, sf_dir).search(doc_messages(spark, sf_dir), "", limit, plan=plan, **scope).withColumn("rank", F.round("rank", 6))


@query(f"{_TOKENS}, {_bm25_sql(_OR, 'f1 > 0 OR f2 > 0 OR f3 > 0', 20)}{_FTS_OUT}")
def fts_bm25_or(spark, sf_dir):
    return _keyword(spark, sf_dir, OR_PLAN)


@query(f"{_TOKENS}, {_bm25_sql({'f1': _term('the'), 'f2': _term('license'), 'f3': _term('clown')}, '(f1 > 0 OR f2 > 0) AND NOT f3 > 0', 20)}{_FTS_OUT}")
def fts_block_max(spark, sf_dir):
    """A frequent term with a rarer one: blocks that can't reach the twentieth place aren't scored."""
    return _keyword(spark, sf_dir, Not(Or((Phrase(("the",)), Phrase(("license",)))), Phrase(("clown",))))


@query(f"{_TOKENS}, {_bm25_sql({'f1': _term('the'), 'f2': _term('license')}, 'f1 > 0 AND f2 > 0', 20)}{_FTS_OUT}")
def fts_bm25_and(spark, sf_dir):
    return _keyword(spark, sf_dir, And((Phrase(("the",)), Phrase(("license",)))))


@query(f"{_TOKENS}, {_bm25_sql({'f1': _term('license'), 'f2': _term('general')}, 'f1 > 0 AND NOT f2 > 0', 20)}{_FTS_OUT}")
def fts_bm25_not(spark, sf_dir):
    return _keyword(spark, sf_dir, Not(Phrase(("license",)), Phrase(("general",))))


@query()
def fts_snippet_best(spark, sf_dir):
    """Every document with one of the phrases, with the window that covers most."""
    m, index = doc_messages(spark, sf_dir), _index(spark, sf_dir)
    plan = Or((Phrase(("general", "public", "license")), Phrase(("the",)), Phrase(("clown",))))
    hits = m.join(index.match(plan).select("message_id"), "message_id").select("message_id", "message_text")
    return fulltext.best_snippets(index, hits, plan).drop("message_text")


@query(f"{_TOKENS}, {_bm25_sql({'f1': _PHRASE}, 'f1 > 0', 20)}{_FTS_OUT}")
def fts_phrase(spark, sf_dir):
    return _keyword(spark, sf_dir, Phrase(("general", "public", "license")))


_PREFIX = "len(list_filter(toks, lambda x: starts_with(x, 'licen')))"


@query(f"{_TOKENS}, {_bm25_sql({'f1': _PREFIX}, 'f1 > 0', 20)}{_FTS_OUT}")
def fts_prefix(spark, sf_dir):
    return _keyword(spark, sf_dir, Phrase(("licen",), prefix=True))


@query(f"{_TOKENS}, {_bm25_sql(_OR, '(f1 > 0 OR f2 > 0 OR f3 > 0)', 1_000_000)} SELECT session_id, count(*) AS hits FROM top_fts WHERE project_id = 'p1' AND session_id <> 'src4' GROUP BY ROLLUP (session_id)")
def agg_fts_meta(spark, sf_dir):
    """Hits of each session, and of all in the row without a session."""
    return _index(spark, sf_dir).counts(OR_PLAN, project="p1", exclude="src4")


@query(f"""{_TOKENS}, {_bm25_sql(_OR, "(f1 > 0 OR f2 > 0 OR f3 > 0) AND project_id = 'p1'", 10)}{_FTS_OUT}""")
def join_fts_msgs(spark, sf_dir):
    return _keyword(spark, sf_dir, OR_PLAN, 10, project="p1")


@query(_TOKENS + """, x AS (SELECT DISTINCT message_id, session_id, unnest(toks) AS term FROM t)
SELECT term, message_id, 'stale' AS state FROM x WHERE session_id = 'src2'""")
def fts_integrity(spark, sf_dir):
    """What the index holds of a session that has gone since."""
    return _index(spark, sf_dir).differences(doc_messages(spark, sf_dir).where("session_id <> 'src2'"))


@query(_TOKENS + ", x AS (SELECT message_id, unnest(toks) AS term FROM t WHERE project_id = 'p1') SELECT term, count(DISTINCT message_id) AS doc, count(*) AS cnt FROM x GROUP BY term")
def fts_rebuild(spark, sf_dir):
    """The vocabulary of an index made anew over what is left."""
    left = doc_messages(spark, sf_dir).where("project_id = 'p1'")
    return Index.build(left, storage.scratch(spark, "rebuilt"), stems=False).vocabulary()


def _stem(*endings: str, of: str) -> str:
    return f"len(list_filter(toks, lambda x: regexp_full_match(x, '{of}({'|'.join(endings)})?')))"


_STEMS = {"f1": _stem("e", "es", "ed", "ing", of="licens"), "f2": _stem("s", "ed", "ing", of="clown"), "f3": _stem("es", "ed", "ing", of="trash")}


@query(f"{_TOKENS}, {_bm25_sql(_STEMS, 'f1 > 0 OR f2 > 0 OR f3 > 0', 20)}{_FTS_OUT}")
def fts_stem(spark, sf_dir):
    """Words in other forms than the messages': the index holds stems, and so does the query. The SQL lists the forms."""
    index = _index(spark, sf_dir, True)
    found = index.search(doc_messages(spark, sf_dir), "licensing clowns trashed", skip_idf=True)
    return found.withColumn("rank", F.round("rank", 6))


@query()
def fts_match_bm25(spark, sf_dir):
    """From what a user types, by the clean-up rules, over stems, with marked snippets."""
    m, index = doc_messages(spark, sf_dir), _index(spark, sf_dir, True)
    plan = index.plan_of("the public licenses and clown-trash")
    found = index.search(m, "", plan=plan).join(m.select("message_id", "message_text"), "message_id")
    return fulltext.best_snippets(index, found, plan).drop("message_text")


_RAW = ["", "foo bar", "claude-transcript", 'foo"bar', '"hello world"', "walk*", "foo:bar a b", "The the THE", "a AND (b)", "x-y-z", "[*^]", "license the public trash und clown", "the und"]


@query("""SELECT * FROM (VALUES (0, NULL), (1, '"foo" "bar"'), (2, '"claude" "transcript"'), (3, 'foobar'), (4, '"hello world"'), (5, 'walk*'), (6, '"foobar" OR "a" OR "b"'), (7, 'the'), (8, 'a AND b'),
(9, '"x" "y-z"'), (10, NULL), (11, '"license" OR "the" OR "public" OR "trash" OR "und" OR "clown"'), (12, '"the" "und"')) AS t(i, expression)""")
def fts_sanitize(spark, sf_dir):
    """What is typed, and the expression that is looked for (without the vocabulary's shares); the SQL states the rules' results."""
    from threadloom.functions.query_text import clean

    return spark.createDataFrame([(i, clean(x)) for i, x in enumerate(_RAW)], "i int, expression string")


# --- fusion --------------------------------------------------------------------------------------------------------

NOW = EPOCH + 400 * 24 * HOUR
LIMIT = 40


def _fused_sql(decay: float | None) -> str:
    rec = "1.0" if not decay else f"(1 / (1 + greatest(0, {NOW} - created_at) / 86400000.0 * {decay}))"
    return f"""{_vectors_cte(50)}, t AS (SELECT *, regexp_extract_all(lower(message_text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM doc_messages WHERE retrieval_class = 'hot'),
{_bm25_sql(_OR, 'f1 > 0 OR f2 > 0 OR f3 > 0', 3 * LIMIT)}, {_search_sql(50, 3 * LIMIT, 'AND v.embed_version = 3')},
u AS (SELECT message_id, session_id, message_seq, created_at, message_text, pos, 'fts' AS path FROM top_fts UNION ALL SELECT message_id, session_id, message_seq, created_at, message_text, pos, 'semantic' FROM top_sem),
g AS (SELECT message_id, session_id, message_seq, created_at, substr(any_value(message_text), 1, 400) AS message_preview,
  coalesce(max(1 / (60 + pos) * {rec}) FILTER (WHERE path = 'fts'), 0) + coalesce(max(1 / (60 + pos) * {rec}) FILTER (WHERE path = 'semantic'), 0) AS s,
  min(pos) FILTER (WHERE path = 'fts') AS fts_pos, min(pos) FILTER (WHERE path = 'semantic') AS sem_pos FROM u GROUP BY 1, 2, 3, 4),
b AS (SELECT *, CASE WHEN session_id IN (SELECT session_id FROM top_fts) THEN s ELSE s * 1.05 END AS score,
  CASE WHEN fts_pos IS NOT NULL AND sem_pos IS NOT NULL THEN 'FTS5+SEMANTIC' WHEN sem_pos IS NOT NULL THEN 'SEMANTIC-ONLY' ELSE 'FTS5-ONLY' END AS tag FROM g),
fused AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, fts_pos ASC NULLS LAST, sem_pos ASC NULLS LAST, message_id) AS place FROM b),
dr AS (SELECT place, round((score - lead(score) OVER (ORDER BY place)) / score, 12) AS d FROM fused WHERE score > 0),
mx AS (SELECT max(d) AS d FROM dr WHERE place > 10),
cut AS (SELECT min(place) AS c FROM dr, mx WHERE place > 10 AND dr.d = mx.d AND mx.d > 0.15),
trimmed AS (SELECT fused.* FROM fused, cut WHERE c IS NULL OR place <= c)"""


_FUSED_OUT = " SELECT message_id, session_id, message_seq, created_at, message_preview, round(score, 9) AS score, fts_pos, sem_pos, place, tag FROM {}"


def _fused(spark, sf_dir, decay=None):
    m, v = doc_messages(spark, sf_dir), views.vectors(spark, sf_dir, 50)
    k = fusion.ranked(_index(spark, sf_dir).search(m, "", LIMIT * fusion.FETCH, plan=OR_PLAN).withColumn("_r", F.round("rank", 9)), "fts", "_r", "created_at", "message_id")
    s = semantic.search(m, v, _query_vector(spark, sf_dir), LIMIT * fusion.FETCH, semantic.is_tolerant(m, v))
    s = fusion.ranked(s.withColumn("_r", -F.round("similarity", 9)), "semantic", "_r", "created_at", "message_id")
    return fusion.fuse(k, s, NOW, decay)


def _shown(df):
    return df.withColumn("score", F.round("score", 9))


@query(_fused_sql(None) + _FUSED_OUT.format("fused"))
def hybrid_search(spark, sf_dir):
    return _shown(_fused(spark, sf_dir))


@query(_fused_sql(0.1) + _FUSED_OUT.format("fused"))
def hybrid_recent(spark, sf_dir):
    return _shown(_fused(spark, sf_dir, 0.1))


@query(_fused_sql(None) + _FUSED_OUT.format("fused") + f" WHERE place <= {LIMIT}")
def raw_messages(spark, sf_dir):
    return _shown(_fused(spark, sf_dir)).where(F.col("place") <= LIMIT)


@query(_fused_sql(None) + _FUSED_OUT.format("trimmed"))
def score_gap(spark, sf_dir):
    return _shown(fusion.score_gap(_fused(spark, sf_dir)))


_SESSIONS = """, ss AS (SELECT session_id, min(place) AS f, count(*) AS hits, max(fts_pos IS NOT NULL) AS a, max(sem_pos IS NOT NULL) AS b FROM trimmed GROUP BY session_id)
SELECT row_number() OVER (ORDER BY f) AS rank, ss.session_id, hits, round(x.score, 9) AS score, x.message_id AS best_message_id, x.message_seq AS best_message_seq,
CASE WHEN a AND b THEN '[FTS5+SEMANTIC]' WHEN b THEN '[SEMANTIC-ONLY]' ELSE '[FTS5-ONLY]' END AS tag, replace(x.message_preview, chr(10), ' ') AS snippet,
strftime(epoch_ms(x.created_at), '%Y-%m-%d') AS date FROM ss JOIN trimmed x ON x.place = ss.f"""


@query(_fused_sql(None) + _SESSIONS)
def session_shape(spark, sf_dir):
    return _shown(fusion.sessions(fusion.score_gap(_fused(spark, sf_dir)), page=None))


@query(f"SELECT * FROM ({_fused_sql(0.1)}{_SESSIONS}) WHERE rank > 5 AND rank <= 10")
def page_search(spark, sf_dir):
    return _shown(fusion.sessions(fusion.score_gap(_fused(spark, sf_dir, 0.1)), offset=5, page=5))


# --- attribution ---------------------------------------------------------------------------------------------------

_WINDOW = 6 * HOUR
_ATTR = f"""WITH ed AS (SELECT source AS session, 'f' || (doc_id % 7)::VARCHAR AS file, text AS content, {EPOCH} + doc_id * 60000 AS ts FROM documents),
co AS (SELECT 'c' || doc_id::VARCHAR AS hash, {EPOCH} + doc_id * 60000 + 30000 AS commit_ms, {EPOCH} + doc_id * 60000 + 30000 - {_WINDOW} AS parent_ms, 'f' || (doc_id % 7)::VARCHAR AS file, text AS content FROM documents),
ln AS (SELECT hash, file, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM co),
tc AS (SELECT DISTINCT hash, file, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]) ELSE [] END) AS tri FROM ln),
le AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM ed),
te AS (SELECT session, file, ts, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]) ELSE [] END) AS tri FROM le),
ow AS (SELECT DISTINCT co.hash, te.session, te.file, te.tri FROM te JOIN co ON te.file = co.file AND te.ts BETWEEN co.parent_ms AND co.commit_ms + {HOUR}),
su AS (SELECT ow.hash, ow.session, count(tc.tri) AS content_hits, count(*) AS total FROM ow LEFT JOIN tc ON ow.hash = tc.hash AND ow.file = tc.file AND ow.tri = tc.tri GROUP BY 1, 2),
ti AS (SELECT co.hash, ed.session, count(*) AS edit_count, max(ts) AS last_edit FROM ed JOIN co ON ed.ts BETWEEN co.parent_ms AND co.commit_ms + {HOUR} GROUP BY 1, 2),
mt AS (SELECT su.hash, su.session, content_hits, edit_count, last_edit, content_hits / total >= 0.5 AS surviving_in_commit, floor(content_hits / total * 100 + 0.5) / 100 AS surviving_ratio FROM su JOIN ti USING (hash, session) WHERE content_hits > 0)"""


def _attribution(spark, sf_dir):
    """Every document is an edit of its source's session, and a commit half a minute later."""
    d = table(spark, sf_dir, "documents")
    file = F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("file")
    ts = F.lit(EPOCH) + F.col("doc_id") * 60_000
    edits = d.select(F.col("source").alias("session"), file, F.col("text").alias("content"), ts.alias("ts"))
    c = d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"), file, F.col("text").alias("content"), (ts + 30_000).alias("commit_ms"))
    commits = c.select("hash", "commit_ms", (F.col("commit_ms") - _WINDOW).alias("parent_ms"))
    added = c.select("hash", "file", F.split("content", "\n").alias("lines"))
    return edits, commits, added, c.select("hash", "file", "content")


@query(_ATTR + " SELECT * FROM mt")
def attr_match(spark, sf_dir):
    return attribution.match_commits(*_attribution(spark, sf_dir))


@query(_ATTR + " SELECT * FROM mt ORDER BY last_edit DESC, session, hash LIMIT 25")
def last_n_attr(spark, sf_dir):
    return attribution.latest(attribution.match_commits(*_attribution(spark, sf_dir)), 25)


@query(_ATTR + " SELECT hash, file, count(*) AS trigrams FROM tc GROUP BY 1, 2")
def attr_trigram(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("file"), F.explode(attribution.trigrams(F.split("text", "\n"))).alias("tri"))
    return t.groupBy("hash", "file").agg(F.count("*").alias("trigrams"))


@query(_ATTR + " SELECT * FROM mt WHERE hash = 'c21'")
def attr_commit(spark, sf_dir):
    """Sessions that made one commit, from its hash."""
    return attribution.attribute(spark.createDataFrame([("c21",), ("none",)], "hash string"), *_attribution(spark, sf_dir))


_BLAME = ["f3:2-5", "f5:1", "f6"]


@query(_ATTR + """, bl AS (SELECT 'f' || (doc_id % 7)::VARCHAR AS file, doc_id // 7 + 1 AS line_no, 'c' || doc_id::VARCHAR AS hash FROM documents)
SELECT * FROM mt WHERE hash IN (SELECT hash FROM bl WHERE file = 'f3' AND line_no BETWEEN 2 AND 5 OR file = 'f5' AND line_no = 1 OR file = 'f6') ORDER BY last_edit DESC, session, hash LIMIT 30""")
def attr_blame(spark, sf_dir):
    """Sessions behind the lines of three specs, as if line n of a file were of its n-th document's commit."""
    d = table(spark, sf_dir, "documents")
    file, line = F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")), F.floor(F.col("doc_id") / 7) + 1
    lines = d.select(file.alias("file"), line.alias("line_no"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"))
    hashes = attribution.blame_lines(lines, [attribution.parse_spec(x) for x in _BLAME])
    return attribution.attribute(hashes, *_attribution(spark, sf_dir), limit=30)


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT lpad(lower(to_hex(doc_id)), 40, '0') AS hash FROM l WHERE doc_id > 0""")
def src_git(spark, sf_dir):
    """Commits named by blame lines in porcelain form, one for each line of a document; lines of no commit have none."""
    d = table(spark, sf_dir, "documents")
    n = F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n"))))
    head = F.concat_ws(" ", F.lpad(F.lower(F.hex("doc_id")), 40, "0"), F.col("n"), F.col("n"), F.lit("1"))
    lines = d.select("doc_id", n.alias("n")).select(F.explode(F.array(head, F.lit("author x"), F.concat(F.lit("\t"), head))).alias("line"))
    return attribution.blamed_commits(lines)


@query("""SELECT * FROM (VALUES (0, 'a.ts', NULL, NULL), (1, 'a.ts', 3, 3), (2, 'a.ts', 3, 9), (3, 'C:/x.ts', 12, 12), (4, 'a:b', NULL, NULL), (5, 'a.ts:', NULL, NULL)) AS t(i, path, first_line, last_line)""")
def attr_spec(spark, sf_dir):
    specs = [attribution.parse_spec(x) for x in ("a.ts", "a.ts:3", "a.ts:3-9", "C:/x.ts:12", "a:b", "a.ts:")]
    return spark.createDataFrame([(i, s.path, s.first, s.last) for i, s in enumerate(specs)], "i int, path string, first_line int, last_line int")


@query(_ATTR + """ SELECT hash, session, last_edit, substr(session, 1, 8) || '  ' || strftime(epoch_ms(last_edit), '%Y-%m-%d %H:%M') || '  ' || content_hits || ' hits  ' || edit_count || ' edits  ' ||
floor(surviving_ratio * 100 + 0.5)::INT || '%' || CASE WHEN surviving_in_commit THEN '' ELSE '  (superseded)' END AS line FROM mt""")
def attr_print(spark, sf_dir):
    return attribution.as_table(attribution.match_commits(*_attribution(spark, sf_dir)))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT 'c' || doc_id::VARCHAR AS hash, 'f' || (doc_id % 7)::VARCHAR AS file, line_no + 3 AS line_no, CASE WHEN line_no % 2 = 0 THEN 'added' ELSE 'removed' END AS kind, line FROM l""")
def attr_diff_parse(spark, sf_dir):
    """Diffs made of the documents' lines, in turn added and removed, below three header lines."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"))
    body = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise("-"), F.lit(""), x))
    head = F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), F.lit("@@ -0,0 +1 @@"))
    lines = d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"), F.posexplode(F.concat(head, body)).alias("line_no", "line"))
    return attribution.parse_diff(lines).withColumn("line_no", F.col("line_no").cast("long"))


# --- store ---------------------------------------------------------------------------------------------------------


@query(M + """, cur AS (SELECT * FROM messages WHERE message_seq < 4), inc AS (SELECT * REPLACE ('new ' || message_text AS message_text) FROM messages WHERE message_seq >= 2)
SELECT * FROM cur UNION ALL SELECT * FROM inc WHERE message_id NOT IN (SELECT message_id FROM cur)""")
def dml_insert_messages(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    return store.insert_messages(m.where("message_seq < 4"), m.where("message_seq >= 2").withColumn("message_text", F.concat(F.lit("new "), "message_text")))


@query(M + """, p AS (SELECT session_id, 'claude' AS vendor, 'root' AS kind, NULL::VARCHAR AS parent_session_id, min(created_at) AS updated_at FROM messages GROUP BY 1),
i AS (SELECT session_id, 'codex' AS vendor, 'agent' AS kind, CASE WHEN project_id = 'p1' THEN 's0' END AS parent_session_id, max(created_at) AS updated_at FROM messages WHERE project_id IN ('p1', 'p2') GROUP BY session_id, project_id)
SELECT coalesce(i.session_id, p.session_id) AS session_id, coalesce(i.vendor, p.vendor) AS vendor, coalesce(i.kind, p.kind) AS kind, coalesce(i.parent_session_id, p.parent_session_id) AS parent_session_id,
coalesce(i.updated_at, p.updated_at) AS updated_at FROM p FULL JOIN i ON p.session_id = i.session_id""")
def dml_upsert(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    cur = m.groupBy("session_id").agg(F.min("created_at").alias("updated_at")).select("session_id", F.lit("claude").alias("vendor"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("parent_session_id"), "updated_at")
    inc = m.where("project_id in ('p1', 'p2')").groupBy("session_id", "project_id").agg(F.max("created_at").alias("updated_at"))
    inc = inc.select("session_id", F.lit("codex").alias("vendor"), F.lit("agent").alias("kind"), F.when(F.col("project_id") == "p1", "s0").alias("parent_session_id"), "updated_at")
    return store.upsert_provenance(cur, inc)


@query(D + """, a AS (SELECT 'src3' AS s UNION ALL SELECT 'src4') SELECT * REPLACE (CASE WHEN session_id IN (SELECT s FROM a) THEN 'agent' ELSE retrieval_class END AS retrieval_class) FROM doc_messages""")
def late_reclass(spark, sf_dir):
    agents = spark.createDataFrame([("src3",), ("src4",)], "session_id string")
    return store.reclassify(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir), agents)[0]


@query(_vectors_cte(50) + " SELECT message_id, embed_version FROM vectors v JOIN doc_messages m USING (message_id) WHERE m.session_id NOT IN ('src3', 'src4') AND retrieval_class = 'hot'")
def in_delete(spark, sf_dir):
    agents = spark.createDataFrame([("src3",), ("src4",)], "session_id string")
    return store.reclassify(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir), agents)[1].select("message_id", "embed_version")


@query(_vectors_cte(50) + """ SELECT message_id, embed_version FROM vectors WHERE embed_version = 3
UNION ALL SELECT message_id, 3 FROM vectors WHERE embed_version = 2""")
def dml_insert_vectors(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return store.insert_vectors(doc_messages(spark, sf_dir), v, v.where("embed_version = 2")).select("message_id", "embed_version")


@query(D + " SELECT * FROM doc_messages WHERE session_id <> 'src2'")
def dml_delete_session(spark, sf_dir):
    return store.delete_session(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir), "src2")[0]


@query("""WITH l AS (SELECT '/t/' || conv_id::VARCHAR || '.jsonl' AS path, conv_id * 1000 + 0.7::DOUBLE AS mtime_ms, count(*) AS size FROM conversations GROUP BY conv_id),
w AS (SELECT path, floor(mtime_ms)::BIGINT AS m, CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END AS s FROM l WHERE size % 2 = 0 OR size % 3 = 0)
SELECT l.path, round(mtime_ms, 1) AS mtime_ms, size, CASE WHEN w.m IS NULL THEN 'new' WHEN floor(mtime_ms) = w.m AND size = w.s THEN 'unchanged' ELSE 'changed' END AS state FROM l LEFT JOIN w USING (path)""")
def wm_compare(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("size"))
    listing = c.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), (F.col("conv_id") * 1000 + F.lit(0.7)).alias("mtime_ms"), "size")
    size = F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))
    mark = listing.where("size % 2 = 0 or size % 3 = 0").select("path", F.floor("mtime_ms").cast("long").alias("last_mtime"), size.alias("last_size"), F.lit("claude").alias("vendor"))
    return store.changed_files(listing, mark).withColumn("mtime_ms", F.round("mtime_ms", 1))


# --- event time ----------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from threadloom.streaming.ingest import event_windows as windows

    return windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 minute OR lag(ts) OVER w IS NULL OR ts = lag(ts) OVER w + INTERVAL 30 minute THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minute AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    from threadloom.streaming.ingest import user_sessions as sessions

    return sessions(table(spark, sf_dir, "events"))


# --- smaller operators ---------------------------------------------------------------------------------------------


@query(M + " SELECT message_id FROM messages m WHERE retrieval_class = 'hot' AND EXISTS (SELECT 1 FROM messages p WHERE p.session_id = m.session_id AND p.retrieval_class = 'hot' AND p.message_seq < m.message_seq)")
def semi_predecessor(spark, sf_dir):
    return semantic.with_previous(views.messages(spark, sf_dir)).where("has_previous").select("message_id")


@query(_vectors_cte(50) + " SELECT session_id, count(*) AS with_vector FROM doc_messages JOIN vectors USING (message_id) GROUP BY session_id")
def join_vec_msgs(spark, sf_dir):
    return doc_messages(spark, sf_dir).join(views.vectors(spark, sf_dir), "message_id").groupBy("session_id").agg(F.count("*").alias("with_vector"))


@query(_vectors_cte(50) + _WAIT + """ SELECT message_id, CASE WHEN length(message_text) < 200 AND prev_text IS NOT NULL AND prev_text <> '' THEN right(prev_text, 512) || chr(10) || message_text ELSE message_text END AS embed_text FROM p""")
def embed_text(spark, sf_dir):
    return semantic.with_previous(doc_messages(spark, sf_dir)).select("message_id", semantic.embed_text().alias("embed_text"))


@query(M + f" SELECT message_id, round(1 / (1 + greatest(0, {NOW} - created_at) / 86400000.0 * 0.1), 9) AS recency FROM messages")
def recency(spark, sf_dir):
    return views.messages(spark, sf_dir).select("message_id", F.round(fusion.recency(F.col("created_at"), NOW, 0.1), 9).alias("recency"))


@query(_fused_sql(None) + " SELECT coalesce(f.message_id, s.message_id) AS message_id, f.pos AS fts_pos, s.pos AS sem_pos FROM top_fts f FULL JOIN top_sem s ON f.message_id = s.message_id")
def rrf_outer(spark, sf_dir):
    return _fused(spark, sf_dir).select("message_id", "fts_pos", "sem_pos")


@query(M + " SELECT DISTINCT session_id AS name FROM messages UNION SELECT 'alias-' || session_id FROM messages")
def set_union_dedup(spark, sf_dir):
    """All names of sessions, ids and aliases, each once."""
    return messages.names_of(*_aliases(spark, sf_dir))


@query(_ATTR + ", own AS (SELECT DISTINCT session, file, tri FROM te) SELECT tc.hash, tc.file, own.session, count(*) AS common FROM own JOIN tc USING (file, tri) GROUP BY 1, 2, 3")
def set_intersect(spark, sf_dir):
    """Trigrams of each session's edits that a committed file holds, too."""
    edits, _, _, blobs = _attribution(spark, sf_dir)
    return attribution.common_trigrams(edits, blobs)


@query(D + " SELECT DISTINCT session_id FROM doc_messages WHERE session_id IN ('src5', 'src6', 'src7', 'src8') AND session_id NOT IN ('src5', 'src7')")
def set_except(spark, sf_dir):
    """Sessions of one vendor's form without those that are accounted for."""
    m = doc_messages(spark, sf_dir)
    id_ = F.when(F.col("session_id").isin("src5", "src6", "src7", "src8"), F.concat(F.lit("codex-jsonl-"), "message_id")).otherwise(F.col("message_id"))
    return store.unresolved(m.withColumn("message_id", id_), m.where("session_id in ('src5', 'src7')"))


@query(M + " SELECT DISTINCT session_id FROM messages WHERE retrieval_class = 'agent'")
def agg_distinct(spark, sf_dir):
    return messages.sessions_of(views.messages(spark, sf_dir))


@query(_vectors_cte(50) + " SELECT session_id, count(v.message_id) > 0 AS has_vectors, max(retrieval_class = 'hot') AS has_messages FROM doc_messages LEFT JOIN vectors v USING (message_id) GROUP BY session_id")
def agg_exists(spark, sf_dir):
    return semantic.has_vectors(doc_messages(spark, sf_dir), views.vectors(spark, sf_dir))


@query(D + " SELECT m.message_id, m.message_seq FROM doc_messages m JOIN doc_messages t ON t.message_id = 'd27' AND m.session_id = t.session_id AND abs(m.message_seq - t.message_seq) <= 2")
def read_turn_context(spark, sf_dir):
    return messages.turn_context(doc_messages(spark, sf_dir), "src7", "d27", 2).select("message_id", "message_seq")


_DAYS = " WHERE created_at >= {} AND created_at < {}".format(EPOCH, EPOCH + 24 * HOUR)


@query(_fused_sql(None) + _FUSED_OUT.format("fused") + _DAYS)
def search_period(spark, sf_dir):
    """Of the fused results those of the first day; the filter follows the ranking."""
    return _shown(search.in_period(_fused(spark, sf_dir), "2024-01-01", "2024-01-01"))


def _no_vectors(texts):
    raise RuntimeError("no embedder")


@query(f"""{_TOKENS}, {_bm25_sql({'f1': _term('clown')}, 'f1 > 0', 60)} SELECT message_id, round(1 / (60 + pos), 9) AS score, pos AS fts_pos FROM top_fts""")
def embed_query(spark, sf_dir):
    """Where the embedder fails, keywords alone are searched."""
    found = search.search(doc_messages(spark, sf_dir), _index(spark, sf_dir), views.vectors(spark, sf_dir), "clown", _no_vectors)
    return found.scored.select("message_id", F.round("score", 9).alias("score"), "fts_pos")


@query("SELECT 0::BIGINT AS hits, false AS semantic_available, 1.0::DOUBLE AS coverage")
def search_empty(spark, sf_dir):
    found = search.search(doc_messages(spark, sf_dir), _index(spark, sf_dir), views.vectors(spark, sf_dir), "  ", _no_vectors)
    return found.scored.agg(F.count("*").alias("hits")).select("hits", F.lit(found.semantic_available).alias("semantic_available"), F.lit(found.coverage).alias("coverage"))


@query(f"""{_TOKENS}, {_bm25_sql({'f1': _term('clown')}, "f1 > 0 AND session_id = 'src3'", 20)}{_FTS_OUT}""")
def search_transcript(spark, sf_dir):
    found = search.search_transcript(doc_messages(spark, sf_dir), _index(spark, sf_dir), "src3", "clown")
    return found.withColumn("rank", F.round("rank", 6))


@query(f"""WITH f AS (SELECT conv_id, {EPOCH} + conv_id * 3600000 AS mtime_ms FROM (SELECT DISTINCT conv_id FROM conversations)),
c AS (SELECT doc_id, {EPOCH} + doc_id * 60000 AS t FROM documents)
SELECT 'c' || doc_id::VARCHAR AS hash, '/t/' || conv_id::VARCHAR || '.jsonl' AS path FROM c JOIN f ON f.mtime_ms BETWEEN t - {_WINDOW} - 60000 AND t + {24 * HOUR}""")
def src_candidates(spark, sf_dir):
    """Transcripts whose time fits a commit, before any is parsed; every conversation is a transcript, every document a commit."""
    files = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    files = files.select(F.concat(F.lit("/t/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), (F.lit(EPOCH) + F.col("conv_id") * HOUR).alias("mtime_ms"))
    at = F.lit(EPOCH) + F.col("doc_id") * 60_000
    commits = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("hash"), at.alias("commit_ms"), (at - _WINDOW).alias("parent_ms"))
    return attribution.candidates(files, commits)


@query(r"SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g') AS slug, regexp_replace(url, '[:/\\]', '-', 'g') AS narrow FROM pages")
def slug(spark, sf_dir):
    from threadloom.sources.sessions import project_slug

    return table(spark, sf_dir, "pages").select("page_id", project_slug(F.col("url")).alias("slug"), project_slug(F.col("url"), True).alias("narrow"))


@query(M + " SELECT session_id, regexp_matches(session_id, '(?i)^(?:[0-9a-f]{8}[0-9a-f-]{0,28}|agent-[0-9a-f]+)$') AS reads FROM (SELECT DISTINCT CASE WHEN retrieval_class = 'agent' THEN 'agent-' || substr(session_id, 2) ELSE session_id END AS session_id FROM messages)")
def dispatch(spark, sf_dir):
    from threadloom.sources.sessions import is_session_shaped

    name = F.when(F.col("retrieval_class") == "agent", F.concat(F.lit("agent-"), F.expr("substring(session_id, 2)"))).otherwise(F.col("session_id"))
    return views.messages(spark, sf_dir).select(name.alias("session_id")).distinct().select("session_id", is_session_shaped(F.col("session_id")).alias("reads"))


@query("""WITH o AS (SELECT *, coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM conversations),
t AS (SELECT conv_id, turn, pos, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM o WHERE role IN ('user', 'assistant'))
SELECT conv_id::VARCHAR AS path, n::BIGINT AS turn, min(pos)::BIGINT AS "offset", substr(min_by(text, turn), 1, 8192) AS prompt, coalesce(substr(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), 1, 8192), '') AS response,
substr(max_by(text, turn) FILTER (WHERE role = 'assistant'), 1, 200) AS preview FROM t WHERE n > 0 GROUP BY conv_id, n""")
def turn_content(spark, sf_dir):
    from pyspark.sql.window import Window

    from threadloom.sources.sessions import turns

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).over(w), F.lit(0))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), at.alias("offset"), F.col("role").alias("type"), "text")
    return turns(c)


from threadloom.plans import derived_queries, transcript_queries, upkeep_queries  # noqa: E402, F401  register their queries

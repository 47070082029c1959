"""The subpackage's registered queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, scratch

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, Jaccard index of 0.85. Texts without words stay alone; null ids have no group."""
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85).drop("class_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; null urls have empty ones and no rule."""
    from .url_filter import filter_urls

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).drop("candidates")


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each vector whose id is divisible by 50, against all others; vectors with nulls or non-finite numbers take no part."""
    from .knn import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256.0)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 50-byte strings that start in a document before it; null texts are empty."""
    from .passages import remove_repeats

    done = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=50)
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written as ORC files in the order of ids and read back; null texts have the end id alone."""
    from .token_output import token_offsets, write_tokens

    path = scratch(spark, "tokens-orc")
    write_tokens(documents(spark, sf_dir), path, tokenizer_path(), end_id=2)
    return token_offsets(spark, path)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they are; null texts are empty."""
    from .syncmers import as_text, beside_next, likeness, sketch, with_anchors

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_anchors(docs, "text").withColumn("own", sketch("anchors")).drop("anchors")
    rows = beside_next(own, "doc_id", ["text", "own"], docs.count())
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    rows = rows.select("doc_id", "own", "next_own", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_anchors(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited").drop("edited")
    rows = rows.withColumn("other", sketch("anchors")).drop("anchors")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model of the labels that aren't held out; empty texts get a score, too."""
    from .toxicity import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"), threshold=0.5)


#: Domains of op8 by the labels table, and the token shares they are brought to.
MIX = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document, so that the domains' expected shares of the tokens meet ``MIX``; ``miss`` is the most that one of them is off."""
    from .mixing import copies, mix

    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    fitted = mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), domain, MIX)
    miss = max(abs(fitted.reached[n] - share) for n, share in MIX.items())
    return fitted.rates.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("miss", F.lit(float(miss)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens; null texts are the end id alone."""
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path(), end_id=1, capacity=4096)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a model of the labels that aren't held out; empty texts get a score, too."""
    from .quality import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"), threshold=0.3)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item; null texts have no terms."""
    from .lexical import build, search

    found = search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)
    return found.withColumnRenamed("item", "item_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and the text that is rebuilt from it; null texts are empty."""
    from .fill_middle import fill_in_middle, restore

    done = restore(fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), seed=42, rate=50, spm=80))
    hashed = (F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


def op13_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 13-word windows that start in a document before it; null texts have no words."""
    from .phrases import remove_phrases

    done = remove_phrases(documents(spark, sf_dir).select("doc_id", "text"), length=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_url_filter,
        op3_voronoi_knn,
        op4_suffix_array_dedup,
        op5_token_output,
        op6_document_fingerprints,
        op7_toxicity,
        op8_source_mixing,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_lexical_search,
        op12_fill_in_middle,
        op13_phrase_dedup,
    )
}

_OP2 = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.verdict, r.rhost || r.rpath AS rule, r.rhost, r.rpath,
         (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath) AS fits
  FROM u CROSS JOIN r),
b AS (SELECT page_id, max({'n': length(rule), 'rule': rule, 'verdict': verdict}) FILTER (WHERE fits) AS best,
             count(*) FILTER (WHERE fits) AS n_fit, any_value(host) AS host, any_value(path) AS path
      FROM m GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM b
"""

_OP3 = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256.0 * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP11 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY item_id, term),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f CROSS JOIN total GROUP BY term, docs),
s AS (
  SELECT item_id, f.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN size USING (doc_id) CROSS JOIN total
  GROUP BY item_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

_OP12 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks
  FROM documents),
d AS (
  SELECT *, len(toks) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM u),
e AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, coalesce(list_sum(list_transform(toks[:lo], lambda x: length(x))), 0)::BIGINT AS pre,
         coalesce(list_sum(list_transform(toks[lo + 1:hi], lambda x: length(x))), 0)::BIGINT AS mid
  FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN pre END AS prefix_chars, CASE WHEN form <> 'plain' THEN mid END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || text[:pre] || '<S>' || text[pre + mid + 1:] || '<M>' || text[pre + 1:pre + mid]
                        ELSE '<S>' || text[pre + mid + 1:] || '<P>' || text[:pre] || '<M>' || text[pre + 1:pre + mid] END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS word FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(word) - 11)) AS i, array_to_string(word[i:i + 12], ' ') AS phrase FROM d WHERE len(word) >= 13),
first AS (SELECT phrase, min(doc_id) AS low FROM w GROUP BY phrase HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w JOIN first USING (phrase) WHERE low < doc_id),
each AS (SELECT doc_id, word, unnest(range(1, len(word) + 1)) AS i FROM d),
kept AS (
  SELECT each.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word[each.i], ' ' ORDER BY each.i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i GROUP BY each.doc_id)
SELECT d.doc_id, len(word)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {"op2_url_filter": _OP2, "op3_voronoi_knn": _OP3, "op11_lexical_search": _OP11, "op12_fill_in_middle": _OP12, "op13_phrase_dedup": _OP13}

"""URL filter: pattern rules indexed by their rarest literal token (DataFrame functions only).

Each rule becomes a regular expression over ``host || path`` and is filed under the one of its
literal tokens that the URLs hold least often. The index is a table of (token, rule): an equi-join on the URLs' own
tokens fetches candidates, and only those run their expression. There is one plan for any number of rules; Spark
broadcasts the index where its written size allows that and shuffles otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, r"[./]"), lambda t: t != ""))


def _rule_tokens(host: str, path: str) -> list[str]:
    """Literal tokens that every URL the rule fits holds whole: host labels, and path parts closed by ``/``."""
    parts = [p for p in re.split(r"[./]", host) if p]
    whole, _, _ = path.rpartition("/")
    return list(dict.fromkeys(parts + [p for p in re.split(r"[./]", whole) if p]))


def filter_urls(
    urls: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per URL row: id, host, path, rule, verdict and ``candidates`` (rules whose expression ran).

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains if the path starts with
    the rule's path; the longest host and path wins, ties by the rule's text. URLs that no rule fits get a
    null rule and ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit no rule
    with a host. Repeated rows and repeated or null ids are judged row by row; an empty table gives none.
    A rule without any literal token is tried on every URL. Further input columns are not carried along.
    """
    rows = urls.select(
        F.struct(
            F.monotonically_increasing_id().alias("n"),  # tells repeated rows apart
            F.col(id_col).alias("id"),
            url_host(F.col(url_col)).alias("host"),
            url_path(F.col(url_col)).alias("path"),
        ).alias("_row")
    )
    # every row has the empty token, under which rules without a literal are filed
    tokens = F.concat(_tokens(F.concat("_row.host", "_row.path")), F.array(F.lit("")))
    asked = rows.select("_row", F.explode(tokens).alias("_token"))
    index = _index(asked.select("_token"), rules, urls.sparkSession)
    key = F.concat("_row.host", "_row.path")
    tried = asked.join(index, "_token", "left").where("_token = '' OR _pattern IS NOT NULL")
    fits = F.call_function("regexp_like", key, F.col("_pattern"))
    best = tried.groupBy("_row").agg(
        F.max(F.when(fits, F.struct("_length", "_rule", "_verdict"))).alias("_best"), F.count("_pattern").cast("int").alias("candidates")
    )
    return best.select(
        F.col("_row.id").alias(id_col),
        F.col("_row.host").alias("host"),
        F.col("_row.path").alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"),
        "candidates",
    )


def _index(held: DataFrame, rules: Sequence[tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    """(_token, _verdict, _rule, _length, _pattern): each rule once, under its token that stands least often in ``held``."""
    table = [
        # a host holds no "/" and ends where the rule's host ends
        (i, v, h + p, len(h + p), rf"(?s)^([^/]*\.)?{re.escape(h)}(?=/|\z){re.escape(p)}", _rule_tokens(h, p) or [""])
        for i, (v, h, p) in enumerate(rules)
    ]
    schema = "_i long, _verdict string, _rule string, _length int, _pattern string, _literals array<string>"
    listed = durable(spark.createDataFrame(table, schema), "url-rules")
    each = listed.select("_i", F.explode("_literals").alias("_token"))
    literals = durable(each.select("_token").distinct(), "url-literals")
    heard = held.join(literals, "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token"))).alias("_least")
    filed = each.join(heard, "_token", "left").groupBy("_i").agg(rarest)
    return durable(listed.join(filed, "_i").select(F.col("_least.token").alias("_token"), "_verdict", "_rule", "_length", "_pattern"), "url-index")

"""What a keyword search shows of its hits. Searching itself is in ``search_index``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.query_text import phrases
from threadloom.functions.stem import MARKED, TOKEN, stem
from threadloom.operators.search_index import Index

#: Fixed values of a window's score: the first place of a phrase, and a beginning at the text's or at another sentence's first token.
NEW_PHRASE, AT_TEXT, AT_SENTENCE = 1000, 120, 100


def snippet_of(text: str, plan: object, stems: bool = False, size: int = 64, open_: str = ">>>", close: str = "<<<", more: str = "...") -> str:
    """At most ``size`` tokens of the text from shortly before the first match on, matches marked."""
    spans = [(m.start(), m.end(), stem(m[0]) if stems else m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    hit = [False] * len(spans)
    for p in phrases(plan):
        for i in range(len(spans) - len(p.tokens) + 1):
            own = [s[2] for s in spans[i : i + len(p.tokens)]]
            if own[:-1] == list(p.tokens[:-1]) and (own[-1] == p.tokens[-1] or (p.prefix and own[-1].startswith(p.tokens[-1]))):
                hit[i : i + len(own)] = [True] * len(own)
    first = next((i for i, h in enumerate(hit) if h), 0)
    lo = max(0, min(first - size // 4, len(spans) - size))
    hi = min(len(spans), lo + size)
    if not spans:
        return ""
    out, at = [], spans[lo][0] if lo else 0
    for (a, b, _), h in list(zip(spans, hit, strict=True))[lo:hi]:
        out.append(text[at:a] + (open_ + text[a:b] + close if h else text[a:b]))
        at = b
    out.append(text[at:] if hi == len(spans) else "")
    return (more if lo else "") + "".join(out) + (more if hi < len(spans) else "")


def with_snippet(hits: DataFrame, plan: object, text: str = "message_text", stems: bool = False) -> DataFrame:
    """Adds ``match_snippet``; for the rows of a result, not for a scan."""

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t or "", plan, stems))

    return hits.withColumn("match_snippet", mark(text))


def best_snippets(index: Index, found: DataFrame, plan: object, text: str = "message_text", size: int = 64, open_: str = ">>>", close: str = "<<<", more: str = "...") -> DataFrame:
    """Adds ``match_snippet`` to the rows of a result (``message_id``, ``text``): the window of ``size`` tokens that covers most phrases.

    Places come from the index. A window counts 1000 for each phrase that begins in it and 1 for each further time; candidates begin at a match,
    and are then centred on the matches that they hold, or at the sentence in which a match stands, for 100 more (120 at the text's beginning).
    Of equal scores the earliest wins. A message without a match shows its beginning, one without tokens an empty text. Texts are cut by the
    index's own tokens; a letter that has more characters in lower case (dotted capital I) may shift the marks of an index without stems.
    """
    each, token = list(dict.fromkeys(phrases(plan))), F.lit(MARKED if index.stems else TOKEN)
    own = F.coalesce(F.col(text), F.lit(""))
    cut = found.select("message_id", F.regexp_extract_all(own, token, F.lit(0)).alias("toks"), F.split(own, MARKED if index.stems else TOKEN, -1).alias("gaps"))
    cut = cut.withColumn("n_toks", F.size("toks"))
    placed = index.places(plan, index._of(plan).join(found.select("message_id"), "message_id", "left_semi"))
    spans = lambda i, p: F.transform(f"_s{i}", lambda x: F.struct(x.alias("off"), F.lit(i).alias("p"), F.lit(len(p.tokens)).alias("n")))
    placed = placed.select("message_id", F.concat(*(spans(i, p) for i, p in enumerate(each))).alias("at"))
    hits = placed.join(cut.select("message_id", "n_toks"), "message_id").select("message_id", "n_toks", F.inline("at"))
    begins = F.transform("gaps", lambda g, k: F.when((k == 0) | g.rlike(r"[.:][ \t\r\n]+$"), k))
    begins = F.filter(begins, lambda k: k.isNotNull() & (k < F.col("n_toks")))
    sentences = cut.where(F.col("n_toks") > size).select("message_id", "n_toks", F.explode(begins).alias("off"), F.lit(-1).alias("p"), F.lit(0).alias("n"))
    rows = hits.unionByName(sentences)
    by = Window.partitionBy("message_id").orderBy("off")
    shown, after = by.rangeBetween(0, size - 1), by.rangeBetween(1, Window.unboundedFollowing)
    real = F.col("p") >= 0
    kinds = sum((F.max(F.when(F.col("p") == i, 1).otherwise(0)).over(shown) for i in range(len(each))), F.lit(0))
    rows = rows.select(
        "message_id", "n_toks", "off", "p", (kinds * (NEW_PHRASE - 1) + F.count_if(real).over(shown)).alias("score"), F.max(F.when(real, F.col("off") + F.col("n"))).over(shown).alias("last"),
        F.min(F.when(real, F.col("off"))).over(after).alias("next_hit"), F.min(F.when(~real, F.col("off"))).over(after).alias("next_begin"),
    ).where(real | (F.col("next_hit") < F.coalesce("next_begin", "n_toks")))
    centred = F.greatest(F.lit(0), F.least(F.col("off") - ((size - (F.col("last") - F.col("off"))) / 2).cast("int"), F.col("n_toks") - size))
    score = F.col("score") + F.when(real, 0).when(F.col("off") == 0, AT_TEXT).otherwise(AT_SENTENCE)
    first = F.when(real, F.col("off")).otherwise(F.col("next_hit"))
    best = F.max(F.struct(score.alias("score"), (-first).alias("first"), real.cast("int").alias("plain"), F.when(real, centred).otherwise(F.col("off")).alias("start")))
    chosen = rows.groupBy("message_id").agg(best.alias("best")).select("message_id", F.col("best.start").alias("lo"))
    made = cut.join(chosen, "message_id", "left").join(placed, "message_id", "left").withColumn("lo", F.coalesce("lo", F.lit(0))).withColumn("hi", F.least("n_toks", F.col("lo") + size))
    inside = F.filter(F.coalesce("at", F.array()), lambda a: (a["off"] < F.col("hi")) & (a["off"] + a["n"] > F.col("lo")))
    made = made.withColumn("at", inside)
    covers = lambda k, a, b: F.exists("at", lambda x: (x["off"] <= k - a) & (x["off"] + x["n"] > k + b))

    def piece(k):
        gap = F.when((k == F.col("lo")) & (k > 0), "").otherwise(F.get("gaps", k))
        begin = F.when(covers(k, 0, 0) & ((k == F.col("lo")) | ~covers(k, 1, 0)), open_).otherwise("")
        end = F.when(covers(k, 0, 0) & ((k == F.col("hi") - 1) | ~covers(k, 0, 1)), close).otherwise("")
        return F.concat(gap, begin, F.get("toks", k), end)

    middle = F.array_join(F.transform(F.sequence("lo", F.col("hi") - 1), piece), "")
    tail = F.when(F.col("hi") < F.col("n_toks"), more).otherwise(F.get("gaps", F.col("n_toks")))
    snippet = F.when(F.col("n_toks") > 0, F.concat(F.when(F.col("lo") > 0, more).otherwise(""), middle, tail)).otherwise("")
    return found.join(made.select("message_id", snippet.alias("match_snippet")), "message_id")

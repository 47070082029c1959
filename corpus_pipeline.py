"""Corpus pipeline: quality filter, near-dedup, passage dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the pipeline writes it as Parquet and
reads it again as the next stage's ``docs``. All but the last return the columns of ``documents``. Classifiers are
fitted on the labels table and the documents table in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import minhash, mixing, packing, passages, quality, toxicity
from threadloom.llm._spark import documents, durable
from threadloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Token shares of the mix, and its size as a multiple of what comes in. Documents that are good and not toxic are the bulk.
#: They hold where more than the toxic share comes in; else the shares that come in do.
TARGETS, BUDGET = {"clean": 0.97, "toxic": 0.03}, 1.0
CAPACITY, END_ID = 4096, 1


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.3 or more. Rows are judged one by one, null ids too."""
    model = quality.train(documents(spark, sf_dir), _labels(spark, sf_dir), "quality")
    return toxicity.with_score(docs.select(*COLUMNS), model, into="_score").where(F.col("_score") >= 0.3).drop("_score")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_node``: the id, or a number beyond all ids for texts without one and for all but one of several texts of one id.

    Rows of one id and text are one node. Such numbers are written, so that each use sees the same; where no id repeats there are none.
    """
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    pairs = rows.select("doc_id", "_hash").distinct()
    several = pairs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"), F.min("_hash").alias("_first")).where("_n > 1 or _id is null")
    odd = pairs.join(several, F.col("doc_id").eqNullSafe(F.col("_id"))).where(F.col("doc_id").isNull() | (F.col("_hash") != F.col("_first")))
    odd = durable(odd.select("_id", F.col("_hash").alias("_text"), F.monotonically_increasing_id().alias("_nth")), "odd-ids")
    if odd.isEmpty():
        return rows.withColumn("_node", F.col("doc_id").cast("long")).drop("_hash")
    beyond = F.lit((docs.agg(F.max("doc_id")).first()[0] or 0) + 1)
    named = rows.join(odd, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_hash").eqNullSafe(F.col("_text")), "left")
    return named.select(*docs.columns, F.coalesce(beyond + F.col("_nth"), F.col("doc_id").cast("long")).alias("_node"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard index 0.8) the row with the smallest id.

    Rows are compared by their texts, whatever their ids: of several texts of one id, or without an id, those go that are near copies
    of a row that stays, and equal rows are one. A row with an id stays before one without or with an id that another text has.
    """
    named = _numbered(docs.select(*COLUMNS))
    found = minhash.near_duplicates(named, words=5, percent=80, id_col="_node")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_node")).distinct()
    left = named.join(gone.hint("merge"), "_node", "left_anti")
    return left.dropDuplicates(["_node"]).select(*COLUMNS)  # by the join's partitions


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that start in a document with a smaller id; documents of which nothing is left go.

    A character of which a part is removed goes as a whole. Texts that lose nothing stay as they are, empty or null ones, too.
    """
    done = passages.remove_repeats(docs.select(*COLUMNS), length=50, as_text=True)
    cut = F.col("n_removed") > 0
    done = done.withColumnRenamed("kept", "text")
    done = done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where(~cut | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that toxic text is at most its target share of the tokens.

    No document is lost for which toxic isn't the likelier domain: its rate is 1 or more. Toxic text that is within its share stays.
    The whole part of a rate is that many rows; the rest decides by the hash of the id on one more.
    """
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    fitted = mixing.mix(docs, _labels(spark, sf_dir), label, TARGETS, BUDGET, capped="toxic")
    times = mixing.copies(F.col("_rate"), F.col("doc_id"))
    rated = fitted.apply(docs.select(*COLUMNS), into="_rate").withColumn("_times", times)
    return rated.where("_times > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), END_ID, CAPACITY)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None

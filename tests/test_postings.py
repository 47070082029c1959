"""Postings are grouped where a message stands: what they hold, how they are made, and where they are filed."""

from collections import defaultdict

from pyspark.sql import functions as F

from threadloom.functions.query_text import Phrase
from threadloom.functions.stem import python_tokens, stem
from threadloom.operators.search_index import Index, _bucket, posting_rows

TEXTS = ["one two one", None, "", "Trash trashed trashing clowns", "été 日本 7 7 x", "to " * 3000 + "be"]


def made(spark):
    rows = [(f"m{i}", "s", i, t, "p", i, "hot") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "message_id string, session_id string, message_seq long, message_text string, project_id string, created_at long, retrieval_class string")


def wanted(stems):
    out = defaultdict(list)
    for i, t in enumerate(TEXTS):
        for at, w in enumerate(python_tokens(t or "")):
            out[stem(w) if stems else w, f"m{i}"].append(at)
    return dict(out)


def test_postings_of_tokens_and_stems(spark):
    for stems in (False, True):
        assert {(r.term, r.message_id): list(r.positions) for r in posting_rows(made(spark), stems).collect()} == wanted(stems)


def test_no_row_for_a_token_is_shuffled(spark):
    plan = posting_rows(made(spark), True)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert "hashpartitioning" not in plan


def test_terms_are_filed_by_the_hash_that_a_search_works_out(spark, tmp_path):
    index = Index.build(made(spark), f"{tmp_path}/i", stems=False, buckets=7, per_block=2)
    rows = index.postings()
    assert rows.count() == len(wanted(False))
    assert rows.where(F.col("bucket") != _bucket(F.col("term"), 7)).count() == 0
    assert {r.message_id for r in index.match(Phrase(("日本",))).collect()} == {"m4"}
    assert {(r.term, r.doc, r.cnt) for r in index.vocabulary().where("term in ('one', 'to')").collect()} == {("one", 1, 2), ("to", 1, 3000)}


def test_a_row_for_a_term_and_block(spark, tmp_path):
    """What a block has of a term is one row, with its counts and greatest score; no table beside it is shuffled or written for them."""
    index = Index.build(made(spark), f"{tmp_path}/i", stems=False, buckets=7, per_block=2)
    assert sorted(p.name for p in tmp_path.joinpath("i").iterdir()) == ["postings", "totals", "vocabulary"]
    held = defaultdict(list)
    for r in index.postings().collect():
        held[r.term, r.block].append(len(r.positions))
    assert {(r.term, r.block): (r.doc, r.cnt) for r in index._tops().collect()} == {k: (len(v), sum(v)) for k, v in held.items()}
    assert {(r.term, r.message_id): list(r.positions) for r in index.postings().collect()} == wanted(False)


def test_a_block_in_pieces(spark, tmp_path):
    """Messages of more tokens than are grouped at a time: a block may come in two rows, and nothing is lost or counted twice."""
    rows = [(f"m{i}", "s", i, "a b " * 300_000 + f"w{i}", "p", i, "hot") for i in range(4)]
    m = spark.createDataFrame(rows, "message_id string, session_id string, message_seq long, message_text string, project_id string, created_at long, retrieval_class string")
    index = Index.build(m, f"{tmp_path}/i", stems=False)
    assert {(r.term, r.doc, r.cnt) for r in index.vocabulary().collect()} == {("a", 4, 1_200_000), ("b", 4, 1_200_000), *((f"w{i}", 1, 1) for i in range(4))}
    assert {r.message_id: r.k for r in index.postings().where("term = 'b'").selectExpr("message_id", "positions[299999] as k").collect()} == {f"m{i}": 599_999 for i in range(4)}
    assert [r.message_id for r in index.search(m.withColumn("message_role", F.lit("user")), "w2", skip_idf=True).collect()] == ["m2"]


def test_only_messages_that_differ_are_compared_one_by_one(spark, tmp_path):
    """Changed, moved, new and gone messages are found by their postings' number and hashes; equal ones aren't looked at again."""
    many = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("message_id"), F.lit("s").alias("session_id"), F.col("id").alias("message_seq"), F.concat(F.lit("same word w"), F.col("id")).alias("message_text"), F.lit("p").alias("project_id"), F.col("id").alias("created_at"), F.lit("hot").alias("retrieval_class"))
    m = made(spark).unionByName(many)
    index = Index.build(m, f"{tmp_path}/i", stems=False)
    assert index._touched(m).count() == 0 and index.differences(m).count() == 0
    text = F.when(F.col("message_id") == "m0", "two one one").when(F.col("message_id") == "m1", "came").otherwise(F.col("message_text"))
    now = m.withColumn("message_text", text).where("message_id <> 'm3'")
    assert {r.message_id for r in index._touched(now).collect()} == {"m0", "m1", "m3"}
    want = {(t, "m0", s) for t in ("one", "two") for s in ("stale", "missing")} | {("came", "m1", "missing")} | {(t, "m3", "stale") for t in TEXTS[3].lower().split()}
    assert {tuple(r) for r in index.differences(now).collect()} == want

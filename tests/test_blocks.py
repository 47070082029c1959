"""Block bounds and prefixes of the stored index."""

import random

import pytest

from threadloom.functions.query_text import And, Not, Or, Phrase
from threadloom.operators.search_index import Index
from threadloom.plans import views
from threadloom.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """4,000 messages: "often" in all, "rare" in 22."""
    r = random.Random(3)
    rows = []
    for i in range(4000):
        words = ["often"] * r.randint(1, 3) + [f"w{r.randint(0, 50)}" for _ in range(r.randint(1, 30))] + (["rare"] if i % 190 == 0 else [])
        r.shuffle(words)
        rows.append((f"m{i}", f"s{i % 7}", i, " ".join(words), f"p{i % 3}", 1000 - i % 10, "user", "hot"))
    m = spark.createDataFrame(rows, ingest.MESSAGE_SCHEMA).cache()
    return m, Index.build(m, str(tmp_path_factory.mktemp("blocks")), stems=False, per_block=16)


WORD = {w: Phrase((w,)) for w in ("often", "rare", "w1", "w2", "w3", "absent")}
PLANS = [
    Or((WORD["often"], WORD["rare"])),
    And((WORD["often"], WORD["w1"])),
    Not(Or((WORD["w1"], WORD["rare"])), WORD["w2"]),
    Or((And((WORD["w1"], WORD["w2"])), WORD["w3"], WORD["w3"])),
    Or((WORD["absent"], WORD["w1"])),
    And((WORD["absent"], WORD["w1"])),
]


@pytest.mark.parametrize("plan", PLANS, ids=range(len(PLANS)))
@pytest.mark.parametrize("scope", [{}, {"project": "p1", "exclude": "s3"}], ids=["all", "scope"])
def test_same_top_as_all_postings(made, plan, scope):
    m, index = made
    every = {r.message_id: r["rank"] for r in index.match(plan).collect()}
    own = {r.message_id: r for r in m.collect()}
    fits = [i for i in every if not scope or (own[i].project_id == "p1" and own[i].session_id != "s3")]
    want = sorted(fits, key=lambda i: (round(every[i], 9), own[i].created_at, i))[:20]
    got = index.search(m, "", 20, plan=plan, **scope).collect()
    assert {r.message_id for r in got} == set(want) and len(got) == len(want)
    assert all(abs(every[r.message_id] - r["rank"]) < 1e-12 for r in got)


def test_few_postings_are_scored(made):
    _, index = made
    plan = PLANS[0]
    rows, counts = index.candidates(plan, 20)
    assert counts == [4000, 22]
    assert rows.count() * 10 < index._of(plan).count()  # at most 22 blocks of 250 hold the rarer term
    bound = {r["block"]: r["bound"] for r in index.bounds(plan)[0].collect()}
    best = index.match(plan).join(index.postings().select("message_id", "block").distinct(), "message_id").collect()
    assert all(-r["rank"] <= bound[r["block"]] + 1e-12 for r in best)


def test_a_limit_beyond_all_hits_and_none(made):
    m, index = made
    assert index.search(m, "", 10_000, plan=PLANS[0]).count() == 4000
    assert index.search(m, "", 0, plan=PLANS[0]).count() == 0


def test_a_prefix_opens_the_folders_of_its_terms(spark, made):
    _, index = made
    plan = index._of(Phrase(("ra",), prefix=True))
    assert {r.term for r in plan.select("term").distinct().collect()} == {"rare"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in text.split("PartitionFilters")[1].split("PushedFilters")[0] and "StringStartsWith" in text.split("PushedFilters")[1]
    assert index._of(Phrase(("zzz",), prefix=True)).count() == 0


def test_whole_documents_by_blocks(spark, tmp_path):
    m = views.doc_messages(spark, SF)
    index = Index.build(m, f"{tmp_path}/i", per_block=8)
    plan = index.plan_of("clown OR license", skip_idf=True)
    every = sorted((round(r["rank"], 9), r.created_at, r.message_id) for r in index.match(plan).collect())[:20]
    assert [x[2] for x in every] == [r.message_id for r in index.search(m, "", plan=plan).orderBy("rank", "created_at", "message_id").collect()]


def test_more_blocks_than_are_named(made, monkeypatch):
    m, index = made
    monkeypatch.setattr("threadloom.operators.search_index.NAMED", 5)
    for plan in (PLANS[0], PLANS[2]):
        every = sorted((round(r["rank"], 9), r.created_at, r.message_id) for r in index.match(plan).collect())[:20]
        assert {r.message_id for r in index.search(m, "", 20, plan=plan).collect()} == {x[2] for x in every}

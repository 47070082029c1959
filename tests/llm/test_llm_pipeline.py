"""Mixing against a dense solver, and the pipeline's stages against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_llm_basic import check_packing, reference_ids
from test_llm_texts import brute_components, brute_removal, make_texts, shingle_sets
from threadloom.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"


def brute_rates(tokens, p, goal, steps=20_000):
    """Plain projected gradient in the metric of tokens, on the driver."""
    w = tokens / tokens.sum()
    r = np.ones(len(w))
    for _ in range(steps):
        r = np.maximum(0, r - 0.9 * p @ ((r * w) @ p - goal))
    return r


@pytest.mark.parametrize("goal", [[0.5, 0.3, 0.2], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8], [1.2, 0.6, 0.2]])
def test_rates_reach_the_targets(spark, goal):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(0, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, _tokens long, _p array<double>")
    moves, reached = mixing.fit_rates(rows, np.array(goal))
    got = np.array([r.rate for r in rows.select("doc_id", mixing.rate(moves).alias("rate")).orderBy("doc_id").collect()])
    w = tokens / tokens.sum()
    assert (got >= 0).all() and np.allclose((got * w) @ p, reached)
    miss = lambda r: np.abs((r * w) @ p - goal).max()
    assert miss(got) <= miss(brute_rates(tokens, p, np.array(goal))) + 1e-4


def test_mix_takes_any_row(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in make_texts(8)] + [(None, None, 1.0)], "doc_id long, text string, rate double")
    domain = F.when(F.col("toxic") == 1, "b").when(F.col("quality") == 1, "a")
    m = mixing.mix(docs, labels, domain, {"a": 0.7, "b": 0.3})
    assert m.rates.count() == docs.count() and m.rates.where("rate < 0").count() == 0
    assert m.apply(docs).count() == docs.count()
    odd = docs.withColumn("_tokens", F.lit("x")).withColumn("_p", F.lit("y"))
    assert m.apply(odd).columns == [*(c for c in odd.columns if c != "rate"), "rate"] and m.apply(odd).where("_tokens = 'x' and _p = 'y'").count() == docs.count()
    assert mixing.mix(docs.limit(0), labels.limit(0), domain, {"a": 1.0}).rates.count() == 0


def test_op8_reaches_its_shares(spark):
    rows = queries.op8_source_mixing(spark, SF).collect()
    assert len(rows) == 200
    total = sum(r.tokens for r in rows)
    for name, share in queries.MIX.items():
        assert sum(r.rate * r.tokens * r[f"p_{name}"] for r in rows) / total == pytest.approx(share, abs=rows[0].miss + 1e-6)
    assert rows[0].miss < 5e-3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 2, t, "en", "src0", None if t is None else len(t)) for i, t in make_texts(6)]
    return spark.createDataFrame(rows + rows[10:12], ", ".join(f"{c} {t}" for c, t in zip(P.COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))


def once(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_quality_stage(spark, docs):
    got = P.quality_filter(spark, docs, SF)
    assert got.columns == P.COLUMNS
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    want = Counter(r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect())
    assert Counter(r.doc_id for r in got.collect()) == want


def test_near_dedup_stage(spark, docs):
    texts = once(docs)
    root = brute_components(shingle_sets(list(texts.items()), 5), 80)
    got = P.near_dedup(spark, docs, SF)
    assert got.columns == P.COLUMNS
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(((i, t) for i, t in texts.items() if root[i] == i))


def test_near_dedup_keeps_texts_of_repeated_and_null_ids(spark):
    """Three texts of one id, copies of them elsewhere, rows without an id: only near copies of a row that stays go."""
    text = lambda n: " ".join(f"w{n}x{j}" for j in range(40))
    near = lambda n: text(n).replace(f"w{n}x0 ", "other ")
    rows = [(1, text(1)), (1, text(2)), (1, text(3)), (1, text(3)), (2, near(2)), (None, text(4)), (None, text(5)), (None, near(1)), (3, text(5)), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()), key=repr)
    kept = {t for _, t in got}
    assert len(got) == len(kept) == 6 and "" in kept
    for n in (1, 2, 3, 4, 5):
        assert (text(n) in kept) + (near(n) in kept) == 1
    assert (3, text(5)) in got and (None, text(4)) in got and all(i != 1 or t in map(text, (1, 2, 3)) for i, t in got)


def test_passage_stage(spark, docs):
    texts = once(docs)
    want = brute_removal(list(texts.items()), 50)
    got = {r.doc_id: r.text for r in P.passage_dedup(spark, docs, SF).collect()}
    for i, (_, removed, _, kept) in want.items():
        if not removed:
            assert got[i] == texts[i]
        elif i in got:
            assert got[i].encode() == kept or len(got[i].encode()) < len(kept)
        else:
            assert not kept.decode(errors="ignore").strip()


def test_mixing_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = P.mix_sources(spark, docs, SF)
    assert got.columns == P.COLUMNS
    times = Counter(r.doc_id for r in got.collect())
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([times[i] > 0 for i in clean]) > 0.95


def test_mixing_loses_no_clean_document(spark, tmp_path):
    """Under 3% of the tokens are toxic: nothing is dropped, nothing comes twice."""
    rng = np.random.default_rng(5)
    good, bad = [f"calm{i}" for i in range(50)], [f"vile{i}" for i in range(20)]
    texts = [" ".join(rng.choice(bad if i % 130 == 7 else good, 40)) for i in range(520)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 130 != 7), int(i % 130 == 7)) for i in range(520)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(r.doc_id for r in P.mix_sources(spark, docs, str(tmp_path)).collect())
    assert got == Counter(range(520))


def test_a_cap_thins_its_own_domain_only(spark):
    """A tenth is toxic, and some clean documents have a posterior of it above a tenth."""
    p_toxic = [0.02] * 700 + [0.15, 0.3, 0.45] * 60 + [0.97] * 100
    rows = spark.createDataFrame([(i, 10, [1 - x, x]) for i, x in enumerate(p_toxic)], "doc_id long, _tokens long, _p array<double>")
    moves, reached = mixing.fit_rates(rows, np.array([0.9, 0.1]), capped=1)
    got = np.array([r.rate for r in rows.select("doc_id", mixing.rate(moves, capped=1).alias("rate")).orderBy("doc_id").collect()])
    assert moves and (got[:880] >= 1).all() and (got[880:] < 1).all() and (got >= 0).all()
    before = np.mean(p_toxic)
    assert 0.09 < reached[1] < before
    assert mixing.fit_rates(rows, np.array([0.8, 0.2]), capped=1)[0] == []


def test_packing_stage_and_run(spark, docs):
    rows = P.pack(spark, docs, SF).collect()
    check_packing(rows, [(r.doc_id, reference_ids(r.text) + [1]) for r in docs.collect()], P.CAPACITY)
    assert P.run(spark, SF).count() > 100
    assert [f(spark, docs.limit(0), SF).count() for _, f in P.STAGES] == [0] * 5

"""Near-duplicates, repeated passages, fingerprints and classifiers against brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import _labels, components, minhash, passages, quality, queries, suffix_array, syncmers, toxicity
from threadloom.llm import _text as T

SF = "/root/testdata/sf0.001"


def make_texts(seed=0, n=160):
    """Prose with exact and near copies, shared passages, hot lines, empty, short and long texts."""
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "RE", "sé") for b in ("ta", "zo", "pi", "x", "中")]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage, hot = prose(120), prose(30), "This line stands in very many documents, word for word."
    out = [None, "", " \t ", "one", "One", "one two", "x" * 3_000, base]
    while len(out) < n:
        kind = rnd.randrange(7)
        if kind == 0:
            out.append(rnd.choice(out))
        elif kind == 1:
            w = base.split()
            for _ in range(rnd.randrange(1, 9)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab) + "q"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(prose(rnd.randrange(5, 60)) + "\n" + passage + "\n" + prose(20))
        elif kind == 3:
            out.append(hot + "\n" + prose(rnd.randrange(2, 12)))
        else:
            out.append(prose(rnd.randrange(1, 90)))
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, value string, n_bytes int, component string").repartition(3)


def shingle_sets(rows, n):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
    return sets


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "percent", "k"), [(3, 85, 64), (5, 80, 64), (2, 50, 128)])
def test_near_duplicates_equal_brute_force(spark, words, percent, k):
    rows = make_texts(words)
    sets = shingle_sets(rows, words)
    want = brute_components(sets, percent)
    got = minhash.near_duplicates(frame(spark, rows), words, percent, k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(rows)


@pytest.mark.parametrize(("rows", "size"), [(3, 4 << 20), (1_024, 1_500), (2, 700)])
def test_near_duplicates_in_many_blocks(spark, monkeypatch, rows, size):
    """Chains of copies of copies: a group has several joined parts, outsiders that fill several blocks, and long texts."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rnd = random.Random(rows)
    words = [f"w{rnd.randrange(10_000)}" for _ in range(80)]
    chain = [list(words)]
    for _ in range(60):
        w = list(rnd.choice(chain[-6:]))
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(10_000)}"
        chain.append(w)
    texts = list(enumerate([" ".join(w) for w in chain] + [" ".join(words * 40), " ".join(words * 41)]))
    sets = shingle_sets(texts, 3)
    want = brute_components(sets, 85)
    assert 3 < len(set(want.values())) < 50
    got = minhash.near_duplicates(frame(spark, texts), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_overlaps_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60))) for _ in range(70)]
    for first in (1, 30, 70):
        got = minhash._overlaps(sets, first)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(first) for j in range(i + 1, 70))


def test_near_duplicates_without_links(spark):
    assert minhash.near_duplicates(frame(spark, make_texts()).limit(0)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(5, None), (None, "a b c"), (6, "a b c"), (6, "d e f"), (7, "d e f")], "doc_id long, text string"), 3, 85)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, None), (5, 5), (6, 6), (6, 6), (7, 6)]


def test_prefixes_reach_the_bound():
    assert minhash.sure_overlap(100, 64) == 64
    assert 20 <= minhash.sure_overlap(85, 64) <= 40
    assert minhash.prefix_size(10, 80, 64) == 3


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(70, 70), (99, 80)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 80: 80, 99: 80}


def brute_removal(rows, length):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length", [50, 51, 20])
def test_removal_equals_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(passages, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 9_000)
    rows = make_texts(length)
    got = passages.remove_repeats(frame(spark, rows), length).collect()
    want = brute_removal(rows, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want
    assert len(got) == len(rows)
    assert got[0].component == "b"


def test_offsets_double_up_to_the_length():
    assert suffix_array.offsets(50) == [8, 16, 18] and suffix_array.offsets(8) == [] and suffix_array.offsets(3, 1) == [1, 1]


@pytest.mark.parametrize("length", [50, 21, 5])
def test_prefix_doubling_equals_brute_force_and_anchors(spark, monkeypatch, length):
    """All suffixes, ranked by doubling, lose the bytes that brute force and the anchors' form remove."""
    monkeypatch.setattr(passages, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 3_000)
    rows = make_texts(length, n=70)
    want = {i: (removed, n) for i, (_, removed, n, _) in brute_removal(rows, length).items() if removed}
    got = suffix_array.removed_bytes(frame(spark, rows), length).collect()
    assert {r.doc: (r.n_removed, len(r.spans)) for r in got} == want
    anchors = passages.remove_repeats(frame(spark, rows), length).where("n_removed > 0").collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in anchors} == {r.doc: [(s.start, s.end) for s in r.spans] for r in got}
    assert suffix_array.removed_bytes(frame(spark, rows).limit(0), length).count() == 0


def test_removal_across_chunks(spark):
    """A text longer than a vectorised step, whose passages repeat in later slices of its group."""
    rnd = random.Random(2)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    long = prose(T.CHUNK + 90_000)
    cut = lambda n: long[(at := rnd.randrange(len(long) - n)) : at + n]
    rows = [(3, long)] + [(i, prose(300) + cut(200) + prose(40) + cut(60) + long[-70:]) for i in (1, 2, 4, 5, 6, 7)]
    want = brute_removal(rows, 50)
    assert len(want[3][3]) < len(long) and len(list(T.chunks(np.array([0, len(long), len(long) + 600])))) == 2
    got = passages.remove_repeats(frame(spark, rows), 50).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


def test_removal_of_nothing(spark):
    assert passages.remove_repeats(frame(spark, make_texts()).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x" * 99), (1, "x" * 99), (None, "x" * 60)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in passages.remove_repeats(twice).collect()) == [(1, 0), (1, 0), (9, 60)]


def test_op6_edits_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 11)
    rows = [(i * 3, t or "") for i, t in make_texts(4)]
    texts = dict(rows)
    ids = sorted(texts)
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/op6/documents.parquet")
    df = queries.op6_document_fingerprints(spark, path.rpartition("/")[0])
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r.doc_id: r for r in df.collect()}
    assert sorted(got) == ids
    prints = {}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[after][: n // 4]
        r = got[i]
        assert r.n_chars == n
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[i], r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        if texts[i] == edited:
            assert r.near_edited == 1
    long = [i for i in ids if len(texts[i].split()) > 40]
    assert np.mean([got[i].near_edited for i in long]) > 0.45


def test_fingerprints_of_one_and_no_rows(spark):
    df = spark.createDataFrame([(None, None), (1, "a b c d e f g h i j k l")], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    assert got[None].fingerprint == "" and got[1].anchors and len(got[1].fingerprint) == 8 * len({a.hash for a in got[1].anchors})
    assert syncmers.beside_next(df.limit(0), "doc_id", ["text"], 0).count() == 0
    one = syncmers.beside_next(df.where("doc_id = 1"), "doc_id", ["text"], 1).first()
    assert one.next_text == one.text


def test_syncmers_equal_their_definition(spark):
    words = "a b c d e f g h i j k l m n o p q r s t".split()
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    pos = [a.pos for a in syncmers.fingerprints(df).first().anchors]
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    pairs = [r.h for r in spark.createDataFrame(list(zip(hashes, hashes[1:], strict=False)), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert pos == [i for i in range(len(words) - 4) if min(pairs[i : i + 4]) in (pairs[i], pairs[i + 3])]


def test_short_and_unspaced_texts_have_fingerprints(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    short = [(" ".join(word() for _ in range(5 + i % 2)), " ".join(word() for _ in range(5 + i % 2))) for i in range(40)]
    han = "".join(chr(0x4E00 + rnd.randrange(2_000)) for _ in range(120))
    token = "".join(rnd.choice("abcdefgh") for _ in range(300))
    near = [(x, x[:60] + "q" + x[61:]) for x in (han, token)] + [("alpha beta gamma delta omega", "alpha beta gamma delta omegas"), ("one two three", "one two three")]
    rows = [(i, *p) for i, p in enumerate(short + near + [(short[0][0], "")])]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    for c in "ab":
        df = syncmers.with_anchors(df, c, f"{c}_anchors").withColumn(f"{c}_own", syncmers.sketch(f"{c}_anchors"))
    got = df.select("i", "b", F.size("a_own").alias("m"), F.size("b_own").alias("n"), syncmers.likeness("a_own", "b_own").alias("like")).orderBy("i").collect()
    assert all(r.m > 0 and (r.n > 0) == (r.b != "") for r in got)
    assert all(r.like < 0.2 for r in got[:40]) and got[-1].like == 0
    assert all(r.like > 0.4 for r in got[40:44])


def test_names_of_columns_do_not_clash(spark):
    """Tables whose columns are named like what the operators make on their way."""
    names = ["_ord", "_bucket", "_row", "_copy", "next_text", "_anchors_h", "_text_h", "_b"]
    df = spark.createDataFrame([(i, f"text {i} of some more words here", *(["x"] * len(names))) for i in range(5)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = syncmers.beside_next(df, "doc_id", ["text"], 5).orderBy("doc_id").collect()
    assert [r.next_text for r in got] == [f"text {(i + 1) % 5} of some more words here" for i in range(5)]
    assert all(r["_ord"] == "x" and r["_bucket"] == "x" for r in got)
    made = syncmers.with_anchors(df, "text").collect()
    assert all(r["_anchors_h"] == "x" and r.anchors for r in made)


def test_anchors_align_by_position(spark):
    """Words put in shift the anchors after them; what follows again keeps its own shift; unlike texts have no long match."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rnd.shuffle(words)
    put = [f"x{i}" for i in range(7)]
    rows = [(1, words, words[:150] + put + words[150:]), (2, words, words), (3, words, [f"y{i}" for i in range(300)]), (4, words, []), (None, words, words)]
    rows.append((5, words, words[300:] + words[:300]))  # parts swapped
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, a, b in rows], "i long, a string, b string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "a", "x"), "b", "y")
    got = {}
    for r in syncmers.align(df, "i", "x", "y").collect():
        got.setdefault(r.i, {})[r.shift] = (r.n_anchors, r.a_start, r.a_end)
    assert set(got) == {1, 2, 5}
    assert set(got[1]) == {0, 7} and got[1][0][2] <= 150 and got[1][7][1] >= 145
    assert set(got[2]) == {0} and got[2][0][0] > 100
    assert set(got[5]) == {100, -300} and got[5][100][2] < 300 <= got[5][-300][1]


def test_classifiers_on_held_out_rows(spark):
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for name, label, bar in (("op10_quality_classifier", "quality", 0.97), ("op7_toxicity", "toxic", 0.965)):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
        assert len(got) == 10_000
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        test = [(r.predicted, getattr(truth[r.doc_id], label)) for r in got if r.held_out and r.doc_id in truth]
        assert np.mean([p == y for p, y in test]) >= bar, name
        if label == "toxic":
            assert np.mean([p for p, y in test if y]) >= 0.9


def test_log_ratios_equal_counting():
    """The n-grams that enter the model and their ratios, from sets of strings instead of hashed arrays."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["calm", "mild", "Quiet!", "day", "vile" if i % 3 == 0 else "soft"]) for _ in range(12)) for i in range(120)]
    labels = np.array([int(i % 3 == 0) for i in range(120)])
    fold = lambda t: " " + re.sub(r"[^a-z0-9]", " ", t.lower()) + " "
    sets = [{fold(t)[j : j + n] for n in toxicity.GRAMS for j in range(len(fold(t)) - n + 1)} for t in texts]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    rows = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [len(r) for r in rows] == [len(s) for s in sets]
    model = toxicity.fit(rows, labels)
    want = 0
    for gram in set().union(*sets):
        c = [sum(gram in s for s, y in zip(sets, labels, strict=True) if y == k) for k in (0, 1)]
        ratio = np.log((c[1] + 1) / (40 + 2)) - np.log((c[0] + 1) / (80 + 2))
        want += abs(ratio) >= toxicity.SURE * (1 / (c[1] + 1) + 1 / (c[0] + 1)) ** 0.5
        got = toxicity.log_ratios(np.array([c[1]]), np.array([c[0]]), (80, 40))
        assert np.isclose(got[0][0], ratio)
    assert want > 3 and (model.weights != 0).sum() == want
    score = model.score(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert ((score >= 0.5) == np.array(["vile" in t for t in texts])).all()


def test_training_counts_equal_a_local_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = _labels.training_rows(docs, labels, "toxic", 5_000).collect()
    raw = [r.text.encode() for r in rows]
    local = toxicity.fit(toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])), np.array([r.label for r in rows]))
    got = toxicity.train(docs, labels)
    assert np.allclose(got.weights, local.weights, atol=1e-4) and np.isclose(got.bias, local.bias, atol=1e-4)


def test_factorisation_machine_equals_the_sum_over_pairs():
    texts = [(t or "").encode() for _, t in make_texts(5)][:40]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    r = quality.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    m = quality.fit(quality.per_row(r), np.arange(40) % 2, rounds=5)
    score = m.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, (ids, values, stats) in enumerate(quality.per_row(r)):
        x = [*zip(ids, values, strict=True), *((len(m.w) - len(stats) + j, s) for j, s in enumerate(m._stats(stats)))]
        z = m.bias + sum(m.w[a] * s for a, s in x)
        z += sum((m.v[a] @ m.v[b]) * s * t for j, (a, s) in enumerate(x) for b, t in x[j + 1 :])
        assert np.isclose(score[i], 1 / (1 + np.exp(-np.clip(z, -40, 40))))


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_classifiers_take_any_row(spark, kind):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, "z") for i, t in make_texts(9)] + [(None, None, "z"), (1, "again", "z")], "doc_id long, text string, score string")
    for part in (labels, labels.limit(0), labels.where("doc_id = 1")):
        model = kind.train(docs, part, "quality")
        got = kind.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert kind.score(docs.limit(0), model).count() == 0


def test_slices_do_not_change_scores():
    rows = make_texts(5)
    texts = [(t or "").encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    labels = np.array([i % 2 for i in range(len(rows))])
    tox = toxicity.fit(toxicity.features(buf, offsets), labels, rounds=5)
    good = quality.fit(quality.per_row(quality.features(buf, offsets)), labels, rounds=5)
    for m in (tox, good):
        whole = m.score(buf, offsets)
        each = np.concatenate([m.score(buf[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        assert np.allclose(whole, each)


def test_word_hashes_do_not_depend_on_place():
    h, at = T.shingles(np.frombuffer(b"one two threeone two three", np.uint8), np.array([0, 13, 13, 26]), 2)
    assert at.tolist() == [0, 2, 2, 4] and h[:2].tolist() == h[2:].tolist()

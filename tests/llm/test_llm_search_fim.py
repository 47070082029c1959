"""Lexical search, fill-in-middle and phrase removal against brute force and DuckDB."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from threadloom.llm import fill_middle, lexical, phrases, queries
from threadloom.llm import _text as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fill_in_middle", "op13_phrase_dedup"])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = want.fetchall()
    assert rows and sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(rows, key=repr)


def odd_rows():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "Beta", "x1", "é中", "gamma-ray", "of", "of", "the"])
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(40), prose(30_000)
    rows = [(i, prose(rnd.randrange(0, 60))) for i in range(1, 60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, shared), (64, "start " + shared + " end"), (65, long), (66, long), (67, "a\x00b \x0b c"), (68, "<P> in text")]
    return rows + [(7, shared), (7, "other text of seven"), (7, "other text of seven"), (None, shared), (None, "of"), (70, "w" * 5_000), (71, "of " * 300), (72, "of " * 500)]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "n", 2, {"output": 1}, "z") for i, t in rows], "doc_id long, text string, n string, _row int, kept map<string,int>, restored string"
    ).repartition(3)


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in {i for i, _ in items}:
        asked = [t for i, text in items if i == item for t in brute_terms(text)]
        scores = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in asked if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "shard_bytes", "block_terms"), [(20, 8 << 20, 200_000), (3, 2_000, 4), (200, 300, 10)])
def test_search_equals_brute_force(spark, k, shard_bytes, block_terms):
    docs = odd_rows()
    items = [(0, "Alpha of the BETA x1"), (1, "alpha alpha unknown"), (2, None), (3, "--"), (1, "x1"), (None, "gamma é中"), (5, "nowhere"), (6, "of of of")]
    asked = spark.createDataFrame([(i, t, 1, "c") for i, t in items], "item_id long, text string, rank int, term string")
    index = lexical.build(frame(spark, docs), shard_bytes=shard_bytes)
    got = lexical.search(index, asked, k, block_terms=block_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, k)
    assert got.schema.simpleString() == "struct<item:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "of")], "item_id long, text string")
    assert lexical.search(lexical.build(none), asked).count() == 0
    assert lexical.search(lexical.build(frame(spark, odd_rows())), asked.limit(0)).count() == 0


def test_merge_takes_the_best_in_order():
    rnd = random.Random(1)
    for _ in range(300):
        lists = []
        for _ in range(rnd.randrange(0, 7)):
            docs = sorted(rnd.sample(range(60), rnd.randrange(1, 50)))
            adds = [rnd.randrange(0, 1 + rnd.choice([1, 5, 100])) for _ in docs]
            lists.append((docs, adds, max(adds)))
        total = Counter()
        for docs, adds, _ in lists:
            total.update(dict(zip(docs, adds, strict=True)))
        want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))
        assert lexical.merge(lists, 5) == want[:5]


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 35) + 7, (1 << 62) + 5, 0])
    data, begin = lexical.pack_ints(values)
    assert lexical.unpack_ints(data.tobytes()).tolist() == values.tolist()
    assert begin[-1] == len(data) and begin[1] == 1
    assert lexical.unpack_ints(b"").tolist() == []


def brute_form(i, text, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[j : j + 8], 16) for j in (0, 8, 16, 24))
    unit = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    lo, hi = sorted((h1 % (len(unit) + 1), h2 % (len(unit) + 1)))
    p, m, s = "".join(unit[:lo]), "".join(unit[lo:hi]), "".join(unit[hi:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(unit), "plain", None, None, text
    if h4 % 100 < 80:
        return len(unit), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(unit), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_brute_force_and_give_the_text_back(spark):
    docs = odd_rows() + [(i, t) for i in range(100, 140) for t in (" lead  and trail\n", "<<P ><S", "S>x<M y< <P")]
    done = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, docs)))
    assert done.columns == ["doc_id", "_row", "kept", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    rows = done.collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows), key=repr)
    assert got == sorted(((i, *brute_form(i, t), t or "") for i, t in docs), key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_forms_of_an_empty_table_and_other_parameters(spark):
    assert fill_middle.restore(fill_middle.fill_in_middle(frame(spark, odd_rows()).limit(0))).count() == 0
    only = spark.createDataFrame([("a b c d",), (None,)], "text string").selectExpr("text", "text as id")
    rows = fill_middle.fill_in_middle(only, seed=1, rate=100, spm=0, id_col="id").collect()
    assert sorted(r.form for r in rows) == ["plain", "psm"]


def brute_phrases(docs, n):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    rank = lambda i: math.inf if i is None else i
    first = {}
    for i, w in split:
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            first[k] = min(first.get(k, math.inf), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < rank(i):
                gone[j : j + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [13, 4, 2])
def test_phrases_equal_brute_force(spark, n):
    docs = odd_rows()
    got = phrases.remove_phrases(frame(spark, docs), n)
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr) == brute_phrases(docs, n)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    assert phrases.remove_phrases(frame(spark, docs).limit(0), n).count() == 0


def test_phrases_across_groups_and_automata(spark, monkeypatch):
    """Many groups and buckets on the driver's side; small automata and pieces where a slice is solved."""
    from threadloom.llm import passages

    docs = odd_rows()
    monkeypatch.setattr(passages, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 30_000)
    rows = phrases.remove_phrases(frame(spark, docs), 5).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr) == brute_phrases(docs, 5)


def test_occurrences_over_small_automata(monkeypatch):
    monkeypatch.setattr(phrases, "PHRASE_WORDS", 9)
    monkeypatch.setattr(phrases, "PIECE", 7)
    rnd = np.random.default_rng(2)
    symbols = rnd.integers(0, 3, 400) * 50
    start = rnd.integers(0, 390, 60)
    end = start + rnd.integers(3, 10, 60)
    low = rnd.integers(0, 5, 60)
    got = set(zip(*(x.tolist() for x in phrases._occurrences(symbols, 101, start, end, low)), strict=True))
    known = {}
    for a, b, d in zip(start, end, low, strict=True):
        k = tuple(symbols[a:b])
        known[k] = min(d, known.get(k, d))
    want = {(i, i + len(k), d) for k, d in known.items() for i in range(400) if tuple(symbols[i : i + len(k)]) == k}
    assert got == want


def test_words_that_differ_have_different_hashes():
    """Two words over two letters whose polynomial hashes agree modulo 2**64, whatever the base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    buf = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = T.word_hash(buf, np.array([0, 1025]), np.array([1024, 2049]))
    assert h[0] != h[1]


def test_near_duplicates_tell_such_words_apart(spark):
    from threadloom.llm import minhash

    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    df = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()) == [(1, 1), (2, 2), (3, 1)]

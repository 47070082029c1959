"""URL filter, exact search, token files and packing against brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import knn, packing, queries, token_output, tokens, url_filter

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None,
    "",
    " \t\n",
    "Hello  World, it's 2024!",
    "a<|endoftext|>b <|startoftext|> c",
    "Caf\u00e9 cafe\u0301 \u03a3\u03a3 \u0130stanbul\u00a0non\u2003breaking \x1c sep",
    "x" * 20_000,
    "word " * 9_000,
    "word " * 9_000,
    "\u4e2d\u6587 \U0001f600 'll don't",
]


def reference_ids(text):
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, "clash", "extra") for i, t in enumerate(TEXTS)] + [(7, TEXTS[3], "clash", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block string")


def test_encoder_equals_the_library():
    e = tokens.Encoder(queries.tokenizer_path())
    for t in TEXTS:
        assert e.encode(t.encode() if t else None).tolist() == reference_ids(t)


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 8)
    e = tokens.Encoder(queries.tokenizer_path())
    for t in TEXTS * 2:
        assert e.encode(t.encode() if t else None).tolist() == reference_ids(t)


def test_token_files_round_trip(spark, docs, tmp_path):
    token_output.write_tokens(docs, f"{tmp_path}/t", queries.tokenizer_path(), 2, file_bytes=20_000)
    want = sorted((i, tuple(reference_ids(t) + [2])) for i, t, *_ in docs.collect())
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_output.read_tokens(spark, f"{tmp_path}/t").collect())
    assert got == want
    at = 0
    offsets = sorted(token_output.token_offsets(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in offsets] == [i for i, _ in want]
    for r in offsets:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in offsets) == sorted((i, len(x), crc(x)) for i, x in want)


def test_starts_follow_the_files(spark, tmp_path):
    """Rows that repeat an id, and rows without one: ``start`` is where the row's ids stand when the files are read one after another."""
    texts = ["a b c d e f", "a", "a b", None, "word " * 500, "a", "x y z"]
    rows = [(i, t) for i in (1, 1, None, 5, 1) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_output.write_tokens(df, f"{tmp_path}/t", queries.tokenizer_path(), 2, file_bytes=300)
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert len(files) > 3  # one id fills several
    flat = [(r.doc_id, list(r.ids)) for f in files for r in spark.read.orc(str(f)).orderBy("row").collect()]
    stream = [x for _, ids in flat for x in ids]
    assert [i for i, _ in flat] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    got = token_output.token_offsets(spark, f"{tmp_path}/t").collect()
    assert sorted(r.start for r in got) == [sum(len(x) for _, x in flat[:n]) for n in range(len(flat))]
    assert all(crc(stream[r.start : r.start + r.n_tokens]) == r.ids_crc32 for r in got)


def test_token_files_have_indexes(spark, tmp_path):
    """The stripes' footers: integers run-length encoded, a row index for each column, a Bloom filter on the ids; readers skip by id."""
    df = spark.range(5_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    token_output.write_tokens(df, f"{tmp_path}/t", queries.tokenizer_path(), 2, file_bytes=30_000)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert len(files) > 1
    ranges = []
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
        encodings = [c.getKind().toString() for c in footer.getColumnsList()]
        assert {("ROW_INDEX", 1), ("ROW_INDEX", 3)} <= streams and ("BLOOM_FILTER_UTF8", 1) in streams
        assert encodings[1] == "DIRECT_V2" and encodings[3] == "DIRECT_V2"
        stats = reader.getStatistics()[1]
        ranges.append((stats.getMinimum(), stats.getMaximum()))
        rows.close()
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    one = token_output.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 2400")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,2400)" in plan.split("PushedFilters")[1].split("\n")[0] and one.count() == 1


def test_token_files_of_an_empty_table(spark, docs, tmp_path):
    token_output.write_tokens(docs.limit(0), f"{tmp_path}/t", queries.tokenizer_path(), 2)
    assert token_output.token_offsets(spark, f"{tmp_path}/t").count() == 0


def check_packing(rows, want, capacity):
    """Pieces restore the documents and fill sequences gaplessly."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = sorted((i, p, s, min(capacity, len(x) - s), crc(x[s : s + capacity])) for i, x in want for p, s in enumerate(range(0, len(x), capacity)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack_restores_documents(docs, capacity):
    rows = packing.pack(docs, queries.tokenizer_path(), 1, capacity).collect()
    check_packing(rows, [(i, reference_ids(t) + [1]) for i, t, *_ in docs.collect()], capacity)


def test_pack_an_empty_table(docs):
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_tight(seed):
    rnd = random.Random(seed)
    capacity = 100
    lengths = [rnd.choice([rnd.randint(1, 100), rnd.randint(1, 30), rnd.randint(34, 60)]) for _ in range(3_000)]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    fill = defaultdict(list)
    seen = defaultdict(list)
    for n, first, many, b, offset in packing.plan_bins(dict(counts), capacity):
        seen[n] += range(first, first + many)
        for i in range(many):
            fill[b + i].append((offset, n))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    least = max(-(-sum(lengths) // capacity), sum(n > 50 for n in lengths))
    assert len(fill) <= 1.02 * least + 1


URLS = [
    "https://User@Blog.Example.NET/en/x?q#f",
    "http://example.net/en",
    "http://example.net/de/",
    "ftp://a.b.example.com/de/1",
    "http://notexample.com/de/1",
    "http://fr.org/fr/",
    "http://org/fr/x",
    "http://net",
    "http://net/",
    "no scheme",
    "",
    None,
    "http://a.net/?x://y.org/fr/",
    "http://a.b\n.net/\n",
    "x://",
]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.fixture(params=["10m", "-1"])
def joins(spark, request):
    """Joins with and without a broadcast of the index."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_url_filter(spark, joins):
    rules = [*queries.RULES, ("block", "com", ""), ("allow", "b.example.com", "/de")]
    df = spark.createDataFrame([(i % 9, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = sorted(map(repr, (tuple(r)[:5] for r in url_filter.filter_urls(df, rules).collect())))
    assert got == sorted(repr((i % 9, *judge(u, rules))) for i, u in enumerate(URLS * 2))
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_url_rules_end_with_the_host(spark, joins):
    paths = ["foo.org/x.net/", "web.archive.org/web/2020/http://www.example.com/de/a", "foo.com/y.org/fr/z", "foo.com/en/www.example.net/en/", "com.evil.org/", "company.com.de/"]
    paths += ["foo.com/a.net/b", "web.archive.org/web/2010/http://foo.net/x", "foo.net/x.org/fr/", "a.de/org/fr/", "community.io/com/", "com", "a.com", "x.com.de/", "netfoo/", "a.netfoo", "foo.b.net/fr/"]
    urls = [f"http://{x}" for x in paths]
    rules = [*queries.RULES, ("block", "com", ""), ("block", "net", "foo")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(repr, (tuple(r)[:5] for r in url_filter.filter_urls(df, rules).collect())))
    assert got == sorted(repr((i, *judge(u, rules))) for i, u in enumerate(urls))


def test_url_index_fetches_few_of_many_rules(spark):
    """10,000 rules: a URL runs the expressions of those filed under its own tokens, not of all."""
    rules = [("block", f"h{i}.example.com", f"/p{i % 7}/") for i in range(10_000)] + queries.RULES
    urls = [f"http://{'www.' * (i % 2)}h{i * 13}.example.com/p{i % 5}/x" for i in range(900)] + URLS
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(df, rules).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(repr((i, *judge(u, rules))) for i, u in enumerate(urls))
    assert max(r.candidates for r in got) <= 8 and sum(r.candidates for r in got) < 4 * len(urls)


def test_url_filter_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.filter_urls(df, queries.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_knn(rows, k, every):
    sound = [(i, np.floor(256 * np.asarray(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in sound:
        if q % every == 0:
            near = sorted((-int(x @ v), i) for i, v in sound if i != q and len(v) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_knn_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(200)]
    rows += [(700, None), (701, [None] * 6), (750, [float("nan")] * 6), (800, []), (850, [1.0, 2.0]), (851, [2.0, 2.0]), (None, [1.0] * 6), (900, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = brute_knn([(i, v) for i, v in rows], 5, 50)
    as32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_knn(as32, 5, 50)
    for pivots in (1, 7, 48):
        assert sorted(tuple(r) for r in knn.top_k(df, 5, 50, pivots=pivots).collect()) == want
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    monkeypatch.setattr(knn, "DATA_BYTES", 500)
    monkeypatch.setattr(knn, "PACK", 32)
    assert sorted(tuple(r) for r in knn.top_k(df, 5, 50).collect()) == want
    assert knn.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [2, 6, 30])
def test_knn_of_repeated_query_ids(spark, copies):
    """As the SQL has it: the pairs of all rows of a query's id, in one list for the id."""
    rng = np.random.default_rng(copies)
    rows = [(50, [1.0, 0.0])] * copies + [(100, [0.9, 0.0]), (100, [0.0, 0.9])]
    rows += [(101 + i % 30, [0.125, float(rng.integers(0, 8)) / 8]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with duckdb.connect() as con:
        con.execute("create table embeddings (vec_id bigint, embedding double[])")
        con.executemany("insert into embeddings values (?, ?)", rows)
        want = sorted((q, r, v, s) for q, r, v, s in con.execute(queries.ORACLE["op3_voronoi_knn"]).fetchall())
    assert len(want) == 10
    assert sorted(tuple(r) for r in knn.top_k(df, 5, 50).collect()) == want


def test_knn_prunes_clustered_data(spark):
    """Of eight far clusters no vector goes to the queries of another; unstructured data are moved once for all groups."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 20 + rng.normal(size=8) * 0.1).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    report = {}
    assert sorted(tuple(r) for r in knn.top_k(df, 5, 50, report=report).collect()) == brute_knn(rows, 5, 50)
    assert report[8]["copied"] < 0.2, report
    even = [(i, rng.normal(size=64).tolist()) for i in range(600)]
    df = spark.createDataFrame(even, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df, 5, 50, report=report).collect()) == brute_knn(even, 5, 50)
    assert report[64]["together"] > 1, report


def test_knn_of_large_components_and_many_lengths(spark):
    """Products beyond 53 bits are exact, and one odd vector ends nothing; rare lengths are compared, too."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 2 + i % 9)]) for i in range(300)]
    rows += [(1000, [2.0**33, 1.0]), (1001, [2.0**20, 2.0**12]), (1002, [2.0**20, 2.0**12 + 1]), (1050, [1e300, -1.0]), (1051, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in knn.top_k(df, 5, 50).collect())
    exact = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    ends = lambda n: max(-(2**63) + 1, min(2**63 - 1, n))
    want = []
    for q, x in exact:
        if q % 50 == 0:
            near = sorted((-ends(sum(a * b for a, b in zip(x, v, strict=True))), i) for i, v in exact if i != q and len(v) == len(x))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_knn_salts_are_even():
    ids = np.arange(1 << 20)
    seen = np.bincount([knn._salt(ids[at : at + knn.PACK], 16) for at in range(0, len(ids), knn.PACK)], minlength=16)
    assert seen.min() > 32 and seen.max() < 100, seen


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == [(0, 1, 1, 65536), (0, 2, 50, 65536), (50, 1, 0, 65536), (50, 2, 1, 65536)]
    assert df.agg(F.count("*")).first()[0] == 3

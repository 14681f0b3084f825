"""The engine's own operators on hand-traced cases."""

import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions import urls
from corpusloom.functions import vectors as V
from corpusloom.functions.embed import CHUNK, chunks, embedded, hash_embedder
from corpusloom.functions.words import STOP_WORDS, measure, stem, with_stem
from corpusloom.operators import blocks
from corpusloom.operators import index as I
from corpusloom.operators import search as S
from corpusloom.operators import spell
from corpusloom.operators import tokens as T
from corpusloom.plans import catalogue, crawl
from corpusloom.runtime import ship
from corpusloom.sources import html, robots, sitemap

STEMS = dict(
    pair.split(">")
    for pair in (
        "cats>cat jumping>jump searching>search adoption>adopt electrical>electr formative>form sing>sing fast>fast us>us bus>bu possesses>possess possess>possess ponies>poni "
        "agreed>agree relational>relate hopefulness>hope visualization>visual adjustment>adjust replacement>replac"
    ).split()
)


@pytest.fixture(scope="module", autouse=True)
def _shipped(spark):
    ship(spark)


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    df = with_stem(spark.createDataFrame([(w,) for w in STEMS], "word string"), "word", "s")
    assert {r["word"]: r["s"] for r in df.collect()} == STEMS
    assert len(STOP_WORDS) == 57
    m = spark.createDataFrame([("",), ("tree",), ("trouble",), ("private",)], "w string").select("w", measure(F.col("w")).alias("m"))
    assert {r["w"]: r["m"] for r in m.collect()} == {"": 0, "tree": 0, "trouble": 1, "private": 2}


def test_tokens(spark):
    rows = [
        (1, 0, "b", "See https://Ex.com/Path?q=1 and 10.0.0.1, v2 of 3 Cats"), (2, 0, "b", "jane@mail.org"), (3, 0, "b", "mail jane@mail.org"), (4, 0, "b", "xhttps://a.com/B https://localhost"),
        (5, 0, "b", None), (6, 0, "b", ""), (7, 0, "b", "z" * 30_000),
    ]
    t = T.tokens(spark.createDataFrame(rows, "doc_id int, ord int, type string, text string")).orderBy("doc_id", "tok").collect()
    of = lambda i: [(r["token"], r["class"]) for r in t if r["doc_id"] == i]
    assert of(1) == [("see", "WORD"), ("https://Ex.com/Path?q=1", "URL"), ("and", "WORD"), ("10.0.0.1", "IPV4"), ("v2", "ALPHANUMERIC"), ("of", "WORD"), ("3", "NUMBER"), ("cats", "WORD")]
    assert of(2) == [("jane@mail.org", "EMAIL")] and [x for x, _ in of(3)] == ["mail", "jane", "mail", "org"]
    assert of(4) == [("x", "WORD"), ("https://a.com/B", "URL"), ("https", "WORD"), ("localhost", "WORD")]
    assert not of(5) and not of(6) and len(of(7)) == 1


def equals_sql(spark, folder, name, *tables):
    """The rows of a query over the tables in a folder are those that DuckDB's SQL gives."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


PASSAGES = [(1, 0, "h", "Fast Search"), (1, 1, "b", "The search of 3 cats, v2")]


def small_index(spark):
    p = spark.createDataFrame(PASSAGES, "doc_id int, ord int, type string, text string")
    return I.build(spark.createDataFrame([(1, "https://e.org/search")], "doc_id int, url string"), p)


def test_index(spark, tmp_path):
    x = small_index(spark)
    got = {r["term"]: (r["tf"], [f"{p['i']}{p['type']}" for p in r["positions"]]) for r in x.postings.collect()}
    assert got == {"fast": (1, ["0h"]), "search": (2, ["1h", "2b"]), "cat": (1, ["3b"]), "v2": (1, ["4b"])}
    assert x.documents.first()["word_count"] == 5
    assert {r["word"] for r in x.words.collect()} == {"fast", "search", "cats"}
    x.save(str(tmp_path / "ix"), 4)
    again = I.Index.load(spark, str(tmp_path / "ix"))
    assert again.postings.count() == 4 and again.statistics().first()["avg_len"] == 5


@pytest.mark.parametrize("text,slots,coverage,near", [("search 3 cat", 3, 2 / 3, None), ("fast cat", 2, 1, 3), ("search search", 2, 1, 1), ("search", 1, 1, 0), ("serch", 1, 1, 0), ("the of", 0, None, None)])
def test_search(spark, text, slots, coverage, near):
    x = small_index(spark)
    q = spark.createDataFrame([(7, text)], "query_id int, text string")
    assert S.query_terms(q, x).count() == slots
    got = S.search(q, x).collect()
    if coverage is None:
        assert not got
    else:
        (r,) = got
        assert r["query_coverage"] == pytest.approx(coverage) and r["term_proximity"] == near and r["rank"] == 0
        assert r["words_in_header"] == (text != "cat") and r["len_url"] == 20


def test_proximity(spark):
    rows = [([[1, 7, 20], [3, 8], [10, 12]], 3), ([[5]], 0), ([[9], [2]], None), ([[1], []], None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, l array<array<int>>").select("i", S.proximity(F.col("l")).alias("p"))
    assert [r["p"] for r in df.orderBy("i").collect()] == [r[1] for r in rows]


def test_positions_are_capped(spark):
    p = spark.createDataFrame([(1, 0, "b", "word " * 700)], "doc_id int, ord int, type string, text string")
    (r,) = I.postings(T.positioned(p)).collect()
    assert r["tf"] == 700 and [x["i"] for x in r["positions"]] == list(range(500))


def test_formulas(spark):
    r = spark.range(1).select(S.idf(F.lit(10), F.lit(3)).alias("i")).withColumn("b", S.bm25(F.col("i"), F.lit(2), F.lit(100), F.lit(120.0))).first()
    assert r["i"] == pytest.approx(1.916290731874155) and r["b"] == pytest.approx(2.764484990244683)
    df = spark.createDataFrame([(0.999,), (-0.129,), (0.29,)], "x double").select(V.truncated(F.col("x")).alias("t"))
    assert [x["t"] for x in df.collect()] == [0.99, -0.12, 0.28]
    n = S.words_in_url(F.lit("https://e.org/ABCabc"), F.array(F.lit("abc"), F.lit("zzz")))
    assert spark.range(1).select(F.log1p(n).alias("l")).first()["l"] == pytest.approx(math.log(4))
    z = S.standardized(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0)], "g int, x double"), ("x",), ["g"])
    assert [round(r["z_0"], 4) for r in z.orderBy("g", "x").collect()] == [-1.2247, 0, 1.2247, 0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [None if r["c"] is None else round(r["c"], 4) for r in v.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.7071, 0, 0, None]


def test_spelling(spark):
    q = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    g = I.ngrams(q("banana", "ab")).collect()
    assert [(r["gram_pos"], r["ngram"]) for r in g] == [(0, "ban"), (1, "ana"), (2, "nan")]
    words = spark.createDataFrame([("cart", 1), ("scat", 3), ("xyzxyz", 2), ("sitten", 4), ("sitting", 5)], "word string, first_seen int")
    one = lambda w, **k: spell.replacements(q(w), words, **k).first()["replacement"]
    assert one("car") == "cart" and one("abc") == "abc" and one("kitten") == "sitten"
    far = spark.createDataFrame([("abcdxx", 1), ("abcdez", 2)], "word string, first_seen int")
    assert [spell.replacements(q("abcdef"), far, mode=m).first()["replacement"] for m in ("first", "nearest")] == ["abcdxx", "abcdez"]


PAGES = [
    ("<title>T</title><h1>A <b>x</b></h1><p>body</p>", ["bT", "hA", "hx", "bbody"]),
    ('<div class="ad"><div>inner</div>leak</div>after', ["bleak", "bafter"]),
    ('<div class="header">x</div>y', ["by"]),
    ('<div class="ad"/>x', ["bx"]),
    ("<h1>a<h2>b</h1>c</h2>d", ["ha", "hb", "hc", "hd"]),
    ('<script>var t="</p>";</script>ok &amp; on', ["bok & on"]),
    ('<nav><a href="/q">q</a></nav><a href="/z">z</a>', ["bz"]),
    ("<nav>never closed <p>lost", []),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_html(page, want):
    assert [k + t for k, t in html.parse(page)[0]] == want


def test_entities_that_are_cut_off():
    page = "<h1>a&amp;&amp</h1>&lt;b&quot; &copy;&am &notit; &nosuch; &#65;&#66 &amp;amp"
    text = lambda **o: [k + t for k, t in html.parse(page, **o)[0]]
    assert text() == ["ha&&", 'b<b" \xa9&am \xacit; &nosuch; AB &amp']
    assert text(open_entities=False) == ["ha&&amp", 'b<b" \xa9&am &notit; &nosuch; A&#66 &amp']


@pytest.mark.parametrize("name", "html_passages header_passages garbage_removed full_text words_in_header page_positions index_pages stream_ingest_counts".split())
def test_queries_over_cut_off_entities_equal_their_sql(spark, tmp_path, name):
    pages = [(i, f"https://e.org/{i}", f"<title>t{i} x&amp</title><h1>Some&amp;&amp;&amp</h1><p>body text &quot;{i}&quot; &am") for i in range(3)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    equals_sql(spark, tmp_path, name, "pages")


def test_parsing_holds_few_pages_at_once():
    """What Python's objects take hardly grows with the batch."""
    import tracemalloc

    import pyarrow as pa

    page = "".join(f'<p>passage {{0}} {i}</p><a href="/{{0}}/{i}">x</a>' for i in range(40))
    peak = {}
    for n in (500, 4000):
        batch = pa.array([page.format(i) for i in range(n)])
        tracemalloc.start()
        out = html._told(batch, False, True, True, True)
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n and out[n - 1].as_py() == {"passages": [{"type": k, "text": x} for k, x in html.parse(page.format(n - 1))[0]], "hrefs": html.parse(page.format(n - 1))[1]}
    assert peak[4000] < 1.5 * peak[500]
    assert html._told(batch.slice(0, 1), False, True, False, True)[0].as_py()["passages"] == [] and len(html._told(batch.slice(0, 0), False, True, True, True)) == 0


def test_html_links(spark):
    pages = spark.createDataFrame([(1, "https://e.org", PAGES[6][0]), (2, "https://e.org", None), (3, "http://e.org", PAGES[6][0])], "page_id int, url string, html string")
    got = html.links(html.parsed(pages)).collect()
    assert [(r["src_id"], r["link"], r["same_domain"]) for r in got] == [(1, "https://e.org/z", True)]
    assert html.links(html.parsed(pages, links_in_garbage=True)).count() == 2


def test_urls(spark):
    assert urls.normalized("https://www.Example.com:8080//a//b/?b=2&a=1#x") == "example.com/a/b?a=1&b=2"
    assert urls.absolute("../z#f", "https://a.com/x/y") == "https://a.com/z" and urls.absolute("//b.com/q", "https://a.com/x") == "https://b.com/q"
    assert all(urls.absolute(x, "https://a.com") is None for x in ("#top", "javascript:f()", "", None, "http://c.com", "mailto:x@y"))
    assert urls.absolute("/x", "http://a.com") is None and urls.normalized(None) is None
    df = spark.createDataFrame([("https://b.com/", "https://ab.com/"), ("https://x.b.com/", "https://b.com/")], "l string, b string")
    assert [r["s"] for r in df.select(urls.same_origin(F.col("l"), F.col("b")).alias("s")).collect()] == [True, False]


def test_robots(spark):
    body = "Disallow: /early\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 5\nuser-agent:*\n# c\nUser-agent: bot\nDisallow: /b\n"
    r = robots.rules(spark.createDataFrame([("h", body), ("e", "")], "host string, body string"))
    got = {x["agent"]: (x["allow"], x["disallow"], x["delay"]) for x in r.collect()}
    assert got == {"*": (["/private/ok"], ["/private"], 5), "bot": ([], ["/b"], 0)}
    u = spark.createDataFrame([("h", "/private/ok"), ("h", "/public"), ("h", "/b/x"), ("e", "/x")], "host string, path string")
    assert {(x["host"], x["path"]): x["allowed"] for x in robots.allowed(u, r, "other").collect()} == {("h", "/private/ok"): False, ("h", "/public"): True, ("h", "/b/x"): True, ("e", "/x"): True}
    assert {x["path"]: x["allowed"] for x in robots.allowed(u, r, "bot").where("host = 'h'").collect()} == {"/private/ok": True, "/public": True, "/b/x": False}
    at = robots.fetch_schedule(robots.allowed(u, r, "other"))
    assert sorted(x["fetch_at"] for x in at.where("host = 'h'").collect()) == [0, 5, 10]


def test_sitemap(spark):
    xml = "<urlset" + sitemap.NAMESPACE + "><url><loc>/a</loc></url><url><loc>https://o.org/b</loc></url></urlset>"
    s = lambda x: spark.createDataFrame([("https://e.org/", x)], "base_url string, xml string")
    assert [(r["link"], r["same_domain"]) for r in sitemap.links(s(xml)).orderBy("ord").collect()] == [("https://e.org/a", True), ("https://o.org/b", False)]
    assert sitemap.links(s(xml), True).count() == 1 and sitemap.links(s("")).count() == 0
    with pytest.raises(Exception):
        sitemap.links(s("<urlset><url>")).collect()
    df = spark.createDataFrame([("https://e.org/",), ("https://e.org/sitemap_2.xml",)], "u string").select(sitemap.sitemap_url(F.col("u")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["https://e.org/sitemap.xml", "https://e.org/sitemap_2.xml"]


def test_content_hash(spark):
    p = spark.createDataFrame([(1, 0, "h", "a"), (1, 1, "b", "c"), (2, 0, "h", "a"), (2, 1, "b", "c"), (3, 0, "b", "a"), (3, 1, "b", "c")], "doc_id int, ord int, type string, text string")
    assert {r["doc_id"]: (r["first_id"], r["is_alias"]) for r in I.deduplicated(I.content_hash(p)).collect()} == {1: (1, False), 2: (1, True), 3: (3, False)}
    assert {r["doc_id"]: r["text"] for r in html.full_text(p).collect()} == {1: "ac", 2: "ac", 3: "ac"}


def reranked(spark, n, relevance):
    top = spark.createDataFrame([(1, p, p, float(relevance(p))) for p in range(n)], "query_id int, doc_id int, rank int, f double")
    before = S.standardized
    S.standardized = lambda df, columns, by: df.withColumn("z_0", F.col("f"))
    try:
        return {r["rank"]: r["doc_id"] for r in S.reranked(top, [1.0], 0.0, ("f",)).collect()}
    finally:
        S.standardized = before


def test_rerank(spark):
    same = {p: p for p in range(23)}
    assert reranked(spark, 23, lambda p: p in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 20) and p != 0) == same | {0: 20, 20: 0}
    assert reranked(spark, 10, lambda p: 1) == {p: p for p in range(10)}
    got = reranked(spark, 23, lambda p: p in (10, 11, 13))  # class 2 has no winner: it and class 3 stay
    assert got == same | {0: 10, 10: 0, 1: 11, 11: 1}


def test_crawl(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("C", "D"), ("C", None)], "src string, dst string")
    depths = lambda d: {r["page"]: r["depth"] for r in crawl.frontier(spark.createDataFrame([("A",), (None,)], "page string"), e, d).collect()}
    assert depths(3) == {"A": 0, "B": 1, "C": 1, "D": 2} and depths(2) == {"A": 0, "B": 1, "C": 1}


def test_embedder(spark):
    assert chunks(0) == [(0, 0)] and chunks(CHUNK) == [(0, CHUNK)] and chunks(CHUNK + 1) == [(0, CHUNK), (CHUNK - 50, CHUNK + 1)]
    v = hash_embedder(["some words", "", "w " * 1000])
    assert [len(x) for x in v] == [1, 1, 3] and sum(y * y for y in v[0][0]) == pytest.approx(1)
    df = spark.createDataFrame([(1, "some words"), (2, None)], "i int, t string").select("i", embedded(spark, F.col("t")).alias("v"))
    assert {r["i"]: r["v"] and len(r["v"]) for r in df.collect()} == {1: 1, 2: None}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"base_urls": ["https://e.org"], "index_path": "x", "unknown": 1}))
    c = Config.load(str(tmp_path / "c.json"))
    assert c.validate() is c
    c.worker_count, c.ngram_count, c.index_path = 40, 9, ""
    with pytest.raises(ValueError, match="index_path is required; worker_count .* ngram_count"):
        c.validate()


def test_streaming_repeats_and_aliases(spark, tmp_path):
    from corpusloom.streaming import ingest

    landing, store = str(tmp_path / "in"), str(tmp_path / "ix")
    put = lambda rows: spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.mode("append").parquet(landing)
    put([(1, "https://e.org/a", "<p>first text</p>"), (2, "https://e.org/b", "<p>other words here</p>")])
    ingest.ingest(spark, landing, store).awaitTermination()
    put([(3, "https://www.e.org/a/", "<p>newer version of it</p>"), (4, "https://e.org/c", "<p>other words here</p>")])
    ingest.ingest(spark, landing, store).awaitTermination()
    x = ingest.snapshot(spark, store)
    assert x.documents.count() == 3 and x.documents.where("is_alias").count() == 1
    q = spark.createDataFrame([(1, "version"), (2, "first"), (3, "words")], "query_id int, text string")
    got = S.search(q, x, correct=False).collect()
    assert sorted((r["query_id"], r["url"]) for r in got) == [(1, "https://www.e.org/a/"), (3, "https://e.org/b")]


def test_queries_and_sql(spark, small):
    names = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(names) and len(names) > 40
    import __spark_entry__

    assert set(names) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_read_the_folders_of_their_keys(spark, tmp_path):
    x = small_index(spark)
    x.save(str(tmp_path / "ix"), 16)
    again = I.Index.load(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(7, "search")], "query_id int, text string")
    terms = S.query_terms(q, again, correct=False)
    plan = plan_of(S.features(terms, again))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    found = I.pruned(again.postings, "term", terms, 16)
    assert found.select("bucket").distinct().count() == 1 and S.search(q, again).first()["bm25"] == pytest.approx(S.search(q, x).first()["bm25"])
    asked = spark.createDataFrame([("serch",)], "word string")
    assert "bucket" in plan_of(spell.candidates(asked, again)) and [r["candidate"] for r in spell.candidates(asked, again).collect()] == [r["candidate"] for r in spell.candidates(asked, x).collect()]
    assert spell.replacements(asked, again).first()["replacement"] == "search"
    assert again.document(spark.createDataFrame([(1,), (1,), (5,)], "doc_id int")).collect()[0]["url"] == "https://e.org/search"


def test_tokens_are_told_once(spark):
    p = spark.createDataFrame(PASSAGES, "doc_id int, ord int, type string, text string")
    for df in (T.kept(T.tokens(p)).where("class = 'WORD'").groupBy("token").count(), T.term_counts(p), I.postings(T.placed(p))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(text#") == 1, plan
    assert {(r["term"], r["tf"]) for r in T.term_counts(p).collect()} == {("fast", 1), ("search", 2), ("cat", 1), ("v2", 1)}


ODD = [
    (1, 0, "h", "Fast Search of 10.0.0.1"), (1, 1, "b", None), (1, 2, "b", "searching Caf\xe9s, v2 2024 \u0391\u03a3 \u0130x"), (2, 0, "b", "jane@Mail.org"), (2, 1, "b", "see https://Ex.com/P?q=a@b and " + "b" * 70),
    (3, 0, "b", ""), (4, 0, "b", "word " * 700), (None, 0, "b", "no id"), (None, 1, "h", "no id"),
]


def test_blocks_of_documents_equal_tokens_told_in_the_engine(spark):
    p = spark.createDataFrame(ODD, "doc_id bigint, ord int, type string, text string")
    w = Window.partitionBy("doc_id").orderBy("ord", "i")
    t = p.select("doc_id", "ord", "type", F.posexplode(T._indexed(F.col("text"))).alias("i", "t")).select("doc_id", "ord", "i", "type", "t.token", "t.class")
    want = T.with_term(t).withColumn("pos", F.row_number().over(w) - 1).select("doc_id", "type", "term", "pos")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(T.positioned(p)) == rows(want) and want.count() == 712
    assert rows(T.term_counts(p)) == rows(want.groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    assert rows(I.posted(p)) == rows(I.postings(want))
    assert rows(blocks.document_frequencies(p)) == rows(T.term_counts(p).groupBy("term").agg(F.count("*").alias("df")))
    at = I.posted(p).select("doc_id", "term", F.posexplode("positions.i").alias("k", "i"))
    far = at.alias("a").join(at.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.term = b.term and b.k = a.k + 2")).groupBy("a.doc_id", "a.term").agg(F.min(F.expr("b.i - a.i")).alias("span"))
    assert rows(S.self_proximity(I.posted(p), 3)) == rows(far) and far.count() == 1


def test_tokens_are_no_rows_before_their_document_is_done(spark):
    """One shuffle, of texts; grouping single tokens sorted, and spilled, all of them."""
    p = spark.createDataFrame(PASSAGES, "doc_id int, ord int, type string, text string")
    for df in (T.term_counts(p), T.positioned(p), I.posted(p), S.self_proximity(I.posted(p), 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and not any(x in plan for x in ("Generate", "Aggregate", "Window")), plan
        assert plan.index("regexp_extract_all(text#") < plan.index("RepartitionByExpression")


def test_blocks_hold_whole_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "BLOCK", 3)
    ids, runs = [1, 1, 2, 3, 3, 3, 3, None, None, 5], [["a"], None, ["b", "c"], ["d", "e", "f", "g"], [], ["h"], ["i", "j", "k"], ["l"], ["m"], ["n"]]
    batch = lambda a, z: pa.record_batch([pa.array(ids[a:z], pa.int64()), pa.array(runs[a:z], pa.list_(pa.string()))], ["doc_id", "runs"])
    for cuts in ([0, 10], [0, 4, 5, 8, 10], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]):
        out = [b["doc_id"].to_pylist() for b in blocks._documents(iter([batch(a, z) for a, z in zip(cuts, cuts[1:])]))]
        assert sum(out, []) == ids and len(out) > 1 and all(a[-1] != z[0] for a, z in zip(out, out[1:]))


def test_vector_sort_has_no_key_of_proximity(spark, tmp_path):
    texts = ["ention x onnt ha", "ention onnt x ha", "ention onnt ha x", "x ention y z onnt ha", "ention y z x onnt ha", "x y", "ha ha"]
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (7, [1.0, 1.0], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    equals_sql(spark, tmp_path, "vector_sort", "documents", "embeddings")


def test_packed_postings_are_whole(spark):
    p = I.posted(spark.createDataFrame(ODD, "doc_id bigint, ord int, type string, text string"))
    few = blocks.packed(p.withColumn("part", I.bucket("term", 8))).repartitionById(8, "part")
    assert sorted(map(repr, blocks.unpacked(few, p.schema).collect())) == sorted(map(repr, p.collect()))


def test_long_words_are_indexed_by_their_stems(spark):
    long, kept = "b" * 64 + "ing", "ba" * 30 + "ational"
    p = spark.createDataFrame([(1, 0, "b", f"{long} {kept} x")], "doc_id int, ord int, type string, text string")
    assert len(stem(long)) > 64 and len(kept) > 64 >= len(stem(kept))
    assert {r["term"]: r["pos"] for r in T.positioned(p).collect()} == {stem(kept): 0, "x": 1}


def test_missing_features_are_zero(spark):
    top = spark.createDataFrame([(1, p, p, None if p % 2 else float(p)) for p in range(20)], "query_id int, doc_id int, rank int, f double")
    z = {r["rank"]: r["z_0"] for r in S.standardized(top, ("f",), ["query_id"]).collect()}
    values = [0.0 if p % 2 else float(p) for p in range(20)]
    mean = sum(values) / 20
    dev = math.sqrt(sum((v - mean) ** 2 for v in values) / 20)
    assert all(z[p] == pytest.approx((v - mean) / dev) for p, v in enumerate(values))
    got = {r["rank"]: r["doc_id"] for r in S.reranked(top, [1.0], 0.0, ("f",)).collect()}
    assert got[0] == 10 and got[10] == 0 and got[1] == 1  # class 1, all of it missing, has no winner


def test_followed_links(spark):
    links = spark.createDataFrame([(1, "https://e.org/", o, u, True) for o, u in enumerate(["https://e.org/a", "https://e.org/b", "https://e.org/c/", "https://e.org/private/x", "https://e.org/d"])], "src_id int, base string, ord int, link string, same_domain boolean")
    rules = robots.rules(spark.createDataFrame([("e.org", "user-agent: *\ndisallow: /private\n")], "host string, body string"))
    visited = spark.createDataFrame([("e.org/a", 5), ("e.org/b", 1), ("e.org/c", 3), ("e.org/c", 0)], "url string, depth int")
    got = html.followed(links, 1, rules, "bot", visited)
    assert [r["link"] for r in got.orderBy("ord").collect()] == ["https://e.org/d", "https://e.org/a"]
    assert [r["ord"] for r in got.orderBy("ord").collect()] == [0, 1] and html.followed(links, 1).count() == 5


def test_fetched_pages_and_types(spark):
    rows = [(1, 200, "text/html"), (2, 204, "Text/HTML; charset=x"), (3, 404, "text/html"), (4, 200, "text/plain"), (5, None, "text/html"), (6, 200, None)]
    assert {r["i"] for r in html.usable(spark.createDataFrame(rows, "i int, status int, content_type string")).collect()} == {1, 2}
    df = lambda k: spark.createDataFrame([(k, "x")], "k string, t string").select(html.typed(F.col("k"), F.col("t")).alias("p"))
    assert [df(k).first()["p"]["type"] for k in "bhq"] == ["b", "h", "q"]
    for k in ("z", None):
        with pytest.raises(Exception, match="unknown type"):
            df(k).collect()


def test_crawl_state_and_link_bank(spark, tmp_path):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "page string")
    crawl.save_visited(crawl.frontier(seeds, e, 3), str(tmp_path / "state"))
    state = crawl.load_visited(spark, str(tmp_path / "state"))
    assert {r["page"]: r["depth"] for r in state.collect()} == {"A": 0, "B": 1, "C": 2}
    again = crawl.frontier(spark.createDataFrame([("B",)], "page string"), e, 3, state)
    assert {r["page"]: r["depth"] for r in again.collect()} == {"B": 0, "C": 1, "D": 2}  # C is nearer now
    assert {r["page"] for r in crawl.frontier(seeds, e, 3, state).collect()} == {"A"}
    links = spark.createDataFrame([(i, j, f"https://e.org/{j}", True) for i in range(40) for j in range(2)], "src_id int, ord int, link string, same_domain boolean")
    crawl.save_links(links, str(tmp_path / "bank"), 8)
    found = crawl.links_of(spark, str(tmp_path / "bank"), spark.createDataFrame([(7,), (7,), (99,)], "src_id int"), 8)
    assert sorted((r["src_id"], r["ord"]) for r in found.collect()) == [(7, 0), (7, 1)]


def test_command_line(spark, tmp_path, capsys):
    from corpusloom import __main__ as cli

    (tmp_path / "c.json").write_text(json.dumps({"base_urls": ["https://e.org"], "index_path": str(tmp_path / "ix")}))
    pages = [(1, "https://e.org/a", "<h1>Fast search</h1>", 200, "text/html"), (2, "https://e.org/b", "<p>other words</p>", 200, "text/html"), (3, "https://e.org/c", "fast", 500, "text/html")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, status int, content_type string").write.parquet(str(tmp_path / "pages"))
    config = Config.load(str(tmp_path / "c.json"))
    assert cli.index(spark, config, str(tmp_path / "pages")) == 2
    assert cli.answer(spark, config, ["serch", "words nothing"]) == [(0, 1, "https://e.org/a"), (1, 1, "https://e.org/b")]
    assert cli.main(["search", str(tmp_path / "c.json"), "fast"]) == 0 and "1. https://e.org/a" in capsys.readouterr().out
    assert cli.main(["index"]) == 2 and cli.main(["nothing", "x"]) == 2


def test_intermediates_go_at_the_end(spark, tmp_path):
    from corpusloom import runtime

    path = runtime.fresh_path(spark, "t")
    assert path.startswith(runtime.shared_dir(spark) + "/corpusloom-")
    (tmp_path / "x" / "y").mkdir(parents=True)
    runtime._remove(spark.sparkContext._jvm, spark.sparkContext._jsc, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()


def plain_search(pages, queries, weights, max_typo=2):
    """The whole search in plain Python: (query, rank) -> (doc_id, bm25, cos)."""
    import re

    def cut(text):
        return re.findall(r"[a-z0-9]+", text.lower())

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    post, length, vec, seen = {}, {}, {}, []
    for i, url, page in pages:
        passages, pos = html.parse(page)[0], 0
        for kind, text in passages:
            for w in cut(text):
                if w in STOP_WORDS:
                    continue
                if w.isalpha() and w not in seen:
                    seen.append(w)
                if not w.isdigit():
                    post.setdefault(stem(w) if w.isalpha() else w, {}).setdefault(i, []).append((pos, kind))
                    pos += 1
        length[i], vec[i] = pos, hash_embedder(["".join(t for _, t in passages)])[0][0]
    mean = sum(length.values()) / len(length)
    out = {}
    for q, text in queries:
        slots = []
        for w in cut(text):
            if w in STOP_WORDS:
                continue
            term = stem(w) if w.isalpha() else w
            if w.isalpha() and term not in post:
                found = [(min(p for p in range(len(w) - 2) if w[p : p + 3] in c), k, c) for k, c in enumerate(seen) if any(w[p : p + 3] in c for p in range(len(w) - 2)) and near(w, c) <= max_typo]
                term = stem(min(found)[2]) if found else term
            slots.append(term)
        qv, rows = hash_embedder([text])[0][0], []
        for i, url, _ in pages:
            hit = [t for t in slots if i in post.get(t, {})]
            if not hit:
                continue
            idf = {t: math.log(len(pages) / (len(post[t]) + 1)) + 1 for t in hit}
            bm = sum(idf[t] * len(post[t][i]) * 2.2 / (len(post[t][i]) + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t in hit)
            prox = None
            if len(hit) == len(slots):
                for s, _ in post[slots[0]][i]:
                    at = s
                    for t in slots[1:]:
                        at = min((p for p, _ in post[t][i] if at is not None and p > at), default=None)
                    if at is not None:
                        prox = at - s if prox is None else min(prox, at - s)
            in_url = sum(len(t) for t in slots if t in url.lower())
            dist = math.sqrt(sum((x - y) ** 2 for x, y in zip(vec[i], qv)))
            cos, n = cosine(vec[i], qv), sum(len(post[t][i]) for t in hit)
            header = float(any(k == "h" for t in hit for _, k in post[t][i]))
            features = [cos, dist, n, header, len(hit) / len(slots), len(hit) / n, float(S.NO_MATCH if prox is None else prox), header, math.log1p(in_url), len(url)]
            key = (-math.trunc(cos * 100), math.trunc(dist * 100), -round(bm, 9), -(S.NO_MATCH if prox is None else prox), -round(sum(length[i] * idf[t] for t in hit), 9), i)
            rows.append((key, i, bm, cos, features))
        rows.sort()
        for c in range(10):
            members = list(range(c, len(rows), 10))
            if len(members) < 2:
                continue
            cols = list(zip(*(rows[m][4] for m in members)))
            score = [0.0] * len(members)
            for w, col in zip(weights, cols):
                m = sum(col) / len(col)
                dev = 1.0 if max(col) - min(col) <= 1e-12 * abs(m) else math.sqrt(sum((x - m) ** 2 for x in col) / len(col))
                score = [s + w * (x - m) / dev for s, x in zip(score, col)]
            best = next((k for k, s in enumerate(score) if s > 0), None)
            if best is None:
                break
            a, b = members[0], members[best]
            rows[a], rows[b] = rows[b], rows[a]
        out |= {(q, r): (i, bm, cos) for r, (_, i, bm, cos, _) in enumerate(rows)}
    return out


def test_search_against_plain_python(spark):
    import random

    rng = random.Random(3)
    words = "river stone cloudy forest running winters library garden relational hopeful 2024 v2 the of and".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [(i, f"https://e.org/{rng.choice(words)}/{i}", f"<h1>{text(2)}</h1><p>{text(rng.randint(3, 40))}</p>") for i in range(60)]
    queries = [(1, "the river of stone"), (2, "forrest wintrs"), (3, "library 2024"), (4, "hopeful v2 garden"), (5, "nothingatall")]
    weights = [0.7, -0.5, 0.2, 0.1, 0.5, 0.1, 0.0, 0.1, 0.1, -0.3]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    p = html.passages(html.parsed(df))
    vectors = html.full_text(p).select("doc_id", embedded(spark, F.col("text")).alias("word_vec"))
    x = I.build(df.selectExpr("page_id as doc_id", "url"), p, vectors)
    q = spark.createDataFrame(queries, "query_id int, text string")
    qv = q.select("query_id", embedded(spark, F.col("text"))[0].alias("query_vec"))
    got = {(r["query_id"], r["rank"]): r for r in S.search(q, x, vectors=qv, weights=weights).collect()}
    want = plain_search(pages, queries, weights)
    assert set(got) == set(want) and len(want) > 100 and {k for k, _ in want} == {1, 2, 3, 4}
    for k, (i, bm, cos) in want.items():
        assert got[k]["doc_id"] == i and got[k]["bm25"] == pytest.approx(bm) and got[k]["cos"] == pytest.approx(cos), k

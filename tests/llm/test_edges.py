"""Every operator on nulls in any column, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest

from corpusloom.llm import cover_join, decontam, langid, mixing, near_dup, ngram_lm, pii, templates, token_count, url_filter

LONG = "many words of a very long text with mail a.b@example.org in it " * 20_000
# names that the operators use themselves
EXTRA = "h int, n string, keys int, node int, slot int, host string, v int, cell int, class int, t string, p string, rank int, `a.b` int"
CLASH = (1, "x", 2, 3, 4, "y", 5, 6, 7, "z", "q", 8, 9)
DOCS = [
    (1, "a plain text of some words that is kept", "en", "web"),
    (1, "a plain text of some words that is kept", "en", "web"),
    (2, "a plain text of some words that is kept", "en", None),
    (3, None, "en", "web"),
    (4, "", "fr", "web"),
    (5, LONG, None, "books"),
    (None, "le chat est sur la table avec les autres", "fr", None),
    (None, None, None, None),
    (6, "   \n\t ", "de", "web"),
    (7, "12 -- 34", "de", "web"),
]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *CLASH) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


def bench(spark, rows=((1, "some words that is kept"), (2, None), (3, ""), (None, "le chat est sur la table"), (4, "?!"))):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id bigint, text string, h int")


@pytest.mark.parametrize("empty", [False, True])
def test_language_id(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    model = langid.train(d)
    got = langid.identify(d, model).collect()
    assert len(got) == (0 if empty else len(DOCS))
    assert all(r["pred_lang"] == "und" and r["score"] is None for r in got if r["doc_id"] in (3, 4, 6, 7))
    kept = langid.accepted(d, model)
    assert kept.columns == d.columns
    assert not {3, 4, 6, 7} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = mixing.mixed(d, block_tokens=1000).where("epoch = 0").collect()
    assert {r["doc_id"] for r in got} == (set() if empty else {1, 2, 5, 7, None})
    if not empty:
        whole = sorted((r["token_from"], r["text"]) for r in got if r["doc_id"] == 5)
        assert "".join(t for _, t in whole) == LONG and len(whole) > 100
        assert sum(r["doc_id"] == 1 for r in got) >= 2


@pytest.mark.parametrize("empty", [False, True])
def test_pii(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = pii.pseudonymized(d)
    assert got.columns == d.columns and got.dtypes == d.dtypes
    rows = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert got.count() == (0 if empty else len(DOCS))
    if not empty:
        long = rows[5, "books"]["text"]
        assert len(long) == len(LONG) == rows[5, "books"]["n_chars"] and "a.b@example.org" not in long
        assert rows[3, "web"]["text"] is None and rows[4, "web"]["text"] == ""
    assert {r["doc_id"] for r in pii.found_values(d).collect()} == (set() if empty else {5})


@pytest.mark.parametrize("empty", [False, True])
def test_token_counts(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = [(r["doc_id"], r["n_tokens"]) for r in token_count.counted(d).collect()]
    assert len(got) == (0 if empty else len(DOCS))
    if not empty:
        assert (3, None) in got and (4, 0) in got and dict(got)[5] > 200_000


@pytest.mark.parametrize("empty", [False, True])
def test_decontamination(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(d, bench(spark)).collect()), key=str)
    assert got == ([] if empty else [(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, None, 0)])
    kept = decontam.clean(d, bench(spark))
    assert kept.columns == d.columns and kept.count() == (0 if empty else len(DOCS) - 4)
    assert decontam.clean(d, bench(spark, [])).count() == d.count()


@pytest.mark.parametrize("empty", [False, True])
def test_near_duplicates(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = near_dup.near_duplicates(d).collect()
    assert len(got) == (0 if empty else len(DOCS))
    kept = near_dup.deduplicated(d)
    assert kept.columns == d.columns
    # the row repeated under 1, and 2 with the same text, leave one; rows without text all stay
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == ([] if empty else [1, 3, 4, 5, 6, 7, None, None])


@pytest.mark.parametrize("empty", [False, True])
def test_language_model(spark, empty):
    d = docs(spark, [] if empty else DOCS)
    got = ngram_lm.scored(d, ngram_lm.build(d, 4)).collect()
    assert len(got) == (0 if empty else len(DOCS))
    for r in got:
        if r["doc_id"] == 3:
            assert r["logprob"] is None
        if r["doc_id"] == 4:
            assert r["n_bytes"] == 0 and r["bits_per_byte"] is None and r["logprob"] < 0
        if r["doc_id"] == 5:
            assert 0 < r["bits_per_byte"] < 2


@pytest.mark.parametrize("empty", [False, True])
def test_url_filter(spark, empty):
    rows = [] if empty else [(1, "https://a.example.com/x"), (1, "https://a.example.com/x"), (2, None), (3, ""), (None, "https://b.org/" + "x/" * 50_000), (4, "no url")]
    pages = spark.createDataFrame([(*r, "", *CLASH) for r in rows], f"page_id bigint, url string, html string, {EXTRA}")
    rules = spark.createDataFrame([("example.com", "block"), ("example.com", "block"), (None, "allow"), ("x.org", None), ("", "block"), ("b.org/x", "allow")], "entry string, action string")
    want = [] if empty else [(1, "block"), (1, "block"), (2, "invalid"), (3, "invalid"), (4, "invalid"), (None, "allow")]
    for got in (url_filter.decisions(pages, rules), url_filter.decisions(pages.where("page_id is not null"), rules, limit=0)):
        assert sorted(((r["page_id"], r["action"]) for r in got.collect()), key=str) in (want, [w for w in want if w[0] is not None])
    assert {r["action"] for r in url_filter.decisions(pages, rules.limit(0)).collect()} <= {"default", "invalid"}


@pytest.mark.parametrize("empty", [False, True])
def test_templates(spark, empty):
    page = "<html><body><h1>Title {}</h1><p>text {}</p></body></html>"
    rows = [] if empty else [(i, "https://a.org/" + str(i), page.format("x" * i, "y" * i)) for i in range(1, 6)] + [(5, "https://a.org/5", page.format("xxxxx", "yyyyy")), (6, None, "<p>alone</p>"), (7, "https://a.org/7", None), (8, "https://a.org/8", ""), (None, "https://b.org", "<p>few</p>"), (9, "https://a.org/9", page.format("z", "<b>w" * 30_000))]
    pages = spark.createDataFrame([(*r, *CLASH) for r in rows], "page_id bigint, url string, html string, h int, n string, keys int, node int, slot int, host string, v int, cell int, class int, t string, p string, rank int, `a.b` int")
    got = {r["page_id"]: r for r in templates.extracted(pages).collect()}
    assert len(got) == (0 if empty else 10)
    if not empty:
        assert [s["text"] for s in got[2]["slots"]][:1] in (["Title xx"], ["xx"]) and got[2]["n_template"] > 4
        assert got[6]["text"] == "alone" and got[6]["host"] is None and got[None]["text"] == "few"
        assert got[7]["text"] is None and got[8]["text"] == ""
        assert got[9]["text"].count("w") == 30_000


@pytest.mark.parametrize("empty", [False, True])
def test_embedding_pairs(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [] if empty else [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.01])]
    e = spark.createDataFrame([(*r, *CLASH) for r in rows], f"vec_id bigint, embedding array<float>, {EXTRA}")
    got = sorted((r["vec_a"], r["vec_b"]) for r in cover_join.pairs(e).collect())
    assert got == ([] if empty else [(1, 2), (11, 12)])  # 9 has the vector of 1
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in cover_join.linked(e).collect()}
    alone = {i: (i, 0) for i in (3, 4, 5, 6, 7, 8, 10)}
    assert got == ({} if empty else alone | {1: (1, 2), 2: (1, 2), 9: (1, 2), 11: (11, 1), 12: (11, 1)})


def test_large_and_small_finite_vectors_are_linked(spark):
    for kind, big, small in (("float", 3e38, 1e-45), ("double", 1e300, 1e-300)):
        rows = [(1, [big, 0.0]), (2, [big / 2, 0.0]), (3, [0.0, small]), (4, [0.0, 1.0]), (5, [1e18, 2e18]), (6, [1e-19, 2e-19]), (7, [-1e18, 1.0])]
        e = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
        got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in cover_join.linked(e).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 1), 6: (5, 1), 7: (7, 0)}, kind

"""The pipeline against a version in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import decontam, langid, near_dup, pii
from corpusloom.llm.common import utf8

from .test_results import edits, weighted_jaccard

LEXICON = {
    "en": "the of and river stone cloud forest winter letter window garden with from under house green morning people water light",
    "fr": "le la des une avec dans pour maison jardin fenêtre rivière pierre forêt hiver lettre été soleil matin chemin rouge vert",
    "de": "der die und nicht eine mit den haus garten fenster fluss stein wald winter brief größe straße morgen weg grün",
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(20)
    prose = lambda lang, n: " ".join(rng.choice(LEXICON[lang].split()) + str(rng.choice(["", "", rng.choice("xyzw")])) for _ in range(n))
    items = [(i, prose("en", 12)) for i in range(6)] + [(90, None), (91, "")]
    docs = []
    for i in range(90):
        lang = rng.choice(list(LEXICON))
        docs.append((lang, prose(lang, rng.randint(30, 90))))
    docs += [(lang, t) for lang, t in docs[:6]]  # exact copies
    docs += [(lang, t.replace(" ", " changed ", 1)) for lang, t in docs[6:14]]  # near copies
    for i in range(5):
        x = items[i][1]
        docs.append(("en", f"{prose('en', 40)} {x[:20] + 'q' + x[21:]} {prose('en', 40)}"))  # leaks, one letter changed
    docs += [("en", prose("en", 40) + f" call +1 (555) 010-{1000 + i} or write to person{i}@mail.example.org") for i in range(4)]
    # of no trained language, under no label or a wrong one that has too few texts to be learnt
    strange = ["właśnie dzisiaj przyszedł list z krakowa który zawierał wszystkie potrzebne wiadomości dotyczące naszej wspólnej podróży w góry", "сегодня утром мы получили письмо из москвы о нашей поездке в горы зимой", "xq zvkw qjj wxzq kkvj zqx vwq jxk qzz wvk xjq kqz vxw zjq wqk"]
    docs += [(None, t * 3) for t in strange]
    docs += [("en", "1234 ---- 5678"), ("fr", ""), (None, None), (None, "!!")]
    rows = [(i, t, lang, rng.choice(["web", "web", "books"]), None if t is None else len(t)) for i, (lang, t) in enumerate(docs)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def expected(rows, items):
    """doc_id -> text after every stage but the mixture."""
    usable = [r for r in rows if r[1] and r[1].strip() and r[2]]
    model = langid.fit([r[1] for r in usable], [r[2] for r in usable])
    raw = utf8(pa.array([r[1] or "" for r in rows]))
    scores = model.scores(*raw).max(1)
    stay = [r for r, s, bad in zip(rows, scores, model.rejected(*raw, scores)) if np.isfinite(s) and not bad]
    texts = [near(r[1]) for r in stay]
    sim = weighted_jaccard(None, texts)
    parent = list(range(len(stay)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), v in sim.items():
        assert abs(v - near_dup.THRESHOLD) > 0.05  # the fixture has no pair near the threshold
        if v >= near_dup.THRESHOLD:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    stay = [r for i, r in enumerate(stay) if root(i) == i]
    wanted = [decontam.normal(t) for _, t in items if t]
    held = lambda t: any(edits(w, decontam.normal(t)) <= decontam.budget_of(w) for w in wanted)
    return {r[0]: (pii.rewrite(r[1])[0], r[3]) for r in stay if not held(r[1])}


def near(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def test_pipeline(spark, made):
    sf_dir, rows, items = made
    want = expected(rows, items)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    pieces, size = defaultdict(list), Counter()
    for r in got:
        size[r["slot"]] += r["token_to"] - r["token_from"]
        if r["epoch"] == 0:
            pieces[r["doc_id"], r["source"]].append((r["token_from"], r["text"]))
    assert {k[0]: ("".join(t for _, t in sorted(p)), k[1]) for k, p in pieces.items()} == want
    assert not any(w in t for t, _ in want.values() for w in ("krakowa", "москвы", "zvkw"))
    assert 80 < len(want) < len(rows) - 15 and not any("mail.example.org" in t and f"person{i}@" in t for t, _ in want.values() for i in range(4))
    assert len({r["slot"] for r in got}) == len(size) and max(size.values()) <= 4096 and math.isfinite(sum(size.values()))


def test_stages_take_and_give_documents(spark, made):
    from corpusloom.runtime import stored, table

    sf_dir, _, _ = made
    docs = table(spark, sf_dir, "documents")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf_dir)
        assert new.columns == docs.columns
        docs = stored(new, f"test-{name}")
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4]


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    from .test_edges import CLASH, EXTRA

    rng = random.Random(21)
    prose = lambda lang, n: " ".join(rng.choice(LEXICON[lang].split()) for _ in range(n))
    rows = [(i, prose(lang, 60), lang, "web") for i in range(60) for lang in [rng.choice(list(LEXICON))]]
    long = prose("en", 200_000) + " a.b@example.org"
    rows += [rows[0], rows[0], (1, rows[0][1], "en", None), (None, rows[1][1], None, None), (None, prose("fr", 50), None, "web"), (70, long, "en", "books"), (71, None, "en", "web"), (72, "", None, None), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *CLASH) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[2][1][20:120], 5), (None, None, 6), (2, "and", 7)], "item_id bigint, text string, h int").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).where("epoch = 0").collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["source"]].append((r["token_from"], r["text"]))
    whole = {k: "".join(t for _, t in sorted(p)) for k, p in pieces.items()}
    assert len(whole[70, "books"]) == len(long) and "a.b@example.org" not in whole[70, "books"]
    assert (2, "web") not in whole and whole[0, "web"] == rows[0][1] and (None, None) not in whole
    assert (None, "web") in whole and len(whole) >= 58

"""Operators against brute force, exact round trips, other tokenizers and held-out accuracy."""

import base64
import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, cover_join, decontam, entries, langid, mixing, near_dup, ngram_lm, pii, templates, token_count, url_filter
from corpusloom.llm.common import packed, unpacked, utf8
from corpusloom import runtime
from corpusloom.runtime import table

WORDS = "alpha beta gamma delta omega river stone cloud forest winter summer engine letter window garden silver copper market harbor signal".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))


# ---------------------------------------------------------------- 1
def test_url_precedence(spark):
    rules = [("example.com", "block"), ("www.example.com/a", "allow"), ("www.example.com/a/b", "block"), ("org", "block"), ("good.org", "allow"), ("both.net", "allow"), ("both.net", "block"), ("10.0.0.1", "block")]
    want = {
        "https://example.com/": "block", "https://www.example.com/a/c": "allow", "http://www.example.com:80/a//b/c?q#f": "block", "https://www.example.com/ab": "block",
        "https://x.org": "block", "https://GOOD.org./x": "allow", "https://notgood.org": "block", "//both.net/x": "block", "http://u:p@10.0.0.1/": "block", "http://1.10.0.0/": "default", "mailto:x@y": "invalid",
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    r = spark.createDataFrame(rules, "entry string, action string")
    for limit in (1 << 20, 0):  # by trie and by join
        got = {x["url"]: (x["action"], x["entry"], x["depth"]) for x in url_filter.decisions(pages, r, limit).collect()}
        assert {u: g[0] for u, g in got.items()} == want
    # brute force: the longest entry whose tokens begin the URL's
    for url, action in want.items():
        t = url_filter.tokens(url)
        hits = [(len(e), a) for e, a in ((url_filter.entry_tokens(e), a) for e, a in rules) if t and t[: len(e)] == e]
        assert action == (max(hits)[1] if hits else "invalid" if t is None else "default")


# ---------------------------------------------------------------- 2
def site(rng, n, host):
    rows = []
    for i in range(n):
        items = "".join(f'<li><a href="/{rng.choice(WORDS)}">{prose(rng, 1)}</a></li>' for _ in range(rng.randint(1, 5)))
        body = "".join(f"<p>{prose(rng, rng.randint(3, 30))}</p>" for _ in range(rng.randint(1, 6)))
        rows.append((len(rows), f"https://{host}/{i}", f'<html><body><nav><ul>{items}</ul></nav><h1>{prose(rng, 3)} {i}</h1><div class="main">{body}</div><footer>&copy; Acme Corp all rights</footer></body></html>', body, items))
    return rows


def test_template_slots(spark):
    rng = random.Random(1)
    rows = site(rng, 40, "a.org")
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(3)
    strip = lambda h: [x for x in __import__("re").sub("<[^>]*>", "\n", h).split("\n") if x]
    got = {r["page_id"]: r for r in templates.extracted(pages).collect()}
    for i, _, _, body, items in rows:
        texts = [s["text"] for s in got[i]["slots"]]
        assert texts == [*strip(items), texts[len(strip(items))], *strip(body)]
        assert "Acme" not in got[i]["text"] and str(i) in texts[len(strip(items))]
    # the same, whatever the partitions, and where the template is joined instead of broadcast
    again = {r["page_id"]: r["text"] for r in templates.extracted(pages.coalesce(1)).collect()}
    assert again == {i: r["text"] for i, r in got.items()}
    before, templates.BROADCAST_LIMIT = templates.BROADCAST_LIMIT, 0
    try:
        joined = {r["page_id"]: r["text"] for r in templates.extracted(pages).collect()}
    finally:
        templates.BROADCAST_LIMIT = before
    assert joined == again


def test_classes_against_brute_force(spark):
    rng = random.Random(2)
    rows = [r[:3] for r in site(rng, 12, "b.org")]
    vectors = defaultdict(dict)
    for i, _, h in rows:
        for path, bag in templates.bags(h).items():
            for token, n in Counter(bag).items():
                vectors[path, token][i] = n
    frequent = {k: tuple(sorted(v.items())) for k, v in vectors.items() if len(v) >= max(3, math.ceil(0.6 * 12))}
    by_vector = defaultdict(set)
    for k, v in frequent.items():
        by_vector[v].add(k)
    classes = {frozenset(c) for c in by_vector.values() if len(c) >= 2}
    found = defaultdict(set)
    for r in templates.deduced(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect():
        found[r["class"]].add((r["path"], r["token"]))
    assert found and all(any(c <= k for k in classes) for c in found.values())
    tags = {t for c in found.values() for _, t in c}
    assert {"<html", "</html", "<h1", "</h1", "<li", "</li", "<p", "</p", "Acme"} <= tags


def test_candidates_do_not_depend_on_the_partitions(spark, monkeypatch):
    pages = templates._keyed(table(spark, "/root/testdata/sf0.01", "pages")).where("host is not null and length(html) > 0")
    n = pages.groupBy("host").count().selectExpr("host", "greatest(3, ceil(count * 0.6)) as least").where("least <= 1000")
    monkeypatch.setattr(templates, "FAN", 30)  # so that counts are added up in more than one step
    found = [{(r["host"], b) for r in templates._frequent(pages.repartition(k), n).collect() for b in r["t"]} for k in (1, 200)]
    assert found[0] == found[1] and found[0]
    rows = {(r["host"], r["path"], r["token"]) for r in templates.deduced(pages.drop("host", "__page")).collect()}
    spread = {(r["host"], r["path"], r["token"]) for r in templates.deduced(pages.drop("host", "__page").repartition(200)).collect()}
    assert rows == spread and len(found[0]) < 3 * max(len(rows), 1000)


def test_words_of_a_long_gap_have_ranks_of_their_own(spark):
    boiler = " ".join(f"w{i}" for i in range(2500))
    pages = spark.createDataFrame([(i, f"https://c.org/{i}", f"<html><body><p>{boiler}</p><b>own{i} text</b></body></html>") for i in range(6)], "page_id bigint, url string, html string")
    rows = [r for r in templates.deduced(pages).collect() if r["token"].startswith("w")]
    assert len(rows) == 2500 and len({(r["class"], r["rank"]) for r in rows}) == 2500
    order = sorted(rows, key=lambda r: r["rank"])
    assert [r["token"] for r in order] == boiler.split()
    assert {r["text"] for r in templates.extracted(pages).collect()} == {f"own{i}" for i in range(6)}  # "text" is on every page


def test_tally_looks_at_each_bucket_once(monkeypatch):
    rng, looked, real = random.Random(15), [], templates.bucket
    monkeypatch.setattr(templates, "bucket", lambda path, token: looked.append((path, token)) or real(path, token))
    tally, want = templates.Tally(), Counter()
    wanted = set(range(0, templates.BUCKETS, 2))
    for page in range(40):
        bags = {p: [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))] for p in ("x", "y/z")}
        tally.add("h", page, bags, wanted)
        for p, bag in bags.items():
            want.update((p, t) for t in set(bag) if real(p, t) in wanted)
    assert {(p, t): n for _, p, t, n, _, _ in tally.rows()} == want
    assert len(looked) == len(set(looked)) == tally.met


def test_words_are_hashed_in_blocks(monkeypatch):
    """The buckets and bags of whole pages are those of their single tokens, but only tags and very long words are hashed singly."""
    rng, looked, real = random.Random(16), [], templates.bucket
    blanks = [" ", "\n", "  \t", "\u3000", "\x85", "\x1c", "\xa0", "<b>", "</b>", "<br>", "<p class=x>", "</p>", "<!-- c -->"]
    word = lambda: "".join(rng.choice("abcäß€😀\ud800&<3") for _ in range(rng.randint(1, 8)))
    pages = ["".join(word() + rng.choice(blanks) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    big = templates.BLOCK
    pages += ["", " ", "x", " ".join(f"w{i}" for i in range(big // 2)), "<p>" + "y" * (5 * big) + " a b\u3000", "a" * (2 * big) + " " + "b" * (3 * big) + "\n" + "b" * (big - 1) + " c"]
    pages += ["z" * templates.LONG + t + "<i>" for t in ("", "1", " 1")] + ["t " * (big // 2 + d) + "u" for d in (-1, 0, 1)]
    bags = [templates.bags(p) for p in pages]
    want = [{real(path, t) for path, bag in b.items() for t in bag} for b in bags]
    monkeypatch.setattr(templates, "bucket", lambda path, token: looked.append(token) or real(path, token))
    assert [(i, set(x.tolist())) for i, x in templates.Buckets()(enumerate(pages))] == list(enumerate(want))
    assert all(t[0] == "<" or len(t) > templates.LONG for t in looked)
    masks = [templates.Mask(sorted(rng.sample(range(templates.BUCKETS), rng.choice((0, 50, 9000))))) for _ in pages]
    found = list(templates.picked(((m, i), p) for i, (m, p) in enumerate(zip(masks, pages))))
    assert [i for i, _ in found] == list(range(len(pages)))
    for (_, got), bag, m in zip(found, bags, masks):
        only = lambda b: {path: c for path, x in b.items() if (c := Counter(t for t in x if real(path, t) in m))}  # noqa: B023, E731
        assert only(got) == only(bag) and all(real(path, t) in m or t[0] == "<" for path, x in got.items() for t in x)


# ---------------------------------------------------------------- 3
def test_kernel_of_a_model_is_the_nystroem_solution():
    rng = random.Random(3)
    make = {"en": "the and of that with from this", "fr": "le la les une avec dans pour", "de": "der die und nicht eine mit den"}
    texts, langs = zip(*[(" ".join(rng.choice(v.split()) for _ in range(8)), k) for k, v in make.items() for _ in range(20)])
    model = langid.fit(list(texts), list(langs))

    def kernel(a, b):
        g = [set(np.concatenate([c + i * 10**7 for i, (c, _) in enumerate(langid.grams(*langid.symbols(*utf8(pa.array([t])))))])) for t in (a, b)]
        return len(g[0] & g[1]) / math.sqrt(len(g[0]) * len(g[1]))

    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    t, y = [texts[i] for i in order], np.array([langs[i] for i in order])
    k = np.array([[kernel(a, b) for b in t] for a in t])  # all of them are landmarks
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-6 * value.max()
    z = k @ (vector[:, keep] / np.sqrt(value[keep]))
    target = np.where(y[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    zc = z - z.mean(0)
    w = np.linalg.solve(zc.T @ zc + langid.RIDGE * np.eye(z.shape[1]), zc.T @ (target - target.mean(0)))
    assert np.allclose(zc @ w + target.mean(0), model.scores(*utf8(pa.array(t))), atol=2e-3)


def test_language_accuracy_held_out(spark, small):
    d = table(spark, small, "documents").where("lang is not null and length(text) > 40").orderBy("doc_id").collect()
    train, test = d[::2], d[1::2]
    model = langid.fit([r["text"] for r in train], [r["lang"] for r in train])
    y = model.scores(*utf8(pa.array([r["text"] for r in test])))
    assert np.mean([model.languages[i] == r["lang"] for i, r in zip(y.argmax(1), test)]) > 0.95


@pytest.mark.parametrize("unseen", ["de", "en", "es", "fr"])
def test_texts_of_no_trained_language_are_rejected(spark, unseen):
    rng = random.Random(33)
    d = table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null and length(text) > 400").orderBy("doc_id").collect()
    train, clean = [[r for r in d if r["lang"] != unseen][i::2] for i in (0, 1)]
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 90))) for _ in range(100)]
    other = [r["text"] for r in d if r["lang"] == unseen]
    model = langid.fit([r["text"] for r in train], [r["lang"] for r in train])
    texts = [("clean", r["text"]) for r in clean] + [("letters", t) for t in letters] + [("other", t) for t in other]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in langid.identify(docs, model).collect():
        got[texts[r["doc_id"]][0]].append(r["pred_lang"] == langid.UNKNOWN)
    assert np.mean(got["letters"]) == 1 and np.mean(got["other"]) > 0.95 and np.mean(got["clean"]) < 0.01
    kept = {r["doc_id"] for r in langid.accepted(docs, model).select("doc_id").collect()}
    assert sum(texts[i][0] != "clean" for i in kept) < 0.05 * len(other) + 1


def test_copies_crowd_out_no_language(spark):
    many = [(f"bonjour le chat est sur la table {w}", "fr") for w in WORDS[:5]] * 4000 + [(f"the cat of the house {a} {b}", "en") for a in WORDS for b in WORDS]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(many)], "doc_id bigint, text string, lang string")
    # 200,000 rows of five texts
    docs = docs.unionByName(docs.where("lang = 'fr'").crossJoin(spark.range(9)).drop("id"))
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    top = model.scores(*utf8(pa.array(["le chat est sur la table", "the cat of the house"]))).argmax(1)
    assert [model.languages[i] for i in top] == ["fr", "en"]


def test_tied_languages_take_the_first_name_and_long_texts_train(spark):
    rows = [("same words in either", g) for g in ("b", "a")] + [("a" * 5 + " different text " * 20_000, "a")]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = langid.train(docs.where("doc_id < 2"))
    assert {r["pred_lang"] for r in langid.identify(docs.where("doc_id < 2"), model).collect()} <= {"a", langid.UNKNOWN}
    assert langid.train(docs).languages == ["a", "b"]


# ---------------------------------------------------------------- 4
@pytest.mark.parametrize("totals", [{"a": 10**9, "b": 10}, {"a": 5 * 10**8, "b": 10**6, "c": 100}, {"a": 10**14, "b": 1}, {None: 1, "x": 1}])
def test_tiny_sources_make_no_other_repeat(totals):
    names, blocks, points, slots, reached = mixing.plan(totals)
    assert set(names) == set(totals) and slots + sum(blocks) - sum(reached) <= 1.05 * sum(blocks) + len(names)
    assert all(0 <= r <= b for r, b in zip(reached, blocks)) and sorted(set(points)) == points


def test_counts_of_points_against_a_loop():
    points = [i * mixing.STEP % (1 << mixing.POINT_BITS) for i in range(5000)]
    for n in (0, 1, 17, 5000):
        for upto in (0, 1, 10**6, 1 << 30, 1 << mixing.POINT_BITS):
            assert mixing._held(n, upto) == sum(p < upto for p in points[:n])


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 1e-10}, {"a": 1e-10, "b": 1.0}])
def test_every_block_is_placed_whatever_the_weights(spark, weights):
    rng = random.Random(44)
    rows = [(i, prose(rng, 50), "a") for i in range(100)] + [(100 + i, prose(rng, 5), "b") for i in range(20)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights, block_tokens=40).collect()
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(120))
    slots = {r["slot"]: (r["source"], r["epoch"], r["block"]) for r in got}
    assert sorted(slots) == list(range(len(slots))) and len(set(slots.values())) == len(slots)
    assert len(slots) <= (mixing.REPEAT + 1) * 128


def test_a_source_for_each_document(spark):
    rows = [(i, "some words", f"s{i:03d}") for i in range(300)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block_tokens=2).collect()
    assert {r["doc_id"] for r in got} == set(range(300)) and len({r["slot"] for r in got}) == len(got)


def test_schedule_is_even_and_covers(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 400)), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed(docs, block_tokens=500).collect()
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    names, blocks, points, slots, reached = mixing.plan(total, block_tokens=500)
    # every document's pieces of epoch 0 are its text
    pieces = defaultdict(list)
    for r in got:
        if r["epoch"] == 0:
            pieces[r["doc_id"]].append((r["token_from"], r["text"]))
    assert {i: "".join(t for _, t in sorted(p)) for i, p in pieces.items()} == {i: t for i, t, _ in rows}
    # blocks are equal, and every stretch of the schedule has its weights
    size = Counter()
    for r in got:
        size[r["slot"]] += r["token_to"] - r["token_from"]
    assert sum(n == 500 for n in size.values()) >= len(size) - 3 * (1 + max(r["epoch"] for r in got))
    s = mixing.schedule(spark, points, slots).orderBy("slot").collect()
    edges = [*points, 1 << mixing.POINT_BITS]
    for src in range(len(names)):
        weight = (edges[src + 1] - edges[src]) / edges[-1]
        held = np.cumsum([r["src"] == src for r in s])
        assert np.abs(held - weight * np.arange(1, len(s) + 1)).max() < 4
        assert [r["rank"] for r in s if r["src"] == src] == list(range(int(held[-1])))
        assert reached[src] == min(blocks[src], int(held[-1]))
    for r in s[:50]:
        point = r["slot"] * mixing.STEP % (1 << mixing.POINT_BITS)
        assert edges[r["src"]] <= point < edges[r["src"] + 1]


# ---------------------------------------------------------------- 5
@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096])
def test_feistel_permutes(size):
    f = pii.Feistel(b"key", "t", size)
    out = [f.encrypt(x) for x in range(size)]
    assert sorted(out) == list(range(size)) and [f.decrypt(y) for y in out] == list(range(size))
    assert size == 1 or all(x != y for x, y in enumerate(out))


VALUES = {
    "email": "jane.doe@mail.example.org", "card": "4111 1111 1111 1111", "ipv4": "192.168.17.4", "phone": "+1 (555) 123-4567", "ssn": "123-45-6789",
    "iban": "DE89 3704 0044 0532 0130 00", "date": "1984-02-29", "ipv6": "2001:db8:85a3::8a2e:370:7334", "token": "sk-Abcdef0123456789Abcd", "secret": "0123456789abcdef" * 9,
}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_the_format(kind):
    value = VALUES[kind]
    text = f"one {value} two {value}, end"
    new, found = pii.rewrite(text)
    assert found == {kind: 2} and value not in new and pii.rewrite(new, back=True)[0] == text
    a, b = new.removeprefix("one ").removesuffix(", end").split(" two ")
    assert a == b and (kind in ("ipv4", "ipv6", "secret") or [c.isdigit() for c in a] == [c.isdigit() for c in value])
    assert pii.rewrite(f"other {a}")[1] == {kind: 1}  # what comes out passes the same validation
    assert pii.rewrite(text, b"another key")[0] != new


@pytest.mark.parametrize("value", ["12/31/84", "31/12/84", "31 December 1984", "Dec 30, 1984", "3 Jun 1999", "_john.doe@example.org", "...john@example.org", "jürgen.müller@exämple.org", "a" * 90 + "@" + "b" * 250 + ".org", "ghp_" + "a1B2" * 40, "F0" * 300])
def test_further_formats_round_trip(value):
    text = f"x {value} y"
    new, found = pii.rewrite(text)
    assert sum(found.values()) == 1 and new != text and len(new.split()) == len(text.split())
    back = pii.rewrite(new, back=True)[0]
    assert back == text or " May " in new or "May " in new


def made_values(rng):
    """(value, whether it is valid), told without the operator's own checks."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    card = digits(16)
    while len(set(card)) == 1:
        card = digits(16)
    a, b, c, d = (rng.randint(0, 300) for _ in range(4))
    y, m, day = rng.randint(1900, 2099), rng.randint(0, 14), rng.randint(0, 33)

    def is_day():
        import datetime

        try:
            datetime.date(y, m, day)
        except ValueError:
            return False
        return True

    area, group, serial = rng.choice([0, 1, 123, 665, 666, 667, 899, 900, 999]), rng.choice([0, 1, 55]), rng.choice([0, 1, 7777])
    groups = [format(rng.randrange(1 << 16), "x") for _ in range(rng.choice([7, 8, 9]))]
    mail = "".join(rng.choice("abcxyz019") for _ in range(rng.randint(1, 9)))
    yield " ".join(card[i : i + 4] for i in range(0, 16, 4)), luhn(card)
    yield f"{a}.{b}.{c}.{d}", max(a, b, c, d) < 256
    yield f"{y}-{m:02d}-{day:02d}", is_day()
    yield f"{area:03d}-{group:02d}-{serial:04d}", area not in (0, 666) and area < 900 and group > 0 and serial > 0
    yield ":".join(groups), len(groups) == 8
    yield f"{mail}@mail.example.org", True
    yield f"{mail}@mail", False
    yield f"+1 ({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", True
    yield "deadbeef" * 4, True
    yield "deadbeef" * 3, False
    yield "sk-" + digits(20), True
    yield "sk-" + digits(9), False
    yield digits(7), False


def test_what_is_found_against_an_independent_list():
    rng = random.Random(55)
    values, invalid = [], 0
    for _ in range(60):
        values += made_values(rng)
    rng.shuffle(values)
    for i in range(0, len(values), 7):
        part = values[i : i + 7]
        text = "\n".join(f"{rng.choice(WORDS)}, {v}; {rng.choice(WORDS)}" for v, _ in part)
        lines = pii.rewrite(text)[0].split("\n")
        assert len(lines) == len(part)
        for line, old, (v, ok) in zip(lines, text.split("\n"), part):
            assert (v not in line) == ok, (v, line)
            assert line.partition(",")[0] == old.partition(",")[0] and line.rpartition(";")[2] == old.rpartition(";")[2]
            invalid += not ok
    assert 100 < invalid < len(values) - 100


def test_neighbouring_values_are_told_apart():
    phone, ip, card, day = "+1 (843) 555-7672", "170.106.47.218", "4111 1111 1111 1111", "1984-02-29"
    alone = {v: pii.rewrite(v)[0] for v in (phone, ip, card, day)}
    for a, b in itertools.permutations(alone, 2):
        assert pii.rewrite(f"{a} {b}")[0] == f"{alone[a]} {alone[b]}", (a, b)


def test_invalid_values_stay():
    for text in ("4111 1111 1111 1112", "300.1.2.3", "000-12-3456", "1999-02-30", "DE88 3704 0044 0532 0130 00", "version 1.2.3", "3.14159", "no numbers"):
        assert pii.rewrite(text) == (text, {})


# ---------------------------------------------------------------- 6
def test_token_counts_are_those_of_the_encoder(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_count.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    bits = ["'s", "'ll", "'re", "'", "  ", "\n", "\t", " a", "the", "é", "漢", "12", "9", "!!", " ", "xyz", "ing", "'v", "e", "l", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([3, 50, 3000]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r["doc_id"], r["text"]) for r in table(spark, small, "documents").limit(40).collect()]
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.counted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in rows}


def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=token_count.load_ranks(token_count.TOKENIZER), special_tokens={})


def counted(t, texts, **how):
    chars = np.array([ord(c) for x in texts for c in x], np.uint32)
    return t.counts(chars, np.concatenate([[0], np.cumsum([len(x) for x in texts])]), **how).tolist()


def test_many_characters_take_little_memory():
    enc = encoder()
    rng = random.Random(66)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 20_000)]
    rng.shuffle(wide)
    texts = ["".join(wide), " ".join(wide[:3000]), "a b c d e f g h " * 500, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50_000))]
    t = token_count.Transducer(token_count.load_ranks(token_count.TOKENIZER))
    assert counted(t, texts) == [len(enc.encode_ordinary(x)) for x in texts]
    assert t.table.nbytes + t.keys.nbytes + t.values.nbytes < 150 << 20 and len(t.states) <= token_count.STATES


@pytest.mark.parametrize("states", [400, 1 << 17])
def test_texts_without_blanks_are_scanned(monkeypatch, states):
    monkeypatch.setattr(token_count, "STATES", states)
    enc = encoder()
    rng = random.Random(67)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = ["a" * 5000, "ab" * 3000, letters(20_000, "abcdefghij"), letters(3000, "0123456789"), "x" * 700 + " " + "y" * 1400, letters(4000, "漢字仮名é"), "", " " * 900, "-" * 2100 + "=" * 1030, "w " * 30 + "z" * 3000]
    t = token_count.Transducer(token_count.load_ranks(token_count.TOKENIZER))
    for chunk in (token_count.CHUNK, 100):
        assert counted(t, texts, chunk=chunk) == [len(enc.encode_ordinary(x)) for x in texts]


def test_a_very_long_text_without_blanks():
    enc = encoder()
    rng = random.Random(68)
    part = "".join(rng.choice("etaoinshrdlu") for _ in range(10_000))
    t = token_count.Transducer(token_count.load_ranks(token_count.TOKENIZER))
    text = part * 200  # the encoder itself takes quadratic time
    few = [len(enc.encode_ordinary(part * n)) for n in (2, 3)]
    assert counted(t, [part * 2, part * 3, text]) == [*few, few[0] + 198 * (few[1] - few[0])]


def test_table_of_transitions_grows_in_place():
    t = token_count.Transducer({bytes([i]): i for i in range(256)})
    tracemalloc.start()
    t._forget([])
    for i in range(70_000):
        t._state(("run", i))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(t.table) >= 70_000 and peak < 160 << 20


# ---------------------------------------------------------------- 7
def edits(item: bytes, text: bytes) -> int:
    """The least edit distance of the item to any substring of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    for i, c in enumerate(item):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (t != c)]))
        at = np.arange(len(new))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_decontamination_against_edit_distance():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(2, 14))) for i in range(25)]
    texts = []
    for n in range(80):
        part = prose(rng, 20)
        if n % 2:
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["q", "", "z"])
            part = f"{part} {''.join(x)} {prose(rng, 5)}"
        texts.append(part)
    ix = decontam.index(items)
    got = {(d, ix.ids[n]): dist for d, n, dist in decontam.matches(ix, *utf8(pa.array(texts)))}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            p = decontam.normal(item)
            if len(p) - 2 >= decontam.LEAST and (e := edits(p, decontam.normal(t))) <= decontam.budget_of(p):
                want[d, i] = e
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] >= want[k] for k in got)


def test_items_match_whole_words_only():
    items = [(1, "no"), (2, "cat"), (3, "nothing of concatenation"), (4, "othing of concatenatio"), (5, "we know"), (6, "!?")]
    texts = ["We know nothing of concatenation here", "No cat", "", "nothing of concatenation"]
    found = lambda least, rate=0.0: {(d, ix.ids[n]) for ix in [decontam.index(items, rate, least)] for d, n, _ in decontam.matches(ix, *utf8(pa.array(texts)))}
    assert found(decontam.LEAST) == {(0, 3), (3, 3)}
    assert found(1) == {(0, 3), (3, 3), (0, 5), (1, 1), (1, 2)}
    assert found(decontam.LEAST, 0.1) == {(0, 3), (3, 3), (0, 4), (3, 4)}  # two letters of 22 bytes


# ---------------------------------------------------------------- 8
def weighted_jaccard(docs, texts):
    n = len(set(texts))
    feats = []
    df = Counter()
    for t in texts:
        w = t.split()
        feats.append(Counter(zip(w, w[1:])))
    for f in feats:
        df.update(f.keys())
    idf = {k: math.log1p(len(texts) / v) for k, v in df.items()}
    sim = {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        keys = feats[a].keys() | feats[b].keys()
        lo = sum(min(feats[a][k], feats[b][k]) * idf[k] for k in keys)
        hi = sum(max(feats[a][k], feats[b][k]) * idf[k] for k in keys)
        sim[a, b] = lo / hi
    return sim


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [w + str(rng.randint(0, 400)) for w in prose(rng, 60).split()]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = "changed" + str(rng.randint(0, 99))
            texts.append(" ".join(x))
    sim = weighted_jaccard(None, texts)
    got = {r["doc_id"]: r["rep_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sure = [k for k, v in sim.items() if v >= near_dup.THRESHOLD + 0.02]
    joined = [got[a] == got[b] for a, b in sure]
    assert len(sure) > 30 and np.mean(joined) >= 0.95
    # a group is linked by pairs over the threshold only
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), v in sim.items():
        if v >= near_dup.THRESHOLD - 0.02:
            parent[root(a)] = root(b)
    assert all(root(i) == root(r) for i, r in got.items())


def test_document_frequencies_are_exact(spark):
    rng = random.Random(88)
    texts = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(rng.randint(0, 900))) for _ in range(6000)]
    want = Counter()
    feats = [near_dup.features(*utf8(pa.array([t])))[1] for t in texts]
    for ids in feats:
        want.update(ids.tolist())
    named = spark.createDataFrame([(i.to_bytes(16, "big"), t) for i, t in enumerate(texts)], "node binary, text string")
    chunked = runtime.stored(near_dup.chunks(named), "test-chunks")
    for parts in (1024, 4096):
        rows = near_dup.signed(chunked, len(texts), parts, 2, 2).select("node", "df").collect()
        got = {int.from_bytes(r["node"], "big"): unpacked(np.frombuffer(r["df"], np.uint8), len(feats[int.from_bytes(r["node"], "big")]))[0] for r in rows}
        assert len(got) == len(texts) and len(want) > 2_000_000
        assert all(got[i].tolist() == [want[x] for x in ids.tolist()] for i, ids in enumerate(feats))


def test_packing_round_trip():
    for x in ([], [0, 1, 254], [255, 256, 2**32 - 1, 3]):
        data = np.frombuffer(packed(np.array(x, np.uint32)) + b"rest", np.uint8)
        got, used = unpacked(data, len(x))
        assert got.tolist() == x and data[used:].tobytes() == b"rest"


def test_copies_weigh_once_and_keep_their_edited_partners(spark):
    rng = random.Random(81)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(60))
    edited = [base + f" end{i} more{i}" for i in range(3)]
    rest = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(60)) for _ in range(50)]
    texts = [base] * 3000 + edited + rest
    rows = spark.createDataFrame([(i % 2900 if i < 3000 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = near_dup.near_duplicates(rows).collect()
    assert len(got) == len(texts)
    assert sum(r["keep"] for r in got) == 51 and {(r["rep_id"], r["group_size"]) for r in got if r["doc_id"] < 3003} == {(0, 3003)}
    wide = rows.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    assert sorted(r["doc_id"] for r in near_dup.deduplicated(wide).collect()) == [0, *range(3003, 3053)]


def test_similarity_does_not_fade_with_the_number_of_shingles(spark):
    # 20 texts share a passage and have the rest alone; the other texts hold ten million shingles more
    rng = np.random.default_rng(89)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**12, n).tolist())
    passage = own(85)
    texts = [f"{own(10)} {passage} {own(10)}" for _ in range(20)] + [own(4000) for _ in range(2500)]
    exact = 84 * math.log1p(len(texts) / 20), 40 * math.log1p(len(texts))
    assert exact[0] / sum(exact) < near_dup.THRESHOLD - 0.03
    docs = spark.createDataFrame(pa.table({"doc_id": range(len(texts)), "text": texts})).repartition(8)
    assert near_dup.near_duplicates(docs).where("group_size > 1").count() == 0


def test_signatures_collide_with_the_similarity():
    rng = np.random.default_rng(8)
    ids = np.arange(400, dtype=np.uint32) * np.uint32(7919)
    wa, wb = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    wb[:200] = wa[:200]
    w = np.log(np.concatenate([wa, wb])).astype(np.float32)
    sig = near_dup.signatures(np.array([0, 400]), np.concatenate([ids, ids]), w, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_large_buckets_are_joined_in_chunks(spark):
    rng = random.Random(9)
    base = prose(rng, 80)
    rows = [(i, base + " " + str(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["rep_id"] for r in near_dup.near_duplicates(d, chunk=7).collect()} == {0}
    assert [r["doc_id"] for r in near_dup.deduplicated(d, chunk=7).collect()] == [0]


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# ---------------------------------------------------------------- 9
def clusters(rng):
    x = np.concatenate([rng.normal(size=(1, 6)) + 0.1 * rng.normal(size=(40, 6)) for _ in range(8)] + [rng.normal(size=(80, 6))] + [rng.normal(size=(1, 6)) + 1e-4 * rng.normal(size=(90, 6))]).astype(np.float32)
    return np.concatenate([x, x[:5], x[:5], x[-60:]])


@pytest.mark.parametrize("threshold,cell", [(0.3, 32), (0.9, 32), (0.9, 8), (0.99, 64), (0.9999, 1000)])
def test_cover_trees_against_all_pairs(spark, threshold, cell):
    x = clusters(np.random.default_rng(9))
    y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = [(r["vec_a"], r["vec_b"]) for r in cover_join.pairs(df, threshold, cell).collect()]
    first = {v.tobytes(): i for i, v in reversed(list(enumerate(x)))}
    rep = [first[v.tobytes()] for v in x]
    assert len(got) == len(set(got)) and set(got) == {(rep[a], rep[b]) for a, b in zip(*np.nonzero(near)) if rep[a] < rep[b]}
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in cover_join.linked(df, threshold, cell).collect()}
    root = cover_join._roots(len(x), *np.nonzero(near))
    assert got == {i: (root[i], near[i].sum()) for i in range(len(x))}


def test_links_against_sql(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    x = clusters(np.random.default_rng(99))
    df = spark.createDataFrame([(i % 400, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").coalesce(1)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    want = duckdb.sql(entries.LINKS_SQL.replace("from embeddings", f"from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()
    got = entries.op9_embedding_pairs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 400 and max(r[2] for r in want) > 50


def test_cover_tree_invariants():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(300, 4)), 1 + 1e-9 * rng.normal(size=(5, 4))]).astype(np.float32)
    x = np.unique(x, axis=0)
    t = cover_join.CoverTree.build(x, np.arange(len(x)), np.ones(len(x), np.int64), np.zeros((len(x), 16), np.uint8))
    t = cover_join.CoverTree.from_bytes(t.to_bytes())

    def under(n):
        return [t.centre[n]] if not t.count[n] else [p for c in range(t.first[n], t.first[n] + t.count[n]) for p in under(c)]

    for n in range(len(t.centre)):
        below = under(n)
        assert len(below) == len(set(below))
        d = np.sqrt(np.maximum(2 - 2 * t.at[below].astype(float) @ t.at[t.centre[n]].astype(float), 0))
        assert d.max() <= t.radius[n] + 1e-3
        if t.count[n]:
            assert t.centre[n] in t.centre[t.first[n] : t.first[n] + t.count[n]]
    assert sorted(under(0)) == list(range(len(x)))


def test_flat_trees_are_compared_in_few_coordinates(monkeypatch):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(2000, 64)), rng.normal(size=(1500, 64))
    y[:300] = x[:300] + 0.33 * rng.normal(size=(300, 64))  # about the threshold
    x, y = x.astype(np.float32), y.astype(np.float32)
    basis = cover_join._basis(x[:200])
    tree = lambda z: cover_join.CoverTree.build(z, np.arange(len(z)), np.ones(len(z), np.int64), np.zeros((len(z), 16), np.uint8), basis)
    a, b, far, full = tree(x), tree(y), cover_join._far, []
    monkeypatch.setattr(cover_join, "_far", lambda u, v: full.append(len(u) * len(v)) or far(u, v))
    unit = lambda z: z.astype(float) / np.sqrt((z.astype(float) ** 2).sum(1))[:, None]
    near = unit(x) @ unit(y).T >= 0.95
    n, root = cover_join.links(a, b, 0.95)
    assert 50 < near.sum() < 300 and n.tolist() == [*near.sum(1), *near.sum(0)]
    assert root.tolist() == cover_join._roots(3500, *(np.nonzero(near) + np.array([[0], [2000]]))).tolist()
    assert sum(full) < 10_000


def test_links_of_a_blob_take_bounded_memory():
    rng = np.random.default_rng(13)
    x = (rng.normal(size=64) + 0.19 * rng.normal(size=(2500, 64))).astype(np.float32)
    t = cover_join.CoverTree.build(x, np.arange(2500), np.ones(2500, np.int64), np.zeros((2500, 16), np.uint8))
    tracemalloc.start()
    n, root = cover_join.links(t, t, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    assert n.tolist() == ((y @ y.T >= 0.95).sum(1) - 1).tolist() and n.sum() > 2e6 and set(root) == {0}
    assert peak < 120 << 20


# ---------------------------------------------------------------- 10
def brute_lm(texts, order):
    """Interpolated Witten-Bell over bytes, with plain dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = b"\0" * order + t.encode() + b"\0" * order
        for i in range(len(s) - order):
            for k in range(order + 1):
                grams[k][s[i : i + order][:k]] += 1
    follow = [Counter() for _ in range(order)]
    for k in range(1, order + 1):
        for g in grams[k]:
            follow[k - 1][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / 256
        h = g[:-1]
        lower = p(g[1:])
        n, t = grams[len(h)][h], follow[len(h)][h]
        return (grams[len(g)][g] + t * lower) / (n + t) if n else lower

    return p


def test_language_model_against_dictionaries(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(40)] + ["é漢", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    order = 4
    folder = ngram_lm.build(d, order)
    p = brute_lm(texts, order)
    new = [prose(rng, 12) + " Qx", "zz\x7f", "", texts[0]]
    got = {r["doc_id"]: r["logprob"] for r in ngram_lm.scored(spark.createDataFrame(list(enumerate(new)), "doc_id bigint, text string"), folder).collect()}
    for i, t in enumerate(new):
        s = b"\0" * order + t.encode() + b"\0"
        want = sum(math.log(p(s[j - order + 1 : j + 1])) for j in range(order, len(s)))
        assert got[i] == pytest.approx(want, rel=0.03, abs=0.3)


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (1000, 50), (1000, 10**9), (5000, 2**40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n))
    e, _ = ngram_lm.EliasFano.from_buffer(np.frombuffer(ngram_lm.EliasFano.build(v, universe).to_bytes(), np.uint8), 0)
    assert (e.get(np.arange(n)) == v).all()
    q = rng.integers(0, universe + 1, 200)
    assert (e.successor(q, np.zeros(200, int), np.full(200, n)) == np.searchsorted(v, q, "left")).all()


# ---------------------------------------------------------------- all
def test_every_operator_is_registered():
    names = entries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(entries.oracle_sql()) <= set(names)

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm import conversations, encode, leaks, pii, registry, rolling, spans, splitting
from tests.test_oracles import FOLDER, plain, tables  # noqa: F401

DATA = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@DATA
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, tables, name):  # noqa: F811
    df = registry.QUERIES[name](spark, FOLDER)
    cur = tables.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)


@DATA
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns


# 1: splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n\r。́‍!", max_size=120), st.integers(1, 40), st.data())
def test_split(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    p = splitting.split(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(p, p[1:]))
    for s, e, _ in p:
        assert e - s + (overlap if s else 0) <= limit and (not s or s >= overlap)


def test_split_prefers_pauses():
    text = "One two three. Four five six.\n\nSeven eight nine ten."
    assert [text[s:e] for s, e, _ in splitting.split(text, 35, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine ten."]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            splitting.split("x", *bad)


def test_split_frame(spark):
    rows = [("s", "a", "word " * 30, "k"), ("s", "a", "word " * 30, "k"), ("s", "b", None, "k"), ("s", "c", "", None), ("s", "d", "short", "other"), ("s", "e", "x" * 5000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "s string, f string, t string, kind string, piece int")
    out = splitting.split_oversized(df, ["s", "f"], "t", "kind", {"k": (50, 10), None: (1000, 0)}).collect()
    n = {f: len([r for r in out if r.f == f]) for f in "abcde"}
    assert n["b"] == 0 and n["c"] == n["d"] == 1 and n["e"] == 5 and n["a"] > 3
    assert all(len(r.piece) <= 50 for r in out if r.f == "a")
    assert splitting.split_oversized(df.filter("false"), ["s", "f"], "t", "kind", {None: (5, 0)}).collect() == []
    with pytest.raises(ValueError):
        splitting.split_oversized(df, ["piece"], "t", "kind", {})


# 4: conversations


def fault(rows):
    by = {v: (p, t) for v, p, _, t in rows}
    v = max(rows, key=lambda r: (-1 if r[2] is None else r[2], r[0]))[0]
    seen, turns = set(), []
    while v is not None:
        if v not in by or v in seen:
            return "broken"
        seen.add(v)
        turns.append(by[v][1])
        v = by[v][0]
    turns = [t for t in turns if t]
    if not turns:
        return "empty"
    return "no_reply" if any(t == 1 and (i == 0 or turns[i - 1] == 1) for i, t in enumerate(turns)) else None


@pytest.mark.parametrize(("limit", "stretch"), [(10_000, 4_096), (3, 4_096), (3, 2)])
def test_faults(spark, monkeypatch, limit, stretch):
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    rng = random.Random(5)
    rows = []
    for k in range(25):
        n = rng.randint(1, 12)
        for i in range(n):
            p = None if i == 0 else f"n{rng.choice([i - 1, i - 1, i - 1, max(0, i - 2), 50 if rng.random() < 0.05 else i - 1, min(n - 1, i + 1) if rng.random() < 0.05 else i - 1])}"
            rows.append((f"s{k}", f"n{i}", p, i, rng.choice([0, 1, 2, 2])))
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:4]], "k string, v string, p string, seq int, turn int, back string")
    got = {r.k: r.fault for r in conversations.walks(df, "k", "v", "p", "seq", "turn", limit).filter("v IS NULL").collect()}
    want = {k: fault([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert got == want
    assert conversations.walks(df.filter("false"), "k", "v", "p", "seq", "turn", limit).collect() == []


@pytest.mark.parametrize("limit", [10_000, 1])
def test_the_walk_starts_at_the_greatest_number(spark, limit):
    rows = [("low", "a", None, None, 1), ("low", "b", None, -(2**62) - 5, 0), ("tie", "a", None, 3, 0), ("tie", "b", None, 3, 1), ("tie", "c", None, None, 2), ("ok", "z", None, 1, 1), ("ok", "b", "z", 2, 2)]
    df = spark.createDataFrame(rows, "k string, v string, p string, seq long, turn int")
    out = conversations.walks(df, "k", "v", "p", "seq", "turn", limit).collect()
    assert {r.k: r.fault for r in out if r.v is None} == {"low": "empty", "tie": "no_reply", "ok": None}
    assert {(r.k, r.v, r.back) for r in out if r.v is not None} == {("tie", "b", 0), ("ok", "b", 0), ("ok", "z", 1)}


def test_small_groups_stay_whole_beside_a_large_one(spark):
    rows = [(f"s{k}", f"n{i}", f"n{i - 1}" if i else None, i, 1 + i % 2) for k in range(40) for i in range(10)]
    rows += [("large", f"n{i}", f"n{i - 1}" if i else None, i, 1 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v string, p string, seq long, turn int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share one partition
    try:
        a, b = (sorted(tuple(r) for r in conversations.walks(df, "k", "v", "p", "seq", "turn", m).na.fill({"v": "", "back": -1, "turn": 0, "fault": "none"}).collect()) for m in (1000, 20))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert a == b and len(a) == len(rows) + 41


# 7: personal information

LEX = pii.Lexicon(frozenset(["nimol", "mark"]), frozenset(["kuquom", "branch", "page"]))
SEEN = {
    "Author: Anna Berg <a.b@mail.x.example>": ["name", "email"], "cc: a_b7 at dev dot x dot org": ["email"], "a+b [at] x [dot] test": ["email"], "A.B @ X.EXAMPLE": ["email"],
    "Tel. +49 30 23125 497 or 030/23125490": ["phone", "phone"], "on-call ((555) 555-0117)": ["phone"], "555 0187 ext. 25": ["phone"], "1.555.555.0132": ["phone"], "+15555550103": ["phone"],
    "mask SSN 666-55-7328 now": ["id_number"], '"national_id": "002-595619-1"': ["id_number"], "NI number QQ 53 41 14 A": ["id_number"], "Personalausweis L08571062": ["id_number"],
    "at 387 Elm Street, Town.": ["address"], "P.O. Box 6087, Town": ["address"], "Calle Luna 52, 2º B, Town": ["address"], "Mondweg 51b, Town": ["address"], "60 Elm road\nTown ZZ59 7QX again": ["address"],
    "Ms Berg reported it": ["name"], "assignee: L. Berg": ["name"], "Berg, Anna reviewed it.": ["name"], "saw Nimol Kuquom there": ["name"], "ANNA BERG approved.": ["name"],
    "Mark the Branch as done on this Page": [], "Street View renders 12 tiles": [], "build 674-23-4578 is green": [], "pid 85653 exited 2024-04-27": [], "on 192.0.2.233:44198": [], "x@8.16.19 pinned": [], "@decorator at line 5": [],
    "-rw-r--r--  77191 18:56:17 a.md": [], "Session Tree and Index Maintainer disagree": [], "mail <nimol.kuquom@x.test>": ["email"], "": [],
}


@pytest.mark.parametrize("text", sorted(SEEN))
def test_entities(text):
    assert sorted(k for k, _, _ in pii.entities(text, LEX)) == sorted(SEEN[text])


def test_replacements(spark):
    key = b"k"
    assert pii.placeholder("name", "Anna Berg", key) == pii.placeholder("name", "BERG, ANNA", key) != pii.placeholder("name", "Anna Bern", key)
    assert pii.placeholder("email", "a @ x.test", key) == pii.placeholder("email", "A [at] x [dot] test", key)
    s = pii.surrogate("phone", "+49 30 23125 497", key)
    assert len(s) == 16 and [c.isdigit() for c in s] == [c.isdigit() for c in "+49 30 23125 497"]
    assert len({pii._surrogate_token(f"{i:03d}", key) for i in range(1000)}) == 1000
    assert pii.surrogate("name", "ANNA", key) == pii.surrogate("name", "Anna", key).upper()
    rows = [(1, "Ask Anna Berg about x"), (2, None), (3, ""), (4, "nothing"), (1, "Ask Anna Berg about x")]
    df = spark.createDataFrame(rows, "i int, t string")
    out = pii.redact(df, "t", LEX, "k").collect()
    assert len(out) == 5 and {r.t for r in out if r.i != 1} == {None, "", "nothing"}
    assert all(r.t.startswith("Ask [NAME:") and r.t.endswith("] about x") for r in out if r.i == 1)
    found = pii.find(df, ["i"], "t", LEX)
    assert found.count() == 2 and pii.collisions(found, "k").count() == 0
    assert pii.find(df.filter("false"), ["i"], "t", LEX).collect() == []


def test_the_prefilter_is_no_narrower(spark):
    texts = {
        "Author: HANS MÜLLER": "name", "HANS MÜLLER": None, "off to 12b Kastrin road now": "address", "saw Nimol Page there": "name", "saw Nimol KUQUOM there": "name",
        "saw KUQUOM, NIMOL there": "name", "owner: Abc-def Berg": "name", "at ٣٤٥-٦٧٨٩ now": "phone", "Mark Page": None, "the next Page": None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.pii_type for r in pii.find(df, ["i"], "t", LEX).collect()}
    assert [got.get(i) for i in range(len(texts))] == list(texts.values())
    assert all(k == got.get(i) for i, t in enumerate(texts) for k, _, _ in pii.entities(t, LEX))


KEYS = [b"%d" % i for i in range(12)]


@pytest.mark.parametrize(
    ("kind", "value", "part"),
    [("name", "Lane", "Lane"), ("name", "N. Berg", "N."), ("name", "O. Berg", "O."), ("email", "dev@x.test", "dev@"), ("email", "box at dev dot org", "box"), ("name", "Ñandú Łoś", "Ñ"), ("name", "Ñandú Łoś", "Łoś"), ("name", "Öz", "Ö"), ("address", "5 Lane Road", "Lane"), ("email", "aд中@x.test", "д中")],
)
def test_no_part_stays_in_clear(kind, value, part):
    at = value.index(part)
    assert {pii.surrogate(kind, value, k)[at : at + len(part)] for k in KEYS} - {part}


def test_format_words_stay_at_their_place():
    for k in KEYS:
        assert pii.surrogate("email", "a_b7 at dev dot x dot org", k)[4:16] == " at dev dot " and pii.surrogate("email", "a@mail.x.example", k).endswith(".example")
        for value, words in {"Flat 3, 5 N. Elm Lane, Town ZZ59 7QX": ["Flat ", " N. ", " Lane, "], "P.O. Box 6087, Town": ["P.O. Box "], "Mondweg 51b, Town": ["weg "], "Calle Luna 52, 2º B, Town": ["Calle ", "º "], "12 bis rue de la Lune, Ville": [" bis rue de la "]}.items():
            assert pii.entities(new := pii.surrogate("address", value, k), LEX) == [("address", 0, len(value))] and all(w in new for w in words)


@pytest.mark.parametrize(("kind", "form"), [("email", "a@{}.com"), ("email", "a at {} dot com"), ("email", "a@x.{}"), ("address", "12 Elm {} Road"), ("name", "Anna {}")])
def test_surrogates_are_distinct(kind, form):
    three = [a + b + c for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"] + ["mail", "lane", "test"]
    values = [form.format(w if kind == "email" else w.title()) for w in three]
    assert len({pii.surrogate(kind, v, b"k") for v in values}) == len(values)


def test_surrogate_collisions_are_seen(spark, monkeypatch):
    found = spark.createDataFrame([("name", "Anna Berg"), ("name", "BERG, ANNA"), ("name", "Anna Bern")], "pii_type string, value string")
    assert pii.collisions(found, "k").collect() == []
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, key: "x")
    assert [tuple(r) for r in pii.collisions(found, "k").collect()] == [("name", "x", 2)]


# 8: encoding


@pytest.mark.skipif(not os.path.exists(encode.TOKENIZER), reason="no tokenizer here")
@pytest.mark.parametrize("text", ["plain words", "naïve 日本 🙂🙂 \x00\x07", "<|endoftext|>", "a\r\n\r\n  b", "́"])
def test_round_trip(spark, text):
    rows = [(1, text), (2, None), (3, ""), (4, text * 500)]
    df = encode.encode(spark.createDataFrame(rows, "d long, t string"), "d", "t", offsets=True)
    out = {r.d: r for r in df.collect()}
    assert out[2].ids == out[3].ids == [] and encode.decode(out[1].ids) == text and encode.decode(out[4].ids) == text * 500
    assert all(text[s:e] for s, e in zip(out[1].starts, out[1].ends)) and out[1].starts[0] == 0 and out[1].ends[-1] == len(text)
    assert {r.d: r.text for r in encode.decoded(df, "d", "ids").collect()}[1] == text


# 9: leaks


def brute_runs(docs, items, n):
    out = set()
    for d, t in docs:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, p in items:
            q = "".join(c if c.isalnum() else " " for c in (p or "").lower()).split()
            if any(tuple(q[k : k + n]) in grams for k in range(len(q) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("n", [3, 12])
def test_leaks_as_brute_force(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(30)] + ["É", "x-y"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 30)))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(None, "x"), (900, None), (901, "")]
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        p = items[rng.randrange(12)][1].upper().replace(" ", ", ").split(" ")
        a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
        docs.append((d, " ".join(w[:9] + p[a:b] + w[9:])))
    df = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, item_id string")
    q = spark.createDataFrame([(*x, "no answer") for x in items + items[:2]], "item_id long, passage string, answer string")
    got = [tuple(r) for r in leaks.leaked_runs(df, q, n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs([d for d in docs if d[0] is not None], items, n)
    assert leaks.leaked_runs(df, q.filter("false"), n).collect() == [] == leaks.leaked_runs(df.filter("false"), q, n).collect()


def test_grid_and_balls_and_subsequences():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v = np.concatenate([v, v[:50] + 0.01, np.full((2, 8), np.nan)]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for c in (0.5, 0.9, 0.999):
        want = {(i, j) for i, j in zip(*np.nonzero(v[:120] @ v.T >= c))}
        grid = leaks.Grid(v, c)
        a, b = grid.pairs(v[:120])
        assert want <= set(zip(a.tolist(), b.tolist())) and len(a) == len(set(zip(a.tolist(), b.tolist())))
        got = {(int(i), int(j)) for a, b, _ in leaks.Balls(v, c).pairs(v[:120]) for i, j in zip(a, b)}
        assert want <= got and all(v[i] @ v[j] > c - 1e-3 for i, j in got)
    assert len(leaks.Grid(v, 0.999).which) < 20 * len(v)
    assert list(leaks.Balls(v[:0], 0.9).pairs(v)) == []
    x, y = np.array([[1, 2, 3, 4]]), np.array([[2, 9, 4, 3]])
    assert leaks.longest_common_subsequence(x, y).tolist() == [2]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 2)
    words = [[f"w{i}x{j}" for j in range(15)] for i in range(5)]
    df = spark.createDataFrame([(i, " ".join(["start", *w, "end"])) for i, w in enumerate(words)], "doc_id long, text string")
    q = spark.createDataFrame([(10 + i, " ".join(w), None) for i, w in enumerate(words)], "item_id long, passage string, answer string")
    want = {(i, 10 + i) for i in range(5)}
    assert {tuple(r) for r in leaks.leaked_runs(df, q, 12).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.paraphrases(df, q).collect()} == want


def test_recall_of_each_reshaping(spark):
    """At least nine in ten passages are found, whatever was done to them and wherever they stand."""
    rng = random.Random(11)
    vocab = [f"v{min(rng.randrange(900), rng.randrange(900))}" for _ in range(4000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(17, 35))]) for i in range(30)]

    def fill(n):
        return [rng.choice(vocab) for _ in range(n)]

    def some(w, share):
        return [rng.choice(vocab) if rng.random() < share else x for x in w]

    styles = {
        "middle": lambda w: fill(70) + some(w, 0.13) + fill(70), "end": lambda w: fill(75) + some(w, 0.13), "start": lambda w: some(w, 0.13) + fill(75), "alone": lambda w: some(w, 0.13),
        "halves swapped": lambda w: fill(50) + w[len(w) // 2 :] + w[: len(w) // 2] + fill(50), "three quarters": lambda w: fill(rng.randrange(30, 60)) + w[: -(-len(w) * 3 // 4)] + fill(40),
        "three quarters at the end": lambda w: fill(60) + w[len(w) // 4 :], "three quarters alone": lambda w: w[: -(-len(w) * 3 // 4)], "words put in": lambda w: fill(40) + [y for x in w for y in ([x, rng.choice(vocab)] if rng.random() < 0.2 else [x])] + fill(40),
    }
    docs, planted = [(i, " ".join(fill(rng.randrange(120)))) for i in range(200)], {}
    for style, change in styles.items():
        for _ in range(30):
            item, w = rng.choice(items)
            planted[1000 + len(docs)] = (style, item)
            docs.append((1000 + len(docs), " ".join(change(w))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(w), w[3]) for i, w in items], "item_id long, passage string, answer string")
    got = {(r.doc_id, r.item_id) for r in leaks.paraphrases(df, q).collect()}
    for style in styles:
        of = [(d, i) for d, (s, i) in planted.items() if s == style]
        assert sum(x in got for x in of) >= 0.9 * len(of), style
    assert sum(d < 1000 for d, _ in got) <= 2


def test_paraphrase(spark):
    p = "the quick brown fox jumps over the lazy dog near the old river bank today"
    df = spark.createDataFrame([(1, "intro words here " + p.replace("lazy ", "") + " and rest"), (2, "other things entirely " * 9), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, p, "river bank")], "item_id long, passage string, answer string")
    out = leaks.paraphrases(df, q, 0.6, 0.7).collect()
    assert [(r.doc_id, r.item_id, r.holds_answer) for r in out] == [(1, 7, True)]


def test_paraphrase_at_the_end_and_in_short_documents(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    p = [f"p{i}" for i in range(24)]
    less = [w for i, w in enumerate(p) if i % 6 != 3]
    moved = [*less[:4], less[5], less[4], *less[6:]]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(80))) for i in range(40)]
    docs += [(100, " ".join(less)), (101, " ".join(vocab[:51] + moved)), (102, " ".join(moved + vocab[:51])), (103, "p0"), (104, ""), (105, " ".join(p))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(7, " ".join(p), "p4 p5")], "item_id long, passage string, answer string")
    got = {r.doc_id: round(r.lcs_share * 24) for r in leaks.paraphrases(df, q).collect()}
    assert got == {100: 20, 101: 19, 102: 19, 105: 24}


# 10: shared spans


def brute_shared(docs, length):
    own: dict[str, set] = {}
    for d, t in docs:
        for s in range(len(t or "") - length + 1):
            own.setdefault(t[s : s + length], set()).add(d)
    out = {}
    for d, t in docs:
        inside = {i for s in range(len(t or "") - length + 1) if len(own[t[s : s + length]]) > 1 for i in range(s, s + length)}
        if inside:
            out[d] = len(inside)
    return out


@pytest.mark.parametrize("length", [5, 40, 80])
def test_shared_as_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(spans, "_GATHER", 50)
    rng = random.Random(length)
    base = ["".join(rng.choice("ab 日🙂") for _ in range(3 * length)) for _ in range(4)]
    docs = [(1000, None), (1001, ""), (1002, "z" * 400), (1003, "z" * 400)]
    for d in range(40):
        b = rng.choice(base)
        a, e = sorted(rng.randrange(len(b) + 1) for _ in range(2))
        docs.append((d, "".join(rng.choice("abc") for _ in range(rng.randrange(60))) + b[a:e] + "".join(rng.choice("xyz") for _ in range(rng.randrange(60)))))
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, shared int").repartition(3)
    got = {r.doc_id: r.shared_chars for r in spans.shared_chars(df, "doc_id", "text", length).collect()}
    assert got == brute_shared(docs, length)
    assert spans.shared_chars(df.filter("false"), "doc_id", "text", length).collect() == []


def test_a_passage_in_every_document_loads_no_bucket():
    """What goes to each bucket, by blocks as tasks send them."""
    rng = np.random.default_rng(3)
    passage = "".join(map(chr, rng.integers(97, 123, 2_000)))
    docs = [passage + "".join(map(chr, rng.integers(97, 123, 2_000))) for _ in range(600)]
    load = np.zeros(12, np.int64)
    for run in (spans._anchors(300, 12), spans._windows(300, 12)):
        for k in range(0, 600, 100):
            marks = [spans.keyed(rolling.window_hashes(p, a := spans._anchor_places(len(p), 300), spans.plan(300)[0]), 12).view(np.int64)[: len(a) // 2] for p in (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in docs[k : k + 100])]
            b = pa.record_batch({"doc": pa.array(range(k, k + 100), pa.int64()), "text": pa.array(docs[k : k + 100]), "marks": pa.array(marks, pa.list_(pa.int64()))})
            for out in run(iter([b])):
                np.add.at(load, out.column("bucket").to_numpy(), out.column("n").to_numpy())
        assert load.max() < 1.3 * load.mean()


def test_equal_first_hashes_alone_share_nothing():
    h, g = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    doc, start = np.array([1, 2, 3, 1]), np.array([10, 20, 30, 40])
    keep, found = spans.combine(h, g, doc, start, np.zeros(4, np.uint8), False)
    assert sorted(found[1].tolist()) == [1, 3] and sorted(zip(keep[0].tolist(), keep[1].tolist())) == [(5, 1), (5, 2), (7, 1)]


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_difference_sets(q):
    d, p = spans.difference_set(q), q * q + q + 1
    assert {(a - b) % p for a in d for b in d} == set(range(p)) and len(d) == q + 1


def test_hashes_and_words():
    rng = np.random.default_rng(1)
    p = rng.integers(97, 99, 3000).astype(np.uint32)
    s = np.arange(2980)
    h = rolling.window_hashes(p, s, 20)
    text = [bytes(p[i : i + 20].astype(np.uint8)) for i in s]
    assert len(set(h.tolist())) == len(set(text)) and len(set(zip(h.tolist(), text))) == len(set(text))
    w, at = rolling.words(["A b-a", "", "É é ß"])
    assert at.tolist() == [0, 3, 3, 6] and w[0] == w[2] != w[1] and w[3] == w[4]



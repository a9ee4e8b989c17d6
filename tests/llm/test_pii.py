"""Recall and precision by type on sentences of our own, written without regard to any test table."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from loomtrace.llm import pii

#: Entities stand in braces with the first letter of their type: e, p, i, a, n.
SENTENCES = r"""
Author: {n:Łukasz Nowak}
My name is {n:Šárka Nová} and I maintain the scheduler.
{n:Maria Gonzalez} called about the bug.
Dear {n:John Smith}, please find the report attached.
Hi {n:Priya Raman}! The build is red again.
Kind regards,\n{n:Tomás Ó Briain}
I spoke with {n:Ludwig van Beethoven} yesterday.
The ticket was filed by {n:Søren Kierkegaard} and closed.
Please forward it on behalf of {n:Zoë Wanamaker}.
{n:Ngozi Okafor} wrote the first draft.
Mrs {n:Eleanor Rigby} lives near the church.
Prof. {n:Noether} suggested a symmetry.
Reviewer: {n:J. Müller}
姓名：{n:山田太郎}
Автор: {n:Ольга Иванова}
Patient: {n:Anneke de Vries}, seen on Monday.
{n:O'Brien, Kathleen} confirmed the order.
From: {n:Carlos Núñez} <{e:carlos@nunez.example}>
Viele Grüße\n{n:Jürgen Groß}
This is {n:Aisha Rahman} from the data team.
{n:DAVID COPPERFIELD} signed the form.
Call {n:Peter Pan} about the window.
Tell me whether {n:Grace Hopper} replied.
Mail {e:jürgen@exämple.de} or {e:ops-team+alerts@mail.example.co.uk}.
Write to {e:first.last [at] example [dot] org} please.
Reach me under {e:a_b@c-d.io}, thanks.
login: {e:root@host.internal.example}
Send it to {e:x.y at corp dot example}.
Ring (020) was the old prefix; now dial {p:(020) 7946 0958}.
Phone {p:020 7946 0958} after nine.
Her mobile is {p:+1 (415) 555-2671}.
Tel: {p:+33 1 42 68 53 00}
Fax {p:212-555-0199}, room 7.
Call {p:1-800-555-0199} free of charge.
Numéro : {p:01 42 68 53 00}
Dial {p:555-0123} for help.
Mobile {p:+447700900123} is off.
Durchwahl {p:030/901820}.
Office {p:415.555.2671} x9.
Whatsapp {p:+91 98765 43210} now.
My SSN is {i:078-05-1120}.
passport number {i:X12345678} expired.
NHS number: {i:943 476 5919}
driver's license no. {i:D1234567} on file
national insurance number: {i:QQ 12 34 56 C}
Steuer-ID {i:12345678901}
tax id: {i:91-1144442}
He lives at {a:12 Oak Way}.
Ship to {a:10 Rue de Rivoli}, quickly.
She moved to {a:221B Baker Street} last year.
{a:Hauptstraße 5}, second floor
{a:1600 Pennsylvania Avenue} is white.
Meet at {a:4 Privet Drive}.
Office: {a:77 Massachusetts Ave}
Post: {a:P.O. Box 1234}
{a:Calle Mayor 12}, first door
Адрес: {a:ул. Ленина, 12}
{a:9 Elm St.} is vacant.
Deliver to {a:Postfach 4711}.
{a:Keizersgracht 12}, by the water
The version 123-4567 is out.
Machine Learning approved is no sentence about people.
Session Manager called the handler twice.
Error Handler asked for more memory.
Street View renders 12 tiles.
Please see Issue 555-1234 for details.
The Last Supper wants restoration.
Build 2024-05-01 took 1234567 ms.
Listening on 127.0.0.1:8080 and 10.0.0.255.
git checkout feature/at-dot-com
uuid 123e4567-e89b-12d3-a456-426614174000
Install react@18.2.0 and lodash@4.17.21.
@property def name(self): return self._name
Mark the Branch as done on this Page.
The Search Index replied in 12 ms.
Data Center moved to another region.
order 0399148316 replayed
Unit Test reported three failures.
Version Control works well.
Then Continuous Integration said no.
epoch 1709556638123 at 00:00
Chapter 12 Way of the future
""".strip().split("\n")
KINDS = {k[0]: k for k in pii.TYPES}
#: What the forms can't tell stays in the sentences and counts against recall.
LEXICON = pii.Lexicon(frozenset(["grace"]), frozenset(["hopper"]))


def parsed(line):
    text, at, out = "", 0, []
    line = line.replace("\\n", "\n")
    for m in re.finditer(r"\{([epian]):([^}]*)\}", line):
        text += line[at : m.start()]
        out.append((KINDS[m[1]], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], out


@pytest.mark.parametrize("kind", pii.TYPES)
def test_recall_and_precision(kind):
    hit = wanted = found = 0
    for text, want in map(parsed, SENTENCES):
        got = [x for x in pii.entities(text, LEXICON) if x[0] == kind]
        want = [x for x in want if x[0] == kind]
        wanted += len(want)
        found += len(got)
        hit += sum(any(s < e2 and s2 < e for _, s2, e2 in got) for _, s, e in want)
    assert wanted >= 6 and hit >= 0.9 * wanted and hit >= 0.9 * found, (kind, hit, wanted, found)


def test_whole_entities_are_found():
    for text, want in map(parsed, SENTENCES[:30]):
        assert pii.entities(text, LEXICON) == want, text


def test_the_sieve_lets_all_of_them_through():
    texts = [parsed(x)[0] for x in SENTENCES] + ["pairing with nimol kuquom now", None, ""]
    lex = pii.Lexicon(frozenset(["nimol"]), frozenset(["kuquom"]))
    may = pii._Sieve(lex).may_hold(pa.array(texts, pa.string())).to_pylist()
    assert all(m for m, t in zip(may, texts) if t and pii.entities(t, lex)) and not may[-1] and not may[-2]


def test_lower_case_names_need_known_parts():
    lex = pii.Lexicon(frozenset(["nimol", "mark"]), frozenset(["kuquom", "page"]))
    for text, n in {"saw nimol kuquom there": 1, "pairing with nimol berg tomorrow": 1, "pairing with nimol tomorrow": 0, "the nimol parser": 0, "mark page done": 0, "src/nimol kuquom": 0}.items():
        assert len(pii.entities(text, lex)) == n, text


@pytest.mark.parametrize("value", ["Ольга Иванова", "山田太郎", "Łukasz Öztürk", "Anna Rossi", "Mak Dug", "N. Berg", "Ελένη Παππά", "김 민수"])
def test_no_word_of_a_name_stays(value):
    for k in range(40):
        new = pii.surrogate("name", value, b"%d" % k)
        assert len(new) == len(value) and not {*re.findall(r"\w+", value)} & {*re.findall(r"\w+", new)}
        for a, b in zip(re.findall(r"\w+", value), re.findall(r"\w+", new)):
            assert [c.isupper() for c in a] == [c.isupper() for c in b]
            if len(a) > 2:  # the letter that tells gender
                assert a[-1] == b[-1] if a[-1] in pii._GENDERED else b[-1] not in pii._GENDERED


def test_one_cycle():
    for size in (2, 3, 5, 21, 100):
        image = [pii._permute(n, size, b"k") for n in range(size)]
        assert sorted(image) == list(range(size)) and all(i != n for n, i in enumerate(image))


def test_what_isn_t_hidden_is_reported(spark, monkeypatch):
    found = spark.createDataFrame([("name", "Anna Berg"), ("email", "a@x.test")], "pii_type string, value string")
    assert pii.collisions(found, "k").collect() == []
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, key: value)
    assert sorted(tuple(r) for r in pii.collisions(found, "k").collect()) == [("email", "a@x.test", 0), ("name", "anna berg", 0)]

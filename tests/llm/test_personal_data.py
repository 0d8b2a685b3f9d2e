"""Personal data: planted look-alikes are added and refused per kind, votes come from their own sources, odd rows."""

import random

import pytest

from docframe.llm import pii
from docframe.plans.ship import ship

FILL = "the report was ready when our team met them again and some of it went on for days without much change".split()


def card(rng, lead, length):
    body = lead + "".join(rng.choice("0123456789") for _ in range(length - len(lead) - 1))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def fours(digits, sep):
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def number(rng, n):
    return rng.choice("23456789") + "".join(rng.choice("0123456789") for _ in range(n - 1))


def name(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))


def octets(rng, low, high):
    return [str(rng.randint(low, high)) for _ in range(4)]


# Per kind: words before, then base spans, look-alikes that are personal data, look-alikes that are not.
PLANTS = {
    "email": (
        ("email", "contact", "write to"), ("import", "class", "decorator"),
        lambda r: f"{name(r)}@{name(r)}.com",
        [lambda r: f"{name(r)} (at) {name(r)}.org", lambda r: f"{name(r)} [at] {name(r)} [dot] de", lambda r: f"{name(r)} at {name(r)} dot com", lambda r: f"{name(r)} @ {name(r)}.net"],
        [lambda r: f"{name(r)}@{name(r)}"],
    ),
    "ip": (
        ("server", "host", "login from"), ("namespace", "method", "version"),
        lambda r: ".".join(octets(r, 11, 220)),
        [lambda r: "[.]".join(["10", *octets(r, 1, 99)[1:]]), lambda r: f"2001:db8:{number(r, 4)}:{number(r, 3)}::{number(r, 2)}", lambda r: ":".join(["fe80", *[number(r, 4) for _ in range(7)]])],
        [lambda r: f"{r.choice(['abc', 'fade', 'bad'])}::{r.choice(['def', 'dead', 'face'])}", lambda r: ".".join(str(r.randint(300, 999)) for _ in range(4))],
    ),
    "card": (
        ("card", "visa", "paid by"), ("order", "tracking", "serial"),
        lambda r: fours(card(r, "4", 16), " "),
        [lambda r: card(r, "37", 15), lambda r: fours(card(r, "52", 16), ".")],
        [lambda r: card(r, "99", 14), lambda r: card(r, "18", 13)],
    ),
    "phone": (
        ("call", "phone", "tel"), ("ratio", "invoice", "catalogue"),
        lambda r: f"+49 30 {number(r, 7)}",
        [lambda r: f"({number(r, 3)}) {number(r, 3)}-{number(r, 4)}", lambda r: f"0044 20 {number(r, 4)} {number(r, 4)}"],
        [lambda r: f"1{number(r, 2)}.0{number(r, 2)}.{number(r, 4)}", lambda r: f"0{number(r, 3)}/{number(r, 5)}"],
    ),
}


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with one span each, and what should become of it."""
    ship(spark)
    rng, rows, want = random.Random(21), [], {}
    for kind, (cues, against, base, good, bad) in PLANTS.items():
        for label, makers, words, n in (("base", [base], cues, 120), ("good", good, cues, 30), ("bad", bad, against, 60)):
            for maker in makers:
                for _ in range(n):
                    head = " ".join(rng.choices(FILL, k=6)) + " " + rng.choice(words) + " "
                    span = maker(rng)
                    want[len(rows)] = (kind, label, len(head), len(head) + len(span))
                    rows.append((len(rows), head + span + " " + " ".join(rng.choices(FILL, k=5))))
    found = {r.doc_id: r.found for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    return want, found


@pytest.mark.parametrize("kind", pii.KINDS)
def test_look_alikes_are_added_and_refused(planted, kind):
    want, found = planted
    shares = {}
    for label in ("base", "good", "bad"):
        mine = [(d, s, e) for d, (k, lab, s, e) in want.items() if (k, lab) == (kind, label)]
        shares[label] = sum(any((pii.KINDS[x.kind], x.start, x.stop, x.base) == (kind, s, e, label == "base") for x in found[d]) for d, s, e in mine) / len(mine)
    assert shares["base"] == 1 and shares["good"] >= 0.9 and shares["bad"] <= 0.1, shares


def test_labelers_use_sources_of_their_own():
    def vote(text, kind, span, standing=0):
        s = text.index(span)
        return pii.votes(text, pii.KINDS.index(kind), s, s + len(span), standing)

    assert vote("write to a@b.com now", "email", "a@b.com", 1)[0] == [1, 1, 1, 1, 1]
    assert vote("the class a@b now", "email", "a@b")[0] == [0, -1, 0, -1, 1]
    assert vote("a@b.example", "email", "a@b.example", 1)[0][:3] == [1, 1, -1]
    assert vote("host 10[.]1[.]2[.]3", "ip", "10[.]1[.]2[.]3")[0] == [0, 1, 1, 1, 1]
    assert vote("version 1.2.3.4", "ip", "1.2.3.4", 1)[0] == [1, 1, 0, -1, 1]  # the registry does not repeat the rule
    assert vote("x 340282366920938463463374607431768211455.1.2.3", "ip", "340282366920938463463374607431768211455.1.2.3", -1)[0] == [-1, -1, -1, 0, 1]
    assert vote("card 378282246310005", "card", "378282246310005")[0] == [0, 1, 1, 1, 1]
    assert vote("call +999 12345678", "phone", "+999 12345678", 1)[0] == [1, 1, 1, 1, 1]
    assert vote("+210 12345678", "phone", "+210 12345678", 1)[0][2] == 1 and vote("+89 1234567", "phone", "+89 1234567", 1)[0][2] == -1
    assert vote("+" + "1 " * 30_000 + "1", "phone", "+" + "1 " * 30_000 + "1", -1)[0][0] == -1
    features = vote("class a@b.com x", "email", "a@b.com", 1)[1]
    assert features == vote("class a@b.com x", "email", "a@b.com", -1)[1]  # no vote reaches the classifier


def test_odd_rows_and_empty_table(spark):
    ship(spark)
    rows = [(1, None, "x", 1), (None, "", "y", 2), (2, "reach me: a.b@c.de", "z", 3), (2, "reach me: a.b@c.de", "z", 3), (3, "é" * 5 + " 1.2.3.4", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, candidates long")
    got = sorted(((r.doc_id or 0, r.candidates, [tuple(x) for x in r.found]) for r in pii.find_personal_data(df).collect()), key=str)
    assert got == [(0, 2, []), (1, 1, []), (2, 3, [(0, 10, 18, True)]), (2, 3, [(0, 10, 18, True)]), (3, None, [(1, 6, 13, True)])]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_one_kind_keeps_no_overlapping_candidates():
    rng = random.Random(4)
    pieces = ["a (at) b.c", "x@y", " @ ", "1.2.3.4", "::1", "4111.1111.1111.1111", "555-123-4567", "0044 20 1234 5678", " at b dot c", "030/1234567", "+1 555 1234567", " "]
    for _ in range(400):
        found = pii.matches("".join(rng.choices(pieces, k=7)))
        for kind in range(4):
            mine = sorted((s, e) for k, s, e, _ in found if k == kind)
            assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))

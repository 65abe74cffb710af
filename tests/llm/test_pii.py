import random

import pytest

from phrasewerk.llm import pii

FIRST, LAST = ["Anna", "Bodo", "Cleo", "Dora", "Till"], ["Birkhain", "Dachsfeld", "Eulenau", "Fuchsthal", "Grashof"]


def mention(rng):
    a, b = rng.choice(FIRST), rng.choice(LAST)
    return rng.choice([f"{a} {b}", f"{b}, {a}", f"{a[0]}. {b}", f"{a} von {b}", f"{a} K. {b}", f"{a} {b}-{rng.choice(LAST)}", b, f"{a} {b}".upper(), f"{a} {b}".lower()])


def letter(rng):
    """A letter and its cases."""
    lines = [
        ("Frau {NAME} berichtet über Beschwerden.", ["NAME"]), ("Herr {NAME}, geb. am 05.05.1942, Versichertennummer {ID}.", ["NAME", "ID"]),
        ("{NAME} hat am Telefon zugestimmt.", ["NAME"]), ("Sie lebt in der {ADDRESS}. Der Verlauf war gut.", ["ADDRESS"]), ("Rückfragen an {EMAIL} oder Tel. {PHONE}.", ["EMAIL", "PHONE"]),
        ("Mr {NAME} asks for a call back, {PHONE}", ["NAME", "PHONE"]), ("Passport {ID} was shown.", ["ID"]), ("Discharged home ({ADDRESS}).", ["ADDRESS"]),
        (f"Verdacht auf Morbus {rng.choice(LAST)}, {rng.choice(LAST)}-Score am 3.4.2029.", []), ("Gerät SN K13620203, Charge 0317-58-452, LOT 637/54785.", []), ("RR 123/93 mmHg till noon, Puls 69/min.", []),
    ]
    make = {
        "NAME": lambda: mention(rng), "ID": lambda: rng.choice(["L73X65T20", "A 962 470 058", "20764581W211", "PID-2454-180-39", "999 076 6763", "QQ 15 11 00 C", "981-84-7354", "MRN4525092"]),
        "ADDRESS": lambda: rng.choice(["Schulweg 133, 75614 Kaltbrücken", "Am Alten Wehr 126", "Krähenstr. 143 b, D-67067 Neu Holmstedt", "Flat 9, 81b Alder Row, Upper Denby NX4 3VZ", "50 Mill Street"]),
        "EMAIL": lambda: rng.choice(["a.b@mail.test", "c_d [at] uk-west.example", "e(at)praxis(dot)example", "F-G+H@X.INVALID"]),
        "PHONE": lambda: rng.choice(["0049 (0)69 90009483", "030.23125.273", "+49(221)4710 815", "(069) 90009 216", "0171/392 00 76", "020 7946 0395", "+1 (555) 555-0104"]),
    }
    text, cases = "", []
    for _ in range(rng.randrange(1, 7)):
        line, kinds = rng.choice(lines)
        for kind in kinds:
            before, line = line.split("{" + kind + "}", 1)
            text += before
            value = make[kind]()
            cases.append((kind, len(text), len(text) + len(value)))
            text += value
        text += line + rng.choice(["\n", "\r\n", " \n"])
    return text, cases


def test_found_and_replaced(spark, monkeypatch):
    rng = random.Random(3)
    letters = [letter(rng) for _ in range(400)]
    rows = [(i, t, "clash") for i, (t, _) in enumerate(letters)]
    df = spark.createDataFrame([*rows, rows[0], (900, None, "x"), (901, "", "x"), (None, "Frau Anna Birkhain", "x")], "file_id long, content string, kind string").repartition(3)
    want = {(i, *c) for i, (_, cs) in enumerate(letters) for c in cs}
    got = [tuple(r) for r in pii.found(df).collect()]
    assert len(got) == len(set(got))
    print("missed", [(k, letters[i][0][max(0, b - 15) : e + 10]) for i, k, b, e in sorted(want - set(got))][:12])
    assert len(set(got) & want) >= 0.98 * len(want) and len(set(got) & want) >= 0.98 * len(got)
    clean = {r.file_id: r.content for r in pii.sanitised(df).collect()}
    assert set(clean) == {*range(400), 900, 901} and clean[900] is None and clean[901] == ""
    by = {}
    for i, kind, b, e in got:
        by.setdefault(i, []).append((b, e, kind))
    assert all(clean[i] == pii.replaced(t, sorted(by.get(i, []))) for i, (t, _) in enumerate(letters))
    monkeypatch.setattr(pii, "BROADCAST_WORDS", 0)  # the words come with each text
    assert sorted(tuple(r) for r in pii.found(df).collect()) == sorted(got)


@pytest.mark.parametrize("text", ["", None, "x" * 50_000, "0" * 3000, "@ @ (at) ..", "Frau", "a.b@" * 200])
def test_odd_texts(text):
    assert pii.found_in(text, pii.Names(set(), set())) == []


def test_empty_table(spark):
    assert pii.found(spark.createDataFrame([], "file_id long, content string")).count() == 0

from collections import Counter
from math import sqrt

from phrasewerk.operators import retrieval as R


def truth(texts):
    n = Counter()
    for s in texts:
        s = f" {s.lower()} "
        n.update((ord(s[i]) * 961 + ord(s[i + 1]) * 31 + ord(s[i + 2])) % R.DIMS for i in range(len(s) - 2))
    length = sqrt(sum(x * x for x in n.values()))
    return {d: round(x / length, 9) for d, x in n.items()}


def test_encoded_without_joins(spark, capsys):
    rows = [(1, "Zyste links"), (2, None), (3, " .,- "), (None, "ohne Nummer"), (4, "𐐨ß Ödem"), (1, "Leber"), (5, "a")]
    df = R.encoded(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {}
    for r in df.collect():
        got.setdefault(r.id, {})[r.dim] = round(r.weight, 9)
    assert got == {1: truth(["zyste links", "leber"]), None: truth(["ohne nummer"]), 4: truth(["𐐨ß ödem"])}
    df.explain()
    assert "Join" not in capsys.readouterr().out  # each gram as a row, twice, is what did not fit


def test_hybrid_encodes_without_rows_of_grams(spark, capsys):
    from phrasewerk.plans import catalog

    df = catalog.QUERIES["rg07_hybrid"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    df.explain()
    assert "MapInArrow" in capsys.readouterr().out

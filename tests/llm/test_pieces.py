import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasewerk.llm import pieces

texts = st.lists(st.sampled_from(["Wort", "langeswort" * 3, ". ", " ", "\n", "! ", "x" * 55, "ä", "  \t "]), max_size=60).map("".join)


def check(text, got, limit, overlap):
    covered = set()
    for (b, e, hard), later in zip(got, [*got[1:], None]):
        assert 0 <= b <= e <= len(text) and e - b <= limit
        covered |= set(range(b, e))
        if later:
            assert b < later[0] and e < later[1] and max(0, e - later[0]) <= overlap
            assert hard or text[e].isspace()
            assert not hard or not re.search(r"\s", text[b : e + 1])
    assert all(i in covered or text[i].isspace() for i in range(len(text)))
    assert any(h for _, _, h in got) == bool(re.search(r"\S{%d}" % (limit + 1), text))
    assert got or not text.strip()


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from([(20, 0), (20, 7), (50, 49), (60, 20)]))
def test_whole_items(text, sizes):
    check(text, pieces.pieces_of(text, *sizes), *sizes)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_whole_items(spark, seed, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(pieces, "BLOCK", 3)  # several levels of the tree

    rng = random.Random(seed)
    long = ["".join(rng.choice(["Wort ", "Satz. ", "ä", "\n", " " * rng.randrange(1, 150), "y" * rng.randrange(1, 90), "€uro, "]) for _ in range(rng.randrange(20, 200))) for _ in range(4)]
    rows = [(i, t, "x", "clash") for i, t in enumerate([*long, "", None, "kurz", " " * 300, "z" * 200])]
    df = spark.createDataFrame([*rows, rows[0]], "id long, text string, piece string, item string")
    got = pieces.split_items(df, ["id"], "text", 40, 10, 160).collect()
    for i, text, _, _ in rows:
        mine = sorted((r.piece_no, r.begin, r.end, r.hard, r.piece) for r in got if r.id == i)
        if text is None:
            assert not mine
        else:
            assert mine == [(n, b, e, h, text[b:e]) for n, (b, e, h) in enumerate(pieces.pieces_of(text, 40, 10))]
    for i, text in enumerate(long):
        (tmp_path / f"f{i}.txt").write_bytes(text.encode())
    (tmp_path / "leer.txt").write_bytes(b"")
    files = pieces.split_files(spark, str(tmp_path), 40, 10, 160).collect()
    for i, text in enumerate(long):
        mine = sorted((r.piece_no, r.begin, r.end, r.hard, r.piece) for r in files if r.item.endswith(f"f{i}.txt"))
        assert mine == [(n, b, e, h, text[b:e]) for n, (b, e, h) in enumerate(pieces.pieces_of(text, 40, 10))]
    assert not [r for r in files if r.item.endswith("leer.txt")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert pieces.split_items(df, ["id"], "text").count() == 0

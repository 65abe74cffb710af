from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasewerk.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_holds_every_item_once(lengths):
    runs = packing.plan(np.bincount(lengths or [0], minlength=65) * (1 if lengths else 0), 64, 16)
    held = Counter()
    for times, ns in runs:
        assert times > 0 and sum(ns) <= 64
        for n in ns:
            held[n] += times
    assert held == Counter(lengths)
    assert sum(t for t, _ in runs) <= 1.25 * -(-sum(lengths) // 64) + 1 + sum(n > 32 for n in lengths)


def test_few_runs_and_little_waste_at_any_size():
    rng = np.random.RandomState(1)
    lengths = np.clip(np.exp(rng.normal(5.3, 0.9, 20_000)).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    for times in (1, 1000):
        runs = packing.plan(counts * times)
        n = sum(t for t, _ in runs)
        assert 1 - (counts * np.arange(2049)).sum() * times / (n * 2048) < 0.003
        assert len(runs) < 8000


def test_nnls_on_a_known_case():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 1.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 1], atol=1e-6)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)  # several parts
    sizes = [(i, n, "clash") for i, n in enumerate([0, None, 10, 10, 10, 30, 64, 65, 200, 1] + [20] * 50)]
    df = spark.createDataFrame([*sizes, sizes[2]], "doc_id long, n long, container_id string")
    rows = packing.pack_sizes(df.select("doc_id", "n"), capacity=64).collect()
    by, held = defaultdict(list), Counter()
    for r in rows:
        by[r.doc_id].append((r.piece_no, r.first_token, r.n_tokens))
        if r.n_tokens:
            held[r.container_id] += r.n_tokens
        else:
            assert r.container_id is None
    assert len(by) == len(sizes) and max(held.values()) <= 64 and set(held) == set(range(len(held)))
    for i, n, _ in sizes:
        n = n or 0
        assert sorted(by[i]) == [(k, k * 64, min(64, n - k * 64)) for k in range(max(1, -(-n // 64)))]
    got = packing.fill(packing.pack_sizes(df.select("doc_id", "n"), capacity=64), 64).first()
    assert got.n_containers == len(held) and got.n_tokens == sum(held.values())
    assert packing.pack_sizes(df.limit(0).select("doc_id", "n")).count() == 0


def test_most_tokens_go_through_patterns():
    rng = np.random.RandomState(3)
    lengths = np.clip(np.exp(rng.normal(5.3, 0.9, 20_000)).astype(int), 1, 2048)
    counts, fitted = np.bincount(lengths, minlength=2049), []
    packing.plan(counts, fitted_runs=fitted)
    assert sum(t * sum(held) for t, held in fitted) > 0.9 * lengths.sum()

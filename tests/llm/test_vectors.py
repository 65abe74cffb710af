import numpy as np
import pytest

from phrasewerk.llm import vectors

SCHEMA = "entry_id long, phrase_vector array<float>, cosine string, list string"


def brute(ids, x, k, least=None):
    """{id: [(other, cosine)]} over distinct ids."""
    ids, where = np.unique(ids, return_index=True)
    x = vectors.unit(np.asarray(x, np.float32)[where]).astype(np.float64)
    s = x @ x.T
    out = {}
    for i, own in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out[int(own)] = [(int(ids[j]), s[i, j]) for j in order if least is None or s[i, j] >= least]
    return out


def grouped(n, seed=3, groups=12):
    rng = np.random.RandomState(seed)
    centres = vectors.unit(rng.randn(groups, 64))
    x = centres[rng.randint(groups, size=n)] + 0.06 * rng.randn(n, 64)
    for i in range(0, n - 1, 5):
        x[i + 1] = x[i] + 0.01 * rng.randn(64)
    return x * rng.choice([0.5, 1, 4], size=n)[:, None]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v], "clash", "clash") for i, v in zip(ids, x)], SCHEMA).repartition(3)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 60)
    x = grouped(1500)
    df = frame(spark, range(1, 1501), x)
    truth = brute(np.arange(1, 1501), x, 5)
    got = vectors.most_similar(df).collect()
    want = {(a, b) for a, os in truth.items() for b, _ in os}
    assert len({(r.entry_id, r.other) for r in got} & want) >= 0.95 * len(want)
    assert {r.entry_id for r in got} == set(truth) and all(1 <= r["rank"] <= 5 for r in got)
    pairs = {tuple(sorted((a, b))) for a, os in truth.items() for b, c in os if c >= 0.95}
    found = set(map(tuple, vectors.near_pairs(df).collect()))
    assert found <= pairs and len(found) >= 0.98 * len(pairs) > 100


def test_few_rows_odd_vectors_ties_and_repeats(spark):
    a, b = [1.0] + [0.0] * 63, [0.8, 0.6] + [0.0] * 62
    odd = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63]
    df = frame(spark, [4, 2, 9, 7, 7, *range(20, 25)], [a, a, [2 * v for v in a], b, b, *odd])
    got = sorted((r.entry_id, r["rank"], r.other, round(r.cosine, 6)) for r in vectors.most_similar(df, 2).collect())
    assert got == [(2, 1, 4, 1.0), (2, 2, 9, 1.0), (4, 1, 2, 1.0), (4, 2, 9, 1.0), (7, 1, 2, 0.8), (7, 2, 4, 0.8), (9, 1, 2, 1.0), (9, 2, 4, 1.0)]
    assert vectors.most_similar(df.limit(0)).count() == 0
    assert vectors.near_pairs(df.where("entry_id = 7")).count() == 0


@pytest.mark.parametrize("least", [None, 0.95])
def test_many_copies_and_cut_lists(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "MANY_COPIES", 30)
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "LIST_ROWS", 100)
    x = grouped(400, 5, 4)
    x[100:250] = x[100]
    got = {}
    for r in vectors.most_similar(frame(spark, range(400), x), 3, least).collect():
        got.setdefault(r.entry_id, {})[r["rank"]] = r.other
    truth = brute(np.arange(400), x, 3, least)
    same = sum([o[i] for i in sorted(o)] == [b for b, _ in truth[a]] for a, o in got.items())
    assert same >= 0.97 * sum(bool(v) for v in truth.values())
    for i in range(110, 250):
        assert [got[i][r] for r in (1, 2, 3)] == [100, 101, 102]


def test_graph_of_lists_holds_its_neighbours_only():
    import tracemalloc

    x = np.random.RandomState(5).randn(3000, 64).astype(np.float32)
    tracemalloc.start()
    g = vectors.ListGraph(x, 3000, rounds=1)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 16e6  # every centroid's order of all others is 72 MB
    s = g.centroids @ g.centroids.T
    for i in range(0, 3000, 500):
        assert set(g.beside[i]) == set(np.argsort(-s[i])[: vectors.BESIDE + 1])

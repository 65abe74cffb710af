from itertools import combinations

import numpy as np
import pytest

from phrasewerk.llm import clusters
from phrasewerk.llm.vectors import unit

ENTRIES = "entry_id long, process_name string, phrase string, phrase_vector array<float>, grp string, size string"
CONFIG = "process_name string, config struct<graph:struct<distance:double,min_size:int>>"


def planted(seed=1):
    """Rows of two processes and the group of each: sizes from 3 (too small) on, and noise."""
    rng = np.random.RandomState(seed)
    rows, truth, i = [], {}, 0
    for p, sizes in (("a", (300, 40, 9, 5, 3)), ("b", (60, 4))):
        for g, n in enumerate(sizes):
            c = unit(rng.randn(1, 64))[0]
            for _ in range(n):
                i += 1
                v = c + rng.randn(64) * 0.07
                rows.append((i, p, f"phrase {i}", [float(x) for x in v * rng.choice([0.5, 1, 4])], "x", "y"))
                if n >= 4:
                    truth[i] = (p, g)
        for _ in range(25):
            i += 1
            rows.append((i, p, None, [float(x) for x in rng.randn(64)], "x", "y"))
    rows += rows[:40] + [(9001, "a", "x", None, "x", "y"), (9002, "a", "x", [0.0] * 64, "x", "y"), (9003, None, "x", [1.0] * 64, "x", "y"), (9004, "a", "x", [1.0], "x", "y")]
    return rows, truth


def config(spark):
    return spark.createDataFrame([("a", ((0.7, 4),)), ("b", ((None, None),))], CONFIG)


@pytest.mark.parametrize("part", [10_000, 90, 25])
def test_planted_groups(spark, monkeypatch, part):
    monkeypatch.setattr(clusters, "PART", part)  # several rounds, and edges across parts
    monkeypatch.setattr(clusters, "PROBES", 7)
    rows, truth = planted()
    df = spark.createDataFrame(rows, ENTRIES).repartition(3)
    members = clusters.groups(df, config(spark)).cache()
    got = {r.entry_id: (r.process_name, r.grp, r["size"]) for r in members.collect()}
    assert set(got) == set(truth)
    by = {}
    for i, (p, g) in truth.items():
        by.setdefault((p, g), []).append(i)
    for (p, _), ids in by.items():
        assert {got[i] for i in ids} == {(p, got[ids[0]][1], len(ids))}
    assert len({g for _, g, _ in got.values()}) == len(by)
    probes = spark.createDataFrame([(i, "a") for i in [*range(295, 345), 9001, 9999]], "entry_id long, process_name string")
    pairs = set(map(tuple, clusters.probe_pairs(members, probes).collect()))
    assert pairs == {(a, b) for a, b in combinations(range(295, 345), 2) if truth.get(a) and truth.get(a) == truth.get(b)}
    described = clusters.described(members).collect()
    assert sorted(r["size"] for r in described) == [4, 5, 9, 40, 60, 300]
    assert all(len(r.phrases) == 3 and truth[r.medoid] for r in described)


def test_blocks_of_directions(spark, monkeypatch):
    monkeypatch.setattr(clusters, "DIRECTIONS", 64)  # blocks of one
    rows, truth = planted(2)
    got = {r.entry_id for r in clusters.groups(spark.createDataFrame(rows, ENTRIES), config(spark)).collect()}
    assert got == set(truth)


def test_groups_of_one_if_the_size_allows(spark):
    rows = [(1, "a", "x", [1.0] + [0.0] * 63, "x", "y"), (2, "a", "y", [0.0, 1.0] + [0.0] * 62, "x", "y")]
    one = spark.createDataFrame([("a", ((0.7, 1),))], CONFIG)
    assert sorted((r.entry_id, r["size"]) for r in clusters.groups(spark.createDataFrame(rows, ENTRIES), one).collect()) == [(1, 1), (2, 1)]


def test_close_groups_stay_apart(spark):
    """Directions with a cosine of 0.6, one group much larger than the other."""
    rng = np.random.RandomState(5)
    c = unit(rng.randn(1, 64))[0]
    d = rng.randn(64)
    d = unit((d - d @ c * c)[None, :])[0] * 0.8 + c * 0.6
    rows, truth, i = [], {}, 0
    for g, (m, n) in enumerate(((c, 400), (d, 6))):
        for _ in range(n):
            i += 1
            rows.append((i, "a", "x", [float(v) for v in unit((m + rng.randn(64) * 0.08)[None, :])[0]], "x", "y"))
            truth[i] = g
    got = {r.entry_id: r.grp for r in clusters.groups(spark.createDataFrame(rows, ENTRIES), config(spark)).collect()}
    assert set(got) == set(truth)
    assert len({(truth[k], g) for k, g in got.items()}) == 2 == len(set(got.values()))


def test_nothing_to_group(spark):
    rows, _ = planted()
    df = spark.createDataFrame(rows, ENTRIES)
    assert clusters.groups(df.limit(0), config(spark)).count() == 0
    assert clusters.groups(df.where("entry_id in (1, 400, 9001)"), config(spark)).count() == 0


def test_pairs_by_chance_do_not_meet_all_rows(spark, monkeypatch):
    """Pairs that belong to no group are directions only for the rows that are in none: their number grows as the square of the rows."""
    met, recomputed = [], clusters._recomputed

    def counted(rows, parts, found):
        met.append((rows, found.count()))
        return recomputed(rows, parts, found)

    monkeypatch.setattr(clusters, "_recomputed", counted)
    rng = np.random.RandomState(3)
    rows = []
    for n in (60, 60, *[2] * 40):
        c = unit(rng.randn(1, 64))[0]
        rows += [(len(rows) + k, "a", "x", [float(x) for x in c + rng.randn(64) * 0.04], "x", "y") for k in range(n)]
    got = {r.entry_id: r["size"] for r in clusters.groups(spark.createDataFrame(rows, ENTRIES), config(spark)).collect()}
    assert got == dict.fromkeys(range(120), 60)
    assert max(n for of, n in met if of is met[0][0]) == 2

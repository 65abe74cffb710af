import math
import random

import numpy as np
import pytest

from phrasewerk.operators import graph as G
from phrasewerk.operators import metrics as M
from phrasewerk.operators import pairs as R
from phrasewerk.operators import provenance as V


def graph(seed, n=30, m=40):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = sorted(rng.sample(range(n), 2))
        edges[(a, b)] = rng.randrange(1, 9) / 8
    return list(range(n)), [("g", a, b, w) for (a, b), w in edges.items()]


def frames(spark, nodes, edges):
    return spark.createDataFrame([("g", i, f"l{i}") for i in nodes], "graph_id string, node_id long, label string"), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")


def parts(nodes, edges):
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for _, a, b, _ in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("m, part", [(12, 200_000), (40, 200_000), (40, 9), (12, 3)])
def test_components_and_forest(spark, monkeypatch, m, part):
    monkeypatch.setattr(G, "PART_EDGES", part)  # several parts, and graphs that fit none
    nodes, edges = graph(m, m=m)
    n, e = frames(spark, nodes, edges)
    assert {r.node_id: r.component for r in G.components(n, e).collect()} == parts(nodes, edges)
    got = {(r.src, r.dst) for r in G.spanning_forest(n, e).collect()}
    want, held = set(), []
    for x in sorted(edges, key=lambda x: (-x[3], x[1], x[2])):
        p = parts(nodes, held)
        if p[x[1]] != p[x[2]]:
            held.append(x)
            want.add((x[1], x[2]))
    assert got == want


def test_simplified_stays_connected(spark):
    nodes, edges = graph(5, 20, 50)
    n, e = frames(spark, nodes, edges)
    kept_nodes, kept = G.simplified(n, e, 0.6)
    ids, kept = {r.node_id for r in kept_nodes.collect()}, [("g", r.src, r.dst, r.weight) for r in kept.collect()]
    assert len({c for i, c in parts(nodes, kept).items() if i in ids}) == 1
    assert len(edges) - int(0.6 * len(edges)) <= len(kept) < len(edges)


@pytest.mark.parametrize("part", [200_000, 3])
def test_page_rank_sums_to_one_and_matches_the_matrix(spark, monkeypatch, part):
    monkeypatch.setattr(G, "PART_EDGES", part)  # in one task, and in rounds of joins
    nodes, edges = graph(2, 12, 14)
    n, e = frames(spark, nodes, edges)
    got = {r.node_id: r["rank"] for r in G.page_rank(n, e, rounds=10).collect()}
    a = np.zeros((12, 12))
    for _, i, j, w in edges:
        a[i, j] = a[j, i] = w
    rank = np.full(12, 1 / 12)
    out = a.sum(1)
    for _ in range(10):
        flow = np.where(out > 0, rank / np.where(out > 0, out, 1), 0) @ a + rank[out == 0].sum() / 12
        rank = 0.15 / 12 + 0.85 * flow
    assert [got[i] for i in range(12)] == pytest.approx(rank.tolist(), abs=1e-9)


def test_significance(spark):
    edges = [("g", 0, 1, 0.9), ("g", 1, 2, 0.5), ("g", 0, 2, 0.7)]
    e = spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")
    s = {0: 160, 1: 140, 2: 120}
    for r in G.significances(e).collect():
        n, k, p = 210, round(r.weight * 100), min(1, s[r.src] * s[r.dst] / (2 * 210 * 210))
        tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
        assert r.significance == pytest.approx(min(G.MOST, -math.log(tail)), rel=1e-6, abs=1e-9)
    with pytest.raises(ValueError):
        G.significances(spark.createDataFrame([("g", 1, 1, 0.5)], "graph_id string, src long, dst long, weight double"))


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.RandomState(1)
    x = rng.randn(40, 5)
    rows = [(i, i % 2, [float(v) for v in x[i]], "y") for i in range(40)] + [(99, 0, None, "y"), (98, 0, [0.0] * 5, "y"), (0, 0, [float(v) for v in x[0]], "y"), (97, None, [1.0] * 5, "y")]
    df = spark.createDataFrame(rows, "id long, cluster_id long, embedding array<double>, cosine string")
    got = {(r.src, r.dst): r.cosine for r in R.similar_pairs(df, 0.3).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {(i, j): u[i] @ u[j] for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and u[i] @ u[j] >= 0.3}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.similar_pairs(df.limit(0), 0.3).count() == 0


def test_merge_chain_ends_at_the_survivor(spark):
    nodes = spark.createDataFrame([("g", i, n) for i, n in ((1, 1), (2, 5), (3, 9), (4, 9))], "graph_id string, node_id long, n_documents long")
    similar = spark.createDataFrame([("g", 1, 2, 1.0), ("g", 2, 3, 0.96), ("g", 3, 4, 0.5)], "graph_id string, src long, dst long, similarity double")
    assert sorted((r.removed, r.kept) for r in R.merged_phrases(similar, nodes).collect()) == [(1, 3), (2, 3)]


def test_provenance(spark):
    schema = f"id long, documents {V.DOCUMENTS}"
    old = spark.createDataFrame([(1, [("a", [[1, 2]])]), (2, None)], schema)
    new = spark.createDataFrame([(1, [("a", [[1, 2], [3, 4]]), ("b", [[5, 6]])])], schema)
    got = {r.id: [(d.id, d.offsets) for d in r.documents] for r in V.merged(old, new, "id").collect()}
    assert got == {1: [("a", [[1, 2], [3, 4]]), ("b", [[5, 6]])], 2: []}
    assert [r.id for r in V.holding(new, "b", "id").collect()] == [1]
    back = {r.id: [d.id for d in r.documents] for r in V.without(V.merged(old, new, "id"), "b").collect()}
    assert back == {1: ["a"], 2: []}
    assert {r.id for r in V.without(old, "a", drop_empty=True).collect()} == {2}


def test_metrics(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b"), (1, None)], "cluster int, label string")
    assert M.purity(df, "cluster", "label").first()[0] == 0.75
    same = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b")], "cluster int, label string")
    assert M.adjusted_rand(same, "cluster", "label").first()[0] == 1.0
    assert M.purity(df.limit(0), "cluster", "label").first()[0] is None
    s = spark.createDataFrame([("x", 0.5), ("x", 1.0), ("y", 0.0)], "c string, score double")
    assert {r.c: round(r.fused, 6) for r in M.harmonic(s, ["c"]).collect()} == {"x": round(2 * 0.75 * 2 / 2.75, 6), "y": 0.0}


def plain_similarity(a, b, added=0.05):
    """By the recurrence itself."""
    a, b = (" ".join(sorted("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower() if c.isascii()).split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        row, old = [0], row
        for j, d in enumerate(b):
            row.append(old[j] + 1 if c == d else max(row[-1], old[j + 1]))
    return (round(200.0 * row[-1] / (len(a) + len(b))) if a and b else 0.0) / 100 + added


def labelled(spark):
    rng = random.Random(4)
    words = ["Bruch", "brüche", "Leber", "lebern", "Hüfte", "links", "rechts", "akut", "akute", "Grad", "2"]
    labels = [" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(40)] + ["", "---", None, "x" * 70, "x" * 68 + "yz", "ab" * 32]
    rows = [("g" if i % 7 else "h", i, x, [rng.gauss(0, 1) for _ in range(4)] if i != 5 else [0.0] * 4) for i, x in enumerate(labels)]
    return rows, spark.createDataFrame(rows, "graph_id string, node_id long, label string, v array<double>")


def met(rows):
    return [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] is not None and b[2] is not None]


def test_weighted_pairs_keep_low_cosines(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 9)
    rows, df = labelled(spark)
    got = {(r.src, r.dst): r.weight for r in R.weighted_pairs(df, 0.5, 0.6, "node_id", "graph_id", "v").collect()}
    cos = lambda x, y: float(np.float32(x) @ np.float32(y) / np.sqrt((np.float32(x) @ np.float32(x)) * (np.float32(y) @ np.float32(y))))
    every = {(a[1], b[1]): (0.5 * plain_similarity(a[2], b[2]) + 0.5 * cos(a[3], b[3]), cos(a[3], b[3])) for a, b in met(rows) if any(a[3]) and any(b[3])}
    want = {k: w for k, (w, _) in every.items() if w >= 0.6}
    assert got == pytest.approx(want, abs=1e-6)
    assert sum(every[k][1] < 0.9 for k in got) > 10


def test_close_labels_need_no_cosine(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 9)
    rows, df = labelled(spark)
    for least in (0.95, 0.5):
        got = {(r.src, r.dst): r.similarity for r in R.close_labels(df, least, "node_id", "graph_id").collect()}
        want = {(a[1], b[1]): s for a, b in met(rows) if (s := plain_similarity(a[2], b[2])) >= least}
        assert got == pytest.approx(want) and len(got) > 3


def test_graph_queries_take_pairs_of_low_cosine(spark, tmp_path):
    from phrasewerk.plans import graph_queries as Q

    doc = "array<struct<id:string,offsets:array<array<int>>>>"
    rows = [(1, "p", "akute Leberzyste links", [1.0, 0.0], [("a", [[0, 3]])], ["0"]), (2, "p", "akute Leberzysten links", [0.4, 0.9], [("a", [[9, 12]]), ("b", [[0, 3]])], ["0", "0"])]
    spark.createDataFrame(rows, f"entry_id long, process_name string, phrase string, phrase_vector array<float>, documents {doc}, graph_cluster array<string>").write.parquet(str(tmp_path / "vector_entries.parquet"))
    assert [(r.src, r.dst) for r in Q.gr01_phrase_graph(spark, str(tmp_path)).collect()] == [(1, 2)]
    assert [(r.removed, r.kept) for r in Q.gr02_merged_phrases(spark, str(tmp_path)).collect()] == [(1, 2)]


@pytest.mark.parametrize("part", [200_000, 3])
def test_page_rank_goes_on_until_it_converges(spark, monkeypatch, part):
    monkeypatch.setattr(G, "PART_EDGES", part)
    n = 9
    nodes, edges = list(range(n)), [("g", i, i + 1, 1.0 if i % 2 else 0.05) for i in range(n - 2)] + [("g", 0, n - 1, 0.0)]
    a = np.zeros((n, n))
    for _, i, j, w in edges:
        a[i, j] = a[j, i] = w
    out = a.sum(1)
    share = np.where(out[:, None] > 0, a / np.where(out > 0, out, 1)[:, None], 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * share.T, np.full(n, 0.15 / n))
    got = {r.node_id: r["rank"] for r in G.page_rank(*frames(spark, nodes, edges), tolerance=0.01).collect()}
    assert sum(abs(got[i] - want[i]) for i in range(n)) < 0.01 * 0.85 / 0.15


def test_links_weigh_by_scaled_tf_idf(spark):
    from phrasewerk.operators.phrases import scaled_tf_idf

    counts = [("g", 0, 0, 2), ("g", 0, 1, 1), ("g", 1, 1, 1), ("g", 2, 0, 1), ("g", 2, 1, 3), ("h", 0, 0, 1), ("h", 1, 0, 1)]
    got = {(r.g, r.d, r.p): r.scaled for r in scaled_tf_idf(spark.createDataFrame(counts, "g string, d long, p long, tf long"), spark.createDataFrame([("g", 3), ("h", 3)], "g string, n_documents long"), "g", "d", "p").collect()}
    want = {}
    for g in "gh":
        m = np.zeros((3, 2))
        for x, d, p, tf in counts:
            m[d, p] += tf * (x == g)
        m *= np.log(4 / (1 + (m > 0).sum(0))) + 1
        m /= np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]
        m = (m - m.min(0)) / np.where(m.max(0) > m.min(0), m.max(0) - m.min(0), 1)
        want |= {(x, d, p): m[d, p] for x, d, p, _ in counts if x == g}
    assert got == pytest.approx(want)


def test_log_tails():
    from fractions import Fraction

    cases = [(k, n, p) for n in (1, 7, 60, 400) for k in range(0, n + 2, max(1, n // 7)) for p in (0.0, 1e-4, 0.03, 0.5, 0.97, 1.0)]
    k, n, p = (np.array(x, float) for x in zip(*cases))
    for got, (a, b, q) in zip(G.log_tails(k, n, p), cases):
        x = Fraction(q)
        tail = sum((math.comb(b, j) * x**j * (1 - x) ** (b - j) for j in range(a, b + 1)), Fraction(0))
        assert math.exp(got) == pytest.approx(float(tail), rel=1e-9, abs=1e-300)
    assert np.isnan(G.log_tails(np.array([np.nan]), np.array([3.0]), np.array([0.5])))[0]


def test_double_edges_are_refused_and_directed_chances_are_larger(spark):
    schema = "graph_id string, src long, dst long, weight double"
    with pytest.raises(ValueError):
        G.significances(spark.createDataFrame([("g", 1, 2, 0.5), ("g", 2, 1, 0.5)], schema))
    e = spark.createDataFrame([("g", 0, 1, 0.9), ("g", 1, 2, 0.5), ("g", 0, 2, 0.7)], schema)
    one, two = ({(r.src, r.dst): r.significance for r in G.significances(e, directed=d).collect()} for d in (False, True))
    assert all(two[k] < one[k] for k in one)


def test_path_scores_against_brute_force(spark):
    nodes, edges = graph(3, 9, 14)
    _, e = frames(spark, nodes, edges)
    holders = [("g", i, f"d{i % 4}") for i in nodes if i % 3] + [("g", 1, "d0")]
    w = {(a, b): x for _, a, b, x in edges} | {(b, a): x for _, a, b, x in edges}
    want = {}
    for a in nodes:
        for b in nodes:
            if a < b:
                paths = [w[a, b]] if (a, b) in w else [(w[a, m] + w[m, b] / 1.5) / 2 for m in nodes if (a, m) in w and (m, b) in w]
                for d in {d for _, i, d in holders if i in (a, b)}:
                    if paths:
                        want[d] = want.get(d, 0) + sum(paths)
    got = {r.document: r.score for r in G.path_scores(e, spark.createDataFrame(holders, "graph_id string, node_id long, document string")).collect()}
    assert got == pytest.approx(want)


def test_unrolled_is_a_tree_joined_by_the_reference(spark):
    nodes = list(range(8))
    heavy = [("g", 0, 1, 0.9), ("g", 1, 2, 0.8), ("g", 0, 2, 0.7), ("g", 3, 4, 0.9), ("g", 5, 6, 0.9)]
    n, e = frames(spark, nodes, heavy)
    _, ref = frames(spark, nodes, heavy + [("g", 2, 3, 0.4), ("g", 1, 4, 0.5), ("g", 6, 7, 0.9)])
    own, tree = G.unrolled(n, e, ref)
    assert {r.node_id for r in own.collect()} == {0, 1, 2, 3, 4, 5, 6}
    assert {(r.src, r.dst) for r in tree.collect()} == {(0, 1), (1, 2), (3, 4), (5, 6), (1, 4)}


def test_exemplars_and_sub_clusters(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.randn(6, 2) * 0.1 + c for c in ([0, 0], [5, 5], [0, 9])])
    owner = G.exemplars(-((x[:, None] - x[None]) ** 2).sum(2), 0.6, 300)
    assert len({(owner[i], i // 6) for i in range(18)}) == 3
    labels = ["leber rechts", "leber links", "leber mitte", "knie rechts oben", "knie links oben", "knie mitte oben"]
    n = spark.createDataFrame([("g", i, x) for i, x in enumerate(labels)], "graph_id string, node_id long, label string")
    e = spark.createDataFrame([("g", a, b, 0.9) for a in range(6) for b in range(a + 1, 6) if (a < 3) == (b < 3)], "graph_id string, src long, dst long, weight double")
    nodes, edges = G.sub_clusters(n, e.where("src <> 0"), e, tries=5)
    roots = {r.node_id for r in nodes.where("root").collect()}
    members = {(r.src, r.dst): r.weight for r in edges.where("sub_cluster").collect()}
    assert len(roots) == 2 and len(members) == 4 and set(members.values()) == {0.9}
    assert all((a < 3) == (b < 3) and (a in roots or b in roots) for a, b in members)


def test_communities_and_their_scores(spark):
    m = np.zeros((6, 6))
    for a, b, w in ((0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.9), (3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.9), (2, 3, 0.2)):
        m[a, b] = m[b, a] = w
    part = G.communities(m)
    assert len(set(part[:3])) == 1 == len(set(part[3:])) and part[0] != part[3]
    n, e = frames(spark, list(range(6)), [("g", int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(np.triu(m)))])
    holders = spark.createDataFrame([("g", 0, "x"), ("g", 5, "y")], "graph_id string, node_id long, document string")
    got = {r.document: r.score for r in G.community_scores(n, e, holders).collect()}
    assert got == pytest.approx({d: 4 * 0.9 / np.e for d in "xy"})


def test_concept_graphs_end_to_end(spark):
    from phrasewerk.operators import phrase_graphs as H

    rng = np.random.RandomState(2)
    centre = {"a": rng.randn(8), "b": rng.randn(8)}
    rows = []
    for g in "ab":
        for i in range(7):
            rows.append((g, i + 10 * (g == "b"), f"{'leber' if g == 'a' else 'knie'} {chr(97 + i) * 4} befund", [float(v) for v in centre[g] + 0.2 * rng.randn(8)], [(f"d{i}", [[i, i + 3]])]))
    rows.append(("a", 99, "leber aaaa befunde", [float(v) for v in centre["a"]], [("d0", [[1, 2]]), ("d7", [[4, 9]])]))
    rows.append(("a", 98, "fern", [float(-v) for v in centre["a"]], None))
    rows.append(("c", 97, "allein", [1.0] * 8, None))
    schema = f"graph_id string, node_id long, label string, embedding array<float>, documents {V.DOCUMENTS}"
    nodes, edges = H.concept_graphs(spark.createDataFrame(rows, schema), H.GraphSettings(cluster_min_size=2))
    nodes, edges = nodes.collect(), edges.collect()
    assert {r.graph_id: r.graph_no for r in edges} == {"a": 0, "b": 1}
    for g in "ab":
        ids = {r.node_id for r in nodes if r.graph_id == g}
        assert len([r for r in edges if r.graph_id == g]) == len(ids) - 1  # a tree
    kept = {r.node_id: r for r in nodes}
    assert 98 not in kept and 0 not in kept  # far from the centre; merged into the phrase with more documents
    assert {d.id: d.offsets for d in kept[99].documents} == {"d0": [[0, 3], [1, 2]], "d7": [[4, 9]]}
    with pytest.raises(ValueError):
        H.GraphSettings(graph_simplify_alg="degree")
    empty = H.concept_graphs(spark.createDataFrame([], schema))
    assert empty[0].count() == 0 == empty[1].count()

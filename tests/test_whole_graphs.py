import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators import graph as G
from phrasewerk.operators import pairs as R
from phrasewerk.operators import phrase_graphs as H
from phrasewerk.operators import whole_graphs as W
from phrasewerk.plans import catalog


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(3)
    words = ["zyste", "leber", "links", "rechts", "fraktur", "becken"]
    rows = [(rng.choice("gh"), i, " ".join(rng.sample(words, 2)) if i % 9 else None, [rng.random() + (j == 0) for j in range(3 + (i % 11 == 0))] if i % 7 else None,
             [(rng.choice(["a", "b", "c", "d", None]),) for _ in range(rng.randrange(4))] if i % 5 else None) for i in range(40)]
    return spark.createDataFrame(rows, "graph_id string, node_id long, label string, embedding array<float>, documents array<struct<id:string>>")


def edges_of(members, cut_off):
    return R.weighted_pairs(members, 0.5, cut_off, "node_id", "graph_id").select("graph_id", "src", "dst", "weight")


def holders_of(members):
    return members.select("graph_id", "node_id", F.explode("documents.id").alias("document")).where("document is not null").distinct()


def rounded(df, *keys, value="score"):
    return {tuple(r[k] for k in keys): round(r[value], 9) for r in df.collect()}


@pytest.mark.parametrize("at_once", [1_000, 7])
def test_path_scores(members, monkeypatch, at_once):
    monkeypatch.setattr(W, "AT_ONCE", at_once)
    want = rounded(G.path_scores(edges_of(members, 0.75), holders_of(members)), "document", "graph_id")
    assert len(want) > 4 and rounded(W.path_scores(members, 0.5, 0.75), "document", "graph_id") == want


def test_community_scores(members):
    nodes = members.where("exists(embedding, x -> x <> 0)").select("graph_id", "node_id")
    usable = members.where("exists(embedding, x -> x <> 0)")
    want = rounded(G.community_scores(nodes, edges_of(members, 0.55), holders_of(usable)), "document", "graph_id")
    assert len(want) > 4 and rounded(W.community_scores(members, 0.5, 0.55), "document", "graph_id") == want


@pytest.mark.parametrize("n", [3, 30, 60])
def test_neighbourhoods(n):
    rng = np.random.RandomState(n)
    m = np.where(rng.rand(n, n) < 0.4, rng.choice([0.6, 0.7, 0.75, 0.9, 1.0, 1.02], (n, n)), 0)
    m = np.triu(m, 1) + np.triu(m, 1).T
    length = np.where(m > 0, np.maximum(1 - m, 0), np.inf)
    np.fill_diagonal(length, 0)
    for k in range(n):
        length = np.minimum(length, length[:, k][:, None] + length[k][None, :])
    a, b, worth = G.neighbourhoods(m, 0.5)
    assert set(zip(a, b)) == set(zip(*np.nonzero((length <= 0.5) & (length > 0)))) and (worth >= 0).all()


def test_page_rank(members):
    nodes = members.where("exists(embedding, x -> x <> 0)").select("graph_id", "node_id")
    want = rounded(G.page_rank(nodes, edges_of(members, 0.75), tolerance=1e-12), "graph_id", "node_id", value="rank")
    assert len(want) > 20 and rounded(W.page_rank(members, 0.5, 0.75, tolerance=1e-12), "graph_id", "node_id", value="rank") == want


def test_page_rank_of_documents(spark, members):
    rng = random.Random(5)
    rows = [(g, n, d, rng.choice([0.0, rng.random()])) for g, n in {(r.graph_id, r.node_id) for r in members.collect()} for d in range(4) if rng.random() < 0.3]
    links = spark.createDataFrame(rows, "graph_id string, node_id long, document long, weight double")
    nodes = members.where("exists(embedding, x -> x <> 0)").select("graph_id", "node_id")
    held = links.join(nodes, ["graph_id", "node_id"], "left_semi")
    want = rounded(G.page_rank_scores(nodes, edges_of(members, 0.75), held, tolerance=1e-12), "document", "graph_id")
    assert len(want) > 5 and rounded(W.page_rank_scores(members, links, 0.5, 0.75, tolerance=1e-12), "document", "graph_id") == want


@pytest.mark.parametrize("name", ["gr14_path_scores", "gr10_page_rank", "gr16_page_rank_scores", "gr15_community_scores", "gr12_sub_clusters", "gr05_concept_graphs", "gr17_document_concept_matrix"])
def test_queries_store_no_edges(spark, monkeypatch, name):
    def none(*args, **more):
        raise AssertionError("edges are made")

    whole = {r for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(W, "WHOLE", 20)  # some graphs go by tables of edges
    mixed = {r for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert len(whole) > 3 and len(mixed) == len(whole)
    monkeypatch.setattr(W, "WHOLE", 4_000)
    monkeypatch.setattr(R, "weighted_pairs", none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == len(whole)


def test_ratios_of_labels_as_they_are(monkeypatch):
    rng = random.Random(1)
    labels = ["".join(rng.choice("aäöB c😀\0-") for _ in range(rng.randrange(90))) for _ in range(30)] + ["", ""]
    want = np.array([[T.sequence_ratio_of(x, y) for y in labels] for x in labels])
    assert (R.ratios(labels) == want).all()
    monkeypatch.setattr(R, "BLOCK", 13)
    assert (R.ratios(labels) == want).all() and R.ratios([]).shape == (0, 0)


@pytest.mark.parametrize("cached", [32_768, 100])
def test_sub_cluster_sizes(members, monkeypatch, cached):
    monkeypatch.setattr(G, "CACHED", cached)  # some rows at a time
    nodes = members.where("exists(embedding, x -> x <> 0)").select("graph_id", "node_id", "label")
    edges = edges_of(members, 0.55)
    roots, links = G.sub_clusters(nodes, edges, edges, tries=5)
    to = {(r.graph_id, n) for r in links.where("sub_cluster").collect() for n in [(r.src, r.dst)]}
    want = {(r.graph_id, r.node_id): sum(g == r.graph_id and r.node_id in n for g, n in to) for r in roots.where("root").collect()}
    got = {(r.graph_id, r.node_id): r.n_members for r in W.sub_cluster_sizes(members, 0.5, 0.55, tries=5).collect()}
    assert len(want) > 2 and got == want


@pytest.mark.parametrize("by", ["weight", "significance"])
@pytest.mark.parametrize("gamma", [0.5, 0.9, 1])
def test_trees(members, by, gamma):
    settings = H.GraphSettings(graph_weight_cut_off=0.6, graph_simplify=gamma, graph_simplify_alg=by)
    usable = members.where("exists(embedding, x -> x <> 0)")
    edges = R.weighted_pairs(usable, 0.5, 0.6, "node_id", "graph_id")
    cols = ["weight", "cosine"] + ["significance"] * (by == "significance")
    told = lambda df: {(r.graph_id, r.src, r.dst): tuple(round(r[c], 9) for c in cols) for r in df.collect()}
    want = told(H.post_processed(usable.select("graph_id", "node_id", "label"), edges, settings)[1])
    assert len(want) > 15 and told(W.trees(members, 0.5, 0.6, gamma, by)) == want


@pytest.mark.parametrize("n", [1, 12, 40])
def test_heaviest_forest_with_ties(n):
    rng = np.random.RandomState(n)
    w = np.triu(np.where(rng.rand(n, n) < 3 / n, rng.choice([0.6, 0.7, 0.9], (n, n)), 0), 1)
    p, q = np.nonzero(w)
    order = np.lexsort((q, p, -w[p, q]))
    want = {(p[e], q[e]) for e in order[G._forest(p[order], q[order])[2]]}
    assert {divmod(c, n) for c in W._heaviest(w + w.T)} == want


def test_concept_graphs_of_either_size(members, monkeypatch):
    settings = H.GraphSettings(graph_weight_cut_off=0.6, cluster_distance=0.0)
    members = members.withColumn("documents", F.expr("transform(documents, x -> struct(x.id as id, cast(array() as array<array<int>>) as offsets))")).where("size(embedding) = 3")
    told = lambda: [{tuple(r[c] for c in cols) for r in df.collect()} for df, cols in zip(H.concept_graphs(members, settings), (["graph_id", "node_id"], ["graph_no", "src", "dst"]))]
    whole = told()
    monkeypatch.setattr(W, "WHOLE", 15)
    assert len(whole[0]) > 10 and told() == whole
    monkeypatch.setattr(W, "WHOLE", 0)
    assert told() == whole


def test_members_are_shuffled_without_what_they_hold(spark, tmp_path):
    """An entry delivered twice counts once, and only such entries' vectors meet."""
    from phrasewerk.plans import graph_queries as Q

    schema = spark.read.parquet("/root/testdata/sf0.001/vector_entries.parquet").schema
    row = lambda p, i, phrase: tuple({"process_name": p, "entry_id": i, "phrase": phrase, "phrase_vector": [1.0, 2.0], "graph_cluster": ["0", "1", "0"]}.get(f.name) for f in schema)
    rows = [row("p", 1, "b"), row("p", 1, "a"), row("q", 1, "c"), row(None, 2, "d"), row(None, 2, "e"), row("p", None, "f"), row("p", None, "f")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "vector_entries.parquet"))
    got = Q._members(spark, str(tmp_path))
    assert sorted((r.graph_id, r.node_id or 0, r.label) for r in got.collect()) == [("0", 2, "d"), ("1", 2, "d"), ("p/0", 0, "f"), ("p/0", 1, "a"), ("p/1", 0, "f"), ("p/1", 1, "a"), ("q/0", 1, "c"), ("q/1", 1, "c")]
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()

import random

import pytest

from phrasewerk.operators import graph as G
from phrasewerk.operators import pairs as R


@pytest.mark.parametrize("block, directed", [(1_500, False), (7, True)])
def test_significances_without_edges(spark, monkeypatch, block, directed):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "TAILS", 10)
    rng = random.Random(4)
    words = ["zyste", "leber", "links", "rechts", "fraktur", "becken"]
    rows = [(rng.choice("gh"), i, " ".join(rng.sample(words, 2)) if i % 9 else None, [rng.random() + (j == 0) for j in range(3 + (i % 11 == 0))] if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "g string, id long, label string, embedding array<float>")
    edges = R.weighted_pairs(spark.createDataFrame(rows, df.schema), 0.5, 0.6, "id", "g").withColumnRenamed("g", "graph_id")
    want = {(r.graph_id, r.src, r.dst): round(r.significance, 6) for r in G.significances(edges, directed=directed).collect()}
    got = [(r.g, r.src, r.dst, round(r.significance, 6)) for r in R.pair_significances(df, 0.5, 0.6, "id", "g", directed=directed).collect()]
    assert len(want) > 20 and len(got) == len(want) and {x[:3]: x[3] for x in got} == want


def test_directed_query_keeps_no_edges(spark, monkeypatch):
    from phrasewerk.plans import catalog

    def none(*args, **more):
        raise AssertionError("edges are made")

    monkeypatch.setattr(R, "weighted_pairs", none)
    assert catalog.QUERIES["sc06_directed_significance"](spark, "/root/testdata/sf0.001").count() > 0


def test_queries_weigh_pairs_of_small_graphs_once(spark, monkeypatch):
    from phrasewerk.operators import whole_graphs as W
    from phrasewerk.plans import catalog

    def twice(*args, **more):
        raise AssertionError("pairs are weighed twice")

    run = lambda: sorted(catalog.QUERIES["sc06_directed_significance"](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(W, "SPREAD", 10)  # some graphs go by blocks
    mixed = run()
    monkeypatch.setattr(W, "SPREAD", 2_000)
    monkeypatch.setattr(R, "pair_significances", twice)
    assert len(mixed) > 3 and run() == mixed

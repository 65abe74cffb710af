import random

import pytest
from pyspark.sql import functions as F

from phrasewerk.operators import graph as G
from phrasewerk.operators import pairs as R
from phrasewerk.plans import catalog


@pytest.mark.parametrize("block, at_once", [(1_500, 2_000_000), (7, 5)])
def test_scores_without_edges(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "LOOKED_UP", at_once)
    rng = random.Random(3)
    words = ["zyste", "leber", "links", "rechts", "fraktur", "becken"]
    rows = [(rng.choice("gh"), i, " ".join(rng.sample(words, 2)) if i % 9 else None, [rng.random() + (j == 0) for j in range(3 + (i % 11 == 0))] if i % 7 else None,
             [(rng.choice(["a", "b", "c", "d", None]),) for _ in range(rng.randrange(4))] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id long, label string, embedding array<float>, documents array<struct<id:string>>")
    holders = df.select(F.col("g").alias("graph_id"), F.col("id").alias("node_id"), F.explode("documents.id").alias("document")).where("document is not null").distinct()
    edges = R.weighted_pairs(df, 0.5, 0.6, "id", "g").withColumnRenamed("g", "graph_id")
    want = {(r.document, r.graph_id): round(r.score, 9) for r in G.document_scores(edges, holders).collect()}
    got = {(r.document, r.g): round(r.score, 9) for r in R.document_scores(df, 0.5, 0.6, "id", "g").collect()}
    assert len(want) > 4 and got == want


@pytest.mark.parametrize("name", ["gr13_document_scores", "ag06_row_normalised"])
def test_queries_keep_no_edges(spark, monkeypatch, name):
    def none(*args, **more):
        raise AssertionError("edges are made")

    monkeypatch.setattr(R, "weighted_pairs", none)  # written or shuffled edges are what did not fit the disk
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

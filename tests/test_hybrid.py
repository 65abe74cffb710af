from phrasewerk.operators import retrieval as R
from phrasewerk.plans import catalog


def test_fused(spark):
    lexical = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (2, 10, 0.0), (None, 1, 1.0)], "q int, k int, lexical double")
    dense = spark.createDataFrame([(1, 11, 0.5), (1, 12, -0.2), (3, 10, -1.0)], "q int, k int, dense double")
    got = {(r.q, r.k): (round(r.score, 9), r["rank"]) for r in R.fused(lexical, dense, "k", "q", 0.6).collect()}
    assert got == {(1, 11): (0.8, 1), (1, 10): (0.4, 2), (1, 12): (0.0, 3), (2, 10): (0.0, 1), (3, 10): (0.0, 1)}
    assert R.fused(lexical, dense, "k", "q", 0.6, 2).count() == 4


def test_a_plan_has_each_side_once(spark):
    plan = catalog.QUERIES["rg07_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # texts and questions

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasewerk.operators import phrases as P
from phrasewerk.plans import catalog, graph_queries


@pytest.mark.parametrize("rows", [40_000, 5])
def test_scores_within_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "DOCUMENT_ROWS", rows)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(g, f"{g}:{rng.randrange(6)}", rng.sample(words, rng.randrange(4))) for g in "abc" for _ in range(12)], "p string, document string, words array<string>")
    weights = spark.createDataFrame([(g, f"{g}/{c}", w, rng.random() + 0.1) for g in "abd" for c in range(4) for w in rng.sample(words, 3)], "p string, graph_id string, word string, tfidf double")
    each = docs.select("document", F.explode("words").alias("w")).select("document", F.concat(F.substring("document", 1, 1), "w").alias("word"))
    want = P.concept_scores(each, weights.select("graph_id", F.concat("p", "word").alias("word"), "tfidf"), "document", "graph_id")
    want = sorted((r.document, r.graph_id, round(r.score, 9)) for r in want.collect())
    got = P.concept_scores_within(docs, weights, {"a": 12, "b": 12, "c": 12}, "p", "document", "graph_id")
    assert len(want) > 20 and sorted((r.document, r.graph_id, round(r.score, 9)) for r in got.collect()) == want


def test_query_joins_no_words(spark, monkeypatch):
    def none(*args, **more):
        raise AssertionError("words are joined")

    monkeypatch.setattr(P, "concept_scores", none)  # its pairs of a word and a concept are what did not fit the disk
    assert catalog.QUERIES["ag08_concept_scores"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("cells, scores, at_once", [(4_000_000, 100_000, 100_000), (20, 5, 4), (1, 1, 1)])
def test_scores_are_made_some_at_a_time(monkeypatch, cells, scores, at_once):
    """A part was scored as a whole: all its sums of a word and a concept, and all its scores, at once."""
    for name, n in (("WEIGHT_CELLS", cells), ("SCORES", scores), ("AT_ONCE", at_once)):
        monkeypatch.setattr(P, name, n)
    rng = random.Random(8)
    rows, want = [], {}
    for g, part in (("a", 0), ("a", 1), ("b", 0), ("d", 0)):  # d has no concepts, b's other part no documents
        concepts = {f"{g}/{c}": {w: rng.random() + 0.1 for w in rng.sample("uvwxyz", rng.randrange(1, 5))} for c in range(7)} if g != "d" else {}
        rows += [(g, part, c, P.BETWEEN.join(ws), P.BETWEEN.join(map(repr, ws.values()))) for c, ws in concepts.items()]
        for k in range(9):
            own = [rng.sample("stuvwxyz", rng.randrange(5)) for _ in range(rng.randrange(1, 6))]
            rows += [(g, part, f"{g}:{part}:{k}", P.BETWEEN.join(ws) if ws else None, None) for ws in own]
            for c, ws in concepts.items():
                if both := {w for x in own for w in x} & set(ws):
                    want[f"{g}:{part}:{k}", c] = round(sum(ws[w] for w in both), 9)
    rows.append(("b", 1, "b/0", "u", "0.5"))
    schema = pa.schema([("g", pa.string()), ("part", pa.int64()), ("k", pa.string()), ("words", pa.string()), ("tfidf", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 4]], schema) for i in range(0, len(rows), 4)]
    out = list(P._scored(iter(batches)))
    got = [r for b in out for r in b.to_pylist()]
    assert len(want) > 50 and len(got) == len(want)
    assert {(r["k"], r["c"]): round(r["score"], 9) for r in got} == want and all(r["k"].startswith(r["g"]) for r in got)
    assert max(len(b) for b in out) <= scores


def test_query_shuffles_no_vectors(spark, monkeypatch):
    def none(*args, **more):
        raise AssertionError("entries are joined with their vectors")

    monkeypatch.setattr(graph_queries, "_members", none)
    found = catalog.QUERIES["ag08_concept_scores"](spark, "/root/testdata/sf0.001")
    assert "CoGroup" not in found._jdf.queryExecution().toString() and found.count() > 0


def test_labels_with_a_slash(spark, tmp_path):
    """The process of a concept was read from its name up to the last slash."""
    kind = "entry_id long, process_name string, phrase string, phrase_vector array<float>, graph_cluster array<string>, documents array<struct<id:string>>"
    rows = [(i, "p", phrase, [1.0], clusters, [("d",)]) for i, (phrase, clusters) in enumerate([("rote Haut", ["x/y", "z"]), ("Haut", ["z", "z", None]), ("-", ["z"]), ("Knie", None)])]
    spark.createDataFrame([*rows, rows[0]], kind).write.parquet(str(tmp_path / "vector_entries.parquet"))
    got = catalog.QUERIES["ag08_concept_scores"](spark, str(tmp_path)).collect()
    # z: haut twice with ln(3 / 3) + 1, rote once; x/y: each once
    assert sorted(tuple(r) for r in got) == [("p:d", "p/x/y", 1.41421), ("p:d", "p/z", 1.34164)]

import pytest
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators import lines as L
from phrasewerk.operators import negation as N
from phrasewerk.operators import phrases as P
from phrasewerk.operators.numbering import numbered


def test_lines_keep_offsets_over_blank_ones(spark):
    df = spark.createDataFrame([(1, "ab\n\n  \ncd", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, line string")
    got = sorted(map(tuple, L.exploded_lines(df, "doc_id", "text").select("doc_id", "line", "offset").collect()))
    assert got == [(1, "ab", 0), (1, "cd", 7)]
    assert L.exploded_lines(df.limit(0), "doc_id", "text").count() == 0


def test_chunk_places_point_into_the_text(spark):
    text = "Die Wunde ist trocken.\nBei leichter Zyste links, Kein Befund; leichte Zyste."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = P.clean_chunks(P.chunks_of(L.exploded_lines(df, "doc_id", "text"))).collect()
    assert chunks and all(text[r.begin : r.end] == " ".join(r.tokens) for r in chunks)
    assert {" ".join(r.tokens) for r in chunks} >= {"Wunde", "leichter Zyste", "leichte Zyste"}


def test_negated_skip_and_reset(spark):
    rows = [("a", False, 1), ("a", True, 2), ("a", False, 3), ("b", False, 1), ("c", True, 1)]
    df = spark.createDataFrame(rows, "phrase string, negated boolean, seq long")
    assert sorted(r.seq for r in P.skip_negated(df).collect()) == [1, 1, 3]
    assert sorted((r.phrase, r.seq) for r in P.skip_negated(df, "reset").collect()) == [("a", 3), ("b", 1)]


@pytest.mark.parametrize("line, negated", [
    ("Keine Zyste der Leber", {"zyste", "der", "leber"}),
    ("Fieber verneint", {"fieber"}),
    ("Nicht nur Zyste", set()),
    ("Keine Zyste, aber Narbe", {"zyste"}),
    ("Narbe, keine Zyste", {"zyste"}),
    ("No clear sign of oedema", {"oedema"}),
    ("", set()),
])
def test_negation(spark, line, negated):
    df = spark.createDataFrame([(1, line)], "id long, line string")
    assert {r.word for r in N.negated_words(df, "id").where("negated").collect()} == negated


def test_token_sort_ratio(spark):
    pairs = [("kitten sitting", "sitting kitten", 100.0), ("kitten", "sitting", 62.0), ("", "x", 0.0), ("Ä", "a", 0.0), (None, "x", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    got = df.select("want", T.token_sort_ratio(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got[:4]] == [p[2] for p in pairs[:4]]


def test_answers_and_json(spark):
    df = spark.createDataFrame([("<think>a\nb</think> so Final answer: c ",), ("d",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean_answer(F.col("t"))).collect()] == ["c", "d", None]
    df = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('{"a": {"b": 2}}',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(T.fenced_json(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = sorted((r.x, r.nr) for r in numbered(df, ["x"], "nr", 1).collect())
    assert got == [(i, i + 1) for i in range(1000)]


def test_tf_idf_and_scaling(spark):
    found = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("a", 2)], "phrase string, doc_id long")
    w = P.tf_idf(found, 3)
    by = {(r.doc_id, r.phrase): r.tfidf for r in w.collect()}
    assert by[(2, "a")] == pytest.approx(1.0) and by[(1, "a")] ** 2 + by[(1, "b")] ** 2 == pytest.approx(1.0)
    assert {(r.doc_id, r.phrase): r.scaled for r in P.min_max(w, 3).collect()}[(2, "a")] == pytest.approx(1.0)


def test_negated_phrases_are_left_out(spark, tmp_path):
    from phrasewerk.plans import text_queries as Q

    texts = ["Keine Fraktur aber akute Blutung", "x1 Fraktur und Keine Blutung heute\nPat. (Ödem) Blutung. Fraktur ausgeschlossen", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.phrase, r.doc_id): r.places for r in Q.ag01_affirmed_provenance(spark, str(tmp_path)).collect()}
    assert got == {("akute blutung", 0): "19-32", ("fraktur", 1): "3-10"}
    counts = {r.phrase: (r.n_documents, r.n_occurrences) for r in Q.ag03_affirmed_counts(spark, str(tmp_path)).collect()}
    assert counts == {"akute blutung": (1, 1), "fraktur": (1, 1), "blutung": (0, 0), "ödem": (0, 0)}

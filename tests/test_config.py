"""Configurations, prompts, requests, expansion, the document server, answers."""

import json

import pytest

from phrasewerk.functions import arrays as A
from phrasewerk.functions import text as T
from phrasewerk.operators import expansion as E
from phrasewerk.operators import negation as N
from phrasewerk.operators import phrases as P
from phrasewerk.operators import rag as R
from phrasewerk.operators import retrieval as Q
from phrasewerk.sources import config as K
from phrasewerk.sources import readers
from phrasewerk.sources.store import ArtifactStore


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("answer, want", [
    ("<think>hidden reasoning</think>Finale Antwort auf Deutsch: Beleg [0].", "Beleg [0]."),
    ("Analysis: hidden\nFinal answer: Supported answer [0].", "Supported answer [0]."),
    ("  plain \n", "plain"), ("So it is.\nQUESTION: what?", "So it is."), ("=========x", "=========x"), (None, None), ("", ""),
    ("Thinking: a\nb antwort : Ja\nQUELLEN: x", "Ja"),
])
def test_clean_answer(spark, answer, want):
    from pyspark.sql import functions as F

    assert one(spark, T.clean_answer(F.col("a")), a=answer) == want


def test_small_functions(spark):
    from pyspark.sql import functions as F

    assert one(spark, T.no_source_answer(F.col("a")), a="de").startswith("Keine")
    assert one(spark, T.no_source_answer(F.col("a")), a=None).startswith("No source")
    assert one(spark, T.filled("{a} and {b} {c}", a=F.col("a"), b=F.lit(None)), a="x{b}") == "x and  {c}"
    assert one(spark, T.single_sign(F.col("a")), a="-") and not one(spark, T.single_sign(F.col("a")), a="_")
    assert list(one(spark, T.parts_between(F.col("a"), "<b/>"), a="x<b/><b/>y")) == ["x", "y"]
    assert one(spark, T.sequence_ratio(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(8 / 13)
    assert one(spark, T.sequence_ratio(F.col("a"), F.col("b")), a="", b="") == 1.0
    for n in (0, 1, 255, 256, 257, 700):
        values = list(range(n))
        assert list(one(spark, A.sums_before(F.col("a")), a=values)) == [sum(values[:i]) for i in range(n)]
    assert [tuple(p) for p in one(spark, A.pairs(F.col("a")), a=[1, 2, 3])] == [(1, 2), (2, 3)] and list(one(spark, A.pairs(F.col("a")), a=[1])) == []


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    assert K.load(str(tmp_path / "c.json")) == {"a": 1} == K.labels(str(tmp_path / "c.json")) or K.labels(str(tmp_path / "c.json")) == {"a": "1"}
    assert K.labels("topic") == "topic" and K.labels(None) is None
    assert K.server({"size": "5", "replace_keys": "{'t': 'content'}", "other_id": "None"}) == {**K.SERVER, "size": "5", "replace_keys": {"t": "content"}, "other_id": None}
    assert K.literal_dict("nonsense(") == {} == K.literal_dict("[1]")
    assert K.flag("Ja") is True and K.flag("nein") is False and K.flag("vielleicht", True) is True
    assert K.language("de_DE") == "de" == K.language("German") and K.language("xx") == "en"
    assert K.omitted_steps("[\"graph\"]", ("data", "graph")) == {"graph"} == K.omitted_steps(" graph, ", ("data", "graph"))
    with pytest.raises(ValueError):
        K.omitted_steps("nope", ("data",))
    assert K.exclusion_ids("[1, 2]") == [1, 2] and K.exclusion_ids(None) == []
    assert K.document_ids({"id": "x", "doc_id": 7}) == ["7"] and K.document_ids({"ids": ["a", 1]}) == ["a", "1"] and K.document_ids({}) == []
    assert K.credential({"Authorization": "Bearer k", "X-API-Key": "j"}) == "k" and K.credential({"x-api-key": "j", "authorization": "Basic q"}) == "j" and K.credential({}) is None
    flat = K.flattened({"a": {"b": 1, "n_process": 3}, "c": 2}, "n_process")
    assert flat == {"a_b": 1, "c": 2} and K.nested(flat, ("a",)) == {"a": {"b": 1}, "c": 2}
    assert K.parts({"scaling_x": 1, "vectorstore_y": 2, "z": 3}, "scaling_", "vectorstore_") == ({"x": 1}, {"y": 2}, {"z": 3})
    configs = K.ConfigStore(ArtifactStore(spark, str(tmp_path / "s")))
    for step, lang in (("data", "de"), ("graph", "en"), ("embedding", "de")):
        configs.save("p", step, {"language": lang})
    assert configs.all("p", ("data", "embedding", "graph"))["language"] == "de" and configs.read("p", "none") == {}


def test_prompts(tmp_path):
    assert "{question}" in R.resolve_prompt("de-DE").template and "FRAGE" in R.resolve_prompt("de-DE").template
    legacy = R.resolve_prompt("de", {"templates": {"de": "Legacy {question} {summaries}"}, "input_variables": ["question", "summaries"]})
    assert legacy == R.Prompt("Legacy {question} {summaries}", ["question", "summaries"])
    direct = R.resolve_prompt("en", {"profile": "de", "template": "Custom {question} {summaries}"})
    assert direct == R.Prompt("Custom {question} {summaries}", ["summaries", "question"]) and direct.filled(question="a", summaries="b") == "Custom a b"
    (tmp_path / "fr.json").write_text(json.dumps({"template": "FR {question}", "variables": ["question"]}))
    assert R.resolve_prompt("fr", folder=str(tmp_path)) == R.Prompt("FR {question}", ["question"])
    assert R.resolve_prompt("it", folder=str(tmp_path)).template == R.TEMPLATES["en"]


def test_the_examples_of_packing(spark):
    lines = spark.createDataFrame([("d", "n", 0, "Alpha beta", 10), ("d", "n", 1, "Gamma", 30)], "doc_id string, name string, line_no int, line string, offset long")
    got = Q.packed_chunks(lines, "doc_id", 100, 0, keep=["name"]).collect()
    assert [(r.doc_id, r.name, r.chunk_index, r.chunk_start, r.chunk_end, r.text) for r in got] == [("d", "n", 0, 10, 35, "Alpha beta\nGamma")]
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None), (0, None)], "at int, doc string").repartition(3)
    assert {r["at"]: r.run for r in Q.runs(rows, "doc", "at").collect()} == {0: None, 1: "a", 2: "a", 3: "b", 4: "b"}


def test_hits(spark):
    hits = spark.createDataFrame([("d", "a b HIT c d", "HIT", 100, 1.5, "z")], "doc_id string, text string, highlight string, chunk_start long, _score double, _hidden string")
    r = Q.hit_sources(hits, tokens=3).first()
    assert (r.snippet, r.snippet_at, r.snippet_end, r.document_at, r.document_end, r.score) == ("b HIT c", 2, 9, 102, 109, 1.5) and "_hidden" not in r.asDict()


def test_fused_keeps_what_only_one_found(spark):
    lex = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0)], "q int, k int, lexical double")
    dense = spark.createDataFrame([(1, 12, 0.9), (1, 11, 0.9), (2, 10, -0.1)], "q int, k int, dense double")
    got = [(r.q, r.k, round(r.score, 3)) for r in Q.fused(lex, dense, "k", "q", 0.6, 3).orderBy("q", "rank").collect()]
    assert got == [(1, 11, 0.8), (1, 12, 0.6), (1, 10, 0.4), (2, 10, 0.0)]


def test_negation_settings(spark):
    terms = N.TermSet("en").add({"preceding": ["Lacks"]}).remove({"preceding": ["no"]}).terms
    assert "lacks" in terms["preceding"] and "no" not in terms["preceding"] and "no" in N.TERM_SETS["en"]["preceding"]
    with pytest.raises(ValueError):
        N.TermSet("xx")
    assert N.NegationConfig.of({"scope": "2"}).scope == 2 and N.NegationConfig.of({"scope": True}).scope == 1 and N.NegationConfig.of({"scope": False}).scope is None
    for bad in ({"scope": "x"}, {"feature": "q"}, {"unknown": 1}):
        with pytest.raises(ValueError):
            N.NegationConfig.of(bad)
    lines = spark.createDataFrame([(1, "lacks fever or cough but pain")], "id long, line string")
    got = {r.word: r.negated for r in N.negated_words(lines, "id", terms=terms, scope=1).collect()}
    assert got["fever"] and not got["cough"] and not got["pain"] and not got["lacks"]
    from pyspark.sql import functions as F

    assert one(spark, N.negated_prefix(F.col("a")), a="kein Fieber") and not one(spark, N.negated_prefix(F.col("a")), a="kein") and one(spark, N.negated_prefix(F.col("a")), a=None) is False


def test_matrix_parts(spark):
    words = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y"), ("e", "q")], "doc_id string, word string")
    weights = spark.createDataFrame([("c", "x", 0.5), ("c", "y", 0.25), ("k", "x", 1.0)], "concept string, word string, tfidf double")
    scores = P.concept_scores(words, weights)
    assert {(r.doc_id, r.concept): r.score for r in scores.collect()} == {("d", "c"): 0.75, ("d", "k"): 1.0}
    assert {r.concept: round(r.normalised, 6) for r in P.row_normalised(scores, "doc_id").collect()} == {"c": 0.6, "k": 0.8}
    texts = P.joined_texts(words, "doc_id", "word", ["word"], spark.createDataFrame([("d",), ("z",)], "doc_id string"))
    assert {r.doc_id: r.words for r in texts.collect()} == {"d": "x x y", "z": ""}


def test_expansion(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"terms": [{"id": "C001", "term": "myocardial infarction", "synonyms": ["heart attack", "MI"]}, {"id": "C002", "term": "aspirin", "category": "medication"}, {"id": "C3", "term": "fatigue", "categories": ["symptom", "related_term"]}]}))
    source = E.source_of(spark, {"type": "local", "path": str(tmp_path / "t.json")})
    with pytest.raises(NotImplementedError):
        E.source_of(spark, {"type": "http"})
    request = E.Request(" myocardial infarction ", categories=("synonym", "medication", "symptom"))
    reply = 'Sure:\n```json\n{"candidates": [{"term": "heart attack", "category": "synonym"}, {"term": "aspirin", "category": "medication"}, {"term": "fatigue", "category": "procedure"}, {"term": "dizziness", "category": "symptom"}]}\n```'
    seen = []
    candidates = E.generated(spark, request, lambda prompt: seen.append(prompt) or reply)
    assert request.term in seen[0] and '"medication"' in seen[0] and "{" + "term}" not in seen[0]
    got = {r.category: r.candidates for r in E.expanded(spark, request, candidates, [source]).collect()}
    assert list(got) == ["synonym", "medication", "symptom"]
    assert got["synonym"][0].term == "heart attack" and got["synonym"][0].status == "grounded" and got["synonym"][0].evidence[0].relation == "synonym"
    assert got["medication"][0].evidence[0].source_id == "C002" and got["symptom"][0].status == "llm_only"
    excluded = E.Request("x", categories=("symptom",), include_llm_only=False)
    assert [(r.category, list(r.candidates)) for r in E.expanded(spark, excluded, candidates.where("term = 'dizziness'"), [source]).collect()] == [("symptom", [])]
    asked = spark.createDataFrame([("aspirin", "symptom"), ("aspirin", None), ("heart attack", None), ("Fever", None), ("fatigue", "symptom")], "term string, category string")
    found = [(r.term, r.category, r.source_id, r.score) for r in E.grounded(asked, source).collect()]
    assert sorted(found, key=str) == sorted([("aspirin", "symptom", None, 0.0), ("aspirin", None, None, 0.0), ("heart attack", None, "C001", 1.0), ("Fever", None, None, 0.0), ("fatigue", "symptom", "C3", 1.0)], key=str)
    for bad in ({"term": " "}, {"term": "x", "limit_per_category": 0}, {"term": "x", "minimum_score": 2}, {"term": "x", "categories": ("nope",)}):
        with pytest.raises(ValueError):
            E.Request(**bad)
    with pytest.raises(ValueError):
        E.generated(spark, request, lambda prompt: "no json")


def test_document_server(spark, tmp_path):
    hits = [{"_id": f"i{k}", "_source": {"id": f"s{k}" if k % 2 else "", "other": "o0" if k == 0 else None, "text": f"Text {k}", "name": f"N{k}", "label": "L"}} for k in range(7)]
    (tmp_path / "count.json").write_text(json.dumps({"count": 7}))
    for page in range(3):
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"hits": {"hits": hits[page * 3 : page * 3 + 3]}}))
    config = {"url": f"file://{tmp_path}", "size": 3, "other_id": "other"}
    got = {r.id: (r.name, r.content, r.label) for r in readers.served(spark, config).collect()}
    assert got == {("o0" if k == 0 else f"s{k}" if k % 2 else f"i{k}"): (f"N{k}", f"Text {k}", "L") for k in range(7)}
    assert readers.served(spark, config, ["n1", "N2"]).count() == 5
    assert readers.server_reachable({"url": "file:///nowhere", "alternate_url": config["url"]}) == config["url"]
    assert readers.server_reachable({"url": "file:///nowhere"}) is None
    with pytest.raises(NotImplementedError):
        readers.http_terminology()
    folder = tmp_path / "corpus"
    for label in ("A", "b"):
        (folder / label).mkdir(parents=True)
        (folder / label / f"{label}x.txt").write_text(f"in {label}")
    assert {(r.name, r.label) for r in readers.folder(spark, str(folder), categories=["a"]).collect()} == {("Ax", "A")}
    assert {r.name for r in readers.folder(spark, str(folder), subfolders=["b"]).collect()} == {"bx"}
    named = readers.with_label_of(spark.createDataFrame([("k1",), (None,)], "name string"), lambda stem: stem.upper())
    assert {r.name: r.label for r in named.collect()} == {"k1": "K1", None: None}

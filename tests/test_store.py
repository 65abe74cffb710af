"""The vector store, added documents, the engine."""

import random

import pytest

from phrasewerk import streaming as S
from phrasewerk.engine import PhraseEngine, Settings
from phrasewerk.operators import concepts as C
from phrasewerk.operators import provenance as V
from phrasewerk.operators import vector_store as VS
from phrasewerk.sources.store import ArtifactStore, Loader

ROW = f"nr long, phrase string, vector array<double>, graph_cluster array<string>, documents {V.DOCUMENTS}, source string"


def unit(i, n=4, more=0.0):
    return [1.0 if k == i else more for k in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    s = VS.VectorStore(spark, str(tmp_path / "root"), "v", VS.IndexSettings(dim=4)).create()
    rows = [(i, f"p{i}", unit(i), [f"g{i % 2}"], [("a", [[0, 1]])] if i < 2 else [("a", [[3, 4]]), ("b", [])] if i == 2 else None, "pipeline") for i in range(4)]
    s.store(spark.createDataFrame(rows, ROW))
    return s


def test_append_update_delete(spark, store):
    assert [r.entry_id for r in store.read_back().collect()] == [0, 1, 2, 3]
    added, retained = store.store(spark.createDataFrame([(0, "new", unit(0, more=0.9), None, None, None), (1, "same", [0.0, 5.0, 0.0, 0.0], None, None, None)], ROW), check_for_same=True)
    assert [(r.nr, r.entry_id) for r in added.collect()] == [(0, 4)] and [(r.nr, r.entry_id) for r in retained.collect()] == [(1, 1)]
    store.update(spark.createDataFrame([(4, "newer"), (77, "x")], "entry_id long, phrase string"))
    assert {r.entry_id: r.phrase for r in store.entries().collect()} == {0: "p0", 1: "p1", 2: "p2", 3: "p3", 4: "newer"}
    store.delete(spark.createDataFrame([(3,), (88,)], "entry_id long"))
    assert store.size() == 4 and [r.entry_id for r in store.read_back([0, 3, 4]).collect()] == [0, 4]
    with pytest.raises(ValueError):
        store.store(spark.createDataFrame([(0, "short", [1.0], None, None, None)], ROW))
    assert VS.VectorStore.existing(spark, {"root": store.store_of.root, "name": "v"}).settings.dim == 4
    with pytest.raises(FileNotFoundError):
        VS.VectorStore.existing(spark, {"root": store.store_of.root, "name": "w"})
    before = store.entries()
    store.create()
    assert store.size() == 0 and before.count() == 4  # a reader keeps the version it began with


def test_provenance_in_the_store(spark, store):
    store.add_provenance(spark.createDataFrame([(0, [("a", [[0, 1], [5, 6]]), ("c", [[7, 8]])]), (99, [("z", [])])], f"entry_id long, documents {V.DOCUMENTS}"))
    got = {r.entry_id: {d.id: d.offsets for d in r.documents or []} for r in store.entries().collect()}
    assert got == {0: {"a": [[0, 1], [5, 6]], "c": [[7, 8]]}, 1: {"a": [[0, 1]]}, 2: {"a": [[3, 4]], "b": []}, 3: {}}
    assert sorted(r.entry_id for r in store.entries_of("a").collect()) == [0, 1, 2]
    updated, deleted = store.remove_provenance("a", delete_unreferenced=True)
    assert sorted(r.entry_id for r in updated.collect()) == [0, 1, 2] and [r.entry_id for r in deleted.collect()] == [1]
    assert {r.entry_id: [d.id for d in r.documents or []] for r in store.entries().collect()} == {0: ["c"], 2: ["b"], 3: []}


def test_added_documents(spark, store):
    rows = [(0, "d", "again", [0.0, 0.0, 3.0, 0.0], [[1, 4]]), (1, "d", "near p0", unit(0, more=0.3), [[9, 12]]), (2, "e", "again too", unit(3), None)]
    out = VS.VectorDocumentStore(store).add_documents(spark.createDataFrame(rows, "nr long, document string, phrase string, vector array<double>, offsets array<array<int>>"))
    got = {k: [(r.document, r.phrase, r.entry_id) for r in v.collect()] for k, v in out.items()}
    assert got["with_graph_added"] == [("d", "near p0", 4)]
    assert sorted(got["with_graph_incorporated"]) == [("d", "again", 2), ("e", "again too", 3)]
    assert got["without_graph_added"] == [] == got["without_graph_incorporated"]
    held = {r.entry_id: ({d.id: d.offsets for d in r.documents or []}, r.graph_cluster) for r in store.entries().collect()}
    assert held[2][0] == {"a": [[3, 4]], "b": [], "d": [[1, 4]]} and held[4] == ({"d": [[9, 12]]}, ["g0"])
    again = VS.VectorDocumentStore(store).add_documents(spark.createDataFrame(rows, "nr long, document string, phrase string, vector array<double>, offsets array<array<int>>"))
    assert again["with_graph_added"].count() == 0 and again["with_graph_incorporated"].count() == 3  # all are there already


def test_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(VS, "BLOCK", 3)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)], i % 2) for i in range(30)] + [(40, None, 0), (41, [0.0] * 3, 1), (42, [1.0], 0)]
    df = spark.createDataFrame(rows, "entry_id long, v array<double>, g int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    good = [r for r in rows if r[1] and len(r[1]) == 3 and any(r[1])]
    want = {(a[0], b[0]) for a in good for b in good if a[0] != b[0] and a[0] < 12 and a[2] == b[2] and cos(a[1], b[1]) >= 0.99 - 1e-12}
    got = {(r.ask, r.entry_id) for r in VS.duplicates(df.where("entry_id < 12").withColumnRenamed("entry_id", "ask"), df, 0.99, "g").collect()}
    assert got == want and want


def test_nearest_is_exact(spark):
    rng = random.Random(8)
    rows = [(i, f"p{i % 2}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(70, "p0", None), (71, "p0", [0.0] * 3), (0, "p0", [1.0, 1.0, 1.0])]
    rows[0] = (0, "p0", [1.0, 1.0, 1.0])
    df = spark.createDataFrame(rows, "id long, p string, v array<double>").repartition(5)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    good = {i: (p, v) for i, p, v in rows if v and any(v)}
    for blocks in (10_000, 2):
        got = {}
        for r in C.nearest(df, df.where("id < 7"), "id", "v", "p", 4, blocks).collect():
            got.setdefault(r.id, {})[r["rank"]] = r.other
        for i in range(7):
            order = sorted((j for j in good if j != i and good[j][0] == good[i][0]), key=lambda j: (-round(cos(good[i][1], good[j][1]), 12), j))
            assert [got[i][k] for k in range(1, 5)] == order[:4]


def test_models(spark):
    rng = random.Random(5)
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centre]) for i, centre in enumerate([[1, 0, 0]] * 20 + [[0, 1, 0]] * 20 + [[0, 0, 1]] * 20)]
    df = spark.createDataFrame(rows + [(99, None)], "id long, v array<double>")
    for algorithm in ("kmeans", "kmeans-mb", "affinity-prop", "unknown"):
        got = {r.id: r.cluster_id for r in C.clustered(df, "id", "v", algorithm, 3).collect()}
        assert set(got) == set(range(60)) and len({(got[i], i // 20) for i in range(60)}) >= 3
    assert {len(r.reduced) for r in C.reduced(df, "id", "v", 2).collect()} == {2}
    assert 2 <= C.chosen_k(df, "v", 2, 12, samples=4, sample_fraction=1) <= 6
    near = C.nearest_centre(df, C.centres(df.withColumn("c", (df.id / 20).cast("int")), "c", "v"), "c", "id", "v", block=2)
    assert {r.id: r.c for r in near.collect()} == {i: i // 20 for i in range(60)}


TEXTS = [
    (1, "Eins", "Der Patient klagt. Leberzyste Segment sichtbar.\nKeine Fraktur gesehen.\nLeberzyste Befund stabil."),
    (2, "Zwei", "Nierenstein links. Leberzyste Segment klein.\nNierenstein Befund stabil."),
    (3, "Drei", "Nierenstein rechts entfernt.\n\nVerlauf Kontrolle. Leberzyste Segment gross."),
]


def test_engine(spark, tmp_path):
    engine = PhraseEngine(spark, str(tmp_path / "engine"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, name string, text string")
    config = {"clustering": {"k": 2}, "graph": {"cluster_distance": 0.0, "graph_weight_cut_off": 0.2, "graph_simplify": 0.0}}
    process = engine.run_pipeline("p", docs, config, language="de-DE")
    assert process.error is None and {s for _, _, _, s in engine.status("p")} == {"finished"}
    assert process.result().count() == engine.phrases("p").count()
    phrases = {r.phrase: r.n_documents for r in engine.phrases("p").collect()}
    assert phrases["leberzyste segment"] == 3
    assert not any("fraktur" in p for p in phrases)  # negated
    assert engine.corpus_statistics("p").first().n_documents == 3
    assert engine.embedding_statistics("p").first().dim == 256
    assert engine.concepts("p", 3, 0.1).count() == 2
    stats = engine.graph_statistics("p").collect()
    assert stats and engine.graph("p", stats[0].graph_id).count() == stats[0].n_nodes
    assert "<svg" in engine.graph("p", stats[0].graph_id, draw=True)
    with pytest.raises(IndexError):
        engine.graph("p", 99)
    assert engine.configuration("p")["language"] == "de" and engine.processes() == ["p"]
    nodes = {(r.graph_id, r.node_id): [d.id for d in r.documents] for r in engine.graph_tables("p")[0].collect()}
    added = engine.add_documents("p", spark.createDataFrame([(9, "Leberzyste Segment neu.")], "doc_id long, text string"))
    assert sum(v.count() for v in added.values()) > 0
    assert any("9" in [d.id for d in r.documents] for r in engine.graph_tables("p")[0].collect())
    report = engine.delete_document("p", "9")
    assert report["references_removed"] > 0
    assert {(r.graph_id, r.node_id): [d.id for d in r.documents] for r in engine.graph_tables("p")[0].collect()} == nodes
    with pytest.raises(KeyError):
        engine.delete_document("p", "nowhere")
    reused = engine.run_pipeline("p", docs, config)
    assert {s for _, _, _, s in reused.status_rows()} == {"skipped"} and reused.current() is None
    loader = Loader(ArtifactStore(spark, str(tmp_path / "engine")), "p")
    assert loader.load("graph") is loader.load("graph") and set(loader.open) == {"data", "embedding", "clustering", "graph"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "77", "text": "Leberzyste Segment wieder."}\n')
    S.add_documents(engine, "p", S.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert any("77" in [d.id for d in r.documents] for r in engine.graph_tables("p")[0].collect())
    assert engine.delete("p") and engine.processes() == []
    with pytest.raises(ValueError):
        Settings.of({"graph": {"unknown": 1}})
    assert engine.default_config("de")["config"]["graph"]["graph_unroll"] is True


def test_answers(spark, tmp_path):
    engine = PhraseEngine(spark, str(tmp_path / "rag"))
    docs = spark.createDataFrame([(str(i), n, t) for i, n, t in TEXTS], "doc_id string, name string, text string")
    asked = []

    def chatter(prompt):
        if "Nierenstein" in prompt.split("FRAGE")[-1]:
            raise RuntimeError("no model")
        return "<think>x</think>Finale Antwort auf Deutsch: " + ("Beleg [0]." if "Quelle [0]" in prompt else "?")

    assert engine.rag_status("r") == "new"
    assert engine.rag_init("r", docs, chatter, "de") == "ready" and engine.rag_status("r") == "ready"
    q = spark.createDataFrame([(1, "Leberzyste?"), (2, "Nierenstein?"), (3, "Qqqq")], "question int, q_text string")
    got = {r.question: r for r in engine.ask("r", q, limit=2).collect()}
    assert got[1].answer == "Beleg [0]." and got[1].error is None
    assert got[2].answer is None and got[2].error == "RuntimeError: no model"
    only = {r.question: r for r in engine.ask("r", q.where("question = 1"), doc_ids=["77"]).collect()}
    assert only[1].answer == "Keine Quelle die ich finden kann." and only[1].n_sources == 0
    sources = engine.context.rags["r"].sources(q.where("question = 1"), limit=3).orderBy("source_no").collect()
    assert [r.source_no for r in sources] == list(range(len(sources))) and all(r.source.startswith(f"Quelle [{r.source_no}]: ") for r in sources)
    assert len({r.doc_id for r in sources}) == len(sources)
    n = engine.context.rags["r"].store.count()
    assert engine.context.rags["r"].fill(docs) == "ready" and engine.context.rags["r"].store.count() == n

import datetime as dt
import json
import random
import zipfile

import pytest

from phrasewerk import streaming as S
from phrasewerk.operators import expansion as E
from phrasewerk.operators import retrieval as R
from phrasewerk.plans.pipeline import Process, Step
from phrasewerk.sources import readers
from phrasewerk.sources.store import ArtifactStore


def pack(lines, size, overlap, gap=1):
    """Brute force: lists of line numbers."""
    chunks, held = [], []
    length = lambda ls: sum(len(lines[i]) for i in ls) + gap * (len(ls) - 1)
    for i in range(len(lines)):
        if held and length(held) + gap + len(lines[i]) > size:
            chunks.append(held)
            while held and (length(held) > overlap or length(held) + gap + len(lines[i]) > size):
                held = held[1:]
        held = [*held, i]
    return [*chunks, held]


@pytest.mark.parametrize("overlap", [0, 15])
def test_packing(spark, overlap):
    rng = random.Random(4)
    docs = {d: ["x" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))] for d in range(8)}
    rows = []
    for d, ls in docs.items():
        at = 0
        for i, line in enumerate(ls):
            rows.append((d, i, line, at))
            at += len(line) + 1
    df = spark.createDataFrame(rows, "doc_id long, line_no int, line string, offset long")
    got = R.packed_chunks(df, "doc_id", 40, overlap).orderBy("doc_id", "chunk_index").collect()
    for d, ls in docs.items():
        assert [r.text for r in got if r.doc_id == d] == ["\n".join(ls[i] for i in c) for c in pack(ls, 40, overlap)]
    assert R.packed_chunks(df.limit(0), "doc_id").count() == 0


def test_snippets(spark):
    df = spark.createDataFrame([("a b c HIT d e f", "HIT"), ("a b", "zzz"), ("a b c d e", "zzz"), (None, "x")], "text string, h string")
    assert [r.snippet for r in R.snippets(df, "text", "h", 3).collect()] == ["c HIT d", "a b", "a b c", None]


def test_grounding(spark):
    terms = spark.createDataFrame([("1", "Leber", ["Hepar", "liver"], ["organ"]), ("2", "Niere", [], [])], "id string, term string, synonyms array<string>, categories array<string>")
    asked = spark.createDataFrame([("  LIVER ", "organ"), ("liver", "drug"), ("niere", "drug"), ("Milz", "organ")], "term string, category string")
    got = {(r.term, r.category): (r.source_id, r.relation) for r in E.grounded(asked, terms).collect()}
    assert got == {("  LIVER ", "organ"): ("1", "synonym"), ("liver", "drug"): (None, None), ("niere", "drug"): ("2", "exact"), ("Milz", "organ"): (None, None)}
    kept = {r.term: r.status for r in E.statuses(E.grounded(asked, terms), ["term", "category"], reject=False).collect()}
    assert kept == {"  LIVER ": "grounded", "liver": "llm_only", "niere": "grounded", "Milz": "llm_only"}
    assert {r.term for r in E.statuses(E.grounded(asked, terms), ["term", "category"]).collect()} == {"  LIVER ", "niere"}


def test_stream_of_windows(spark, tmp_path):
    rows = [(1, dt.datetime(2030, 1, 1, 0, 10), "a", 1.0), (2, dt.datetime(2030, 1, 1, 0, 50), "a", 2.0), (3, dt.datetime(2030, 1, 1, 5), "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    out = []
    stream = S.windowed_counts(S.event_stream(spark, str(tmp_path / "in"), df.schema), late="1 hour")
    S.for_each_batch(stream, lambda b, _: out.extend(b.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert (out[0].event_type, out[0].n, out[0].total) == ("a", 2, 3.0)


def test_process_runs_reuses_and_deletes(spark, tmp_path):
    store, runs = ArtifactStore(spark, str(tmp_path / "store")), []

    def make(name, fails=False):
        def run(made):
            runs.append(name)
            if fails:
                raise RuntimeError(name)
            return spark.range(3)

        return Step(name, run)

    first = Process(spark, "p", store, [make("data"), make("graph", fails=True), make("rag")])
    first.run()
    assert first.status == {"data": "finished", "graph": "aborted", "rag": "aborted"} and store.steps("p") == ["data"]
    again = Process(spark, "p", store, [make("data"), make("graph"), make("rag")])
    assert again.plan() == {"data": "reuse", "graph": "compute", "rag": "compute"}
    again.start().join()
    assert runs == ["data", "graph", "graph", "rag"] and again.status["data"] == "skipped"
    stopped = Process(spark, "q", store, [make("data")])
    stopped.stop()
    stopped.run()
    assert stopped.status == {"data": "stopped"}
    assert again.delete() and not store.has("p", "data")


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "Anna.txt").write_text("eins\nzwei", encoding="utf-8")
    (tmp_path / "docs" / "skip.md").write_text("no")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.write(tmp_path / "docs" / "Anna.txt", "sub/Anna.txt")
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "docs")).collect()] == [("Anna", "eins\nzwei")]
    assert [tuple(r) for r in readers.read(spark, str(tmp_path / "d.zip")).collect()] == [("Anna", "eins\nzwei")]
    with pytest.raises(KeyError):
        readers.renamed(spark.range(1), {"missing": "x"})
    (tmp_path / "neg.txt").write_text("kein\t\t[PREN]\naber\t\t[CONJ]\nx\t\t[ZZZ]\nbroken\n")
    assert {(r.trigger, r.kind) for r in readers.negation_rules(spark, str(tmp_path / "neg.txt")).collect()} == {("kein", "preceding"), ("aber", "termination"), ("x", "none")}
    (tmp_path / "t.json").write_text(json.dumps({"terms": [{"term": "Leber", "category": "organ"}]}))
    assert readers.terminology(spark, str(tmp_path / "t.json")).first().categories == ["organ"]

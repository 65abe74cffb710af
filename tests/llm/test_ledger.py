import datetime as dt

from pyspark.sql import functions as F

from phrasewerk.llm import ledger

SCHEMA = "entry_id long, process_name string, phrase string, metadata string, added_at timestamp, bucket string"


def rows(*xs):
    return [(i, p, t, m, dt.datetime(2030, 1, d), "clash") for i, p, t, m, d in xs]


def test_canonical_forms(spark):
    texts = ["Leichte  Zyste", "„leichte-zyste!“", "LEICHTE ZYSTE.", "25.8 cm", "25,8 cm", "<5+2", "a.b", "", None, "Fuß", "FUSS"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(ledger.canonical_text(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["leichte zyste"] * 3 + ["25.8 cm", "25,8 cm", "<5+2", "a b", "", None, "fuss", "fuss"]
    metas = ['{"b": 1, "a":{"y":2,"x":1}}', '{ "a": {"x": 1, "y": 2}, "b":1}', None, " {broken", ""]
    got = [r.c for r in spark.createDataFrame([(x,) for x in metas], "t string").select(ledger.canonical_json(F.col("t")).alias("c")).collect()]
    assert got[0] == got[1] and got[2:] == [None, "{broken", ""]


def test_batches_deliveries_and_restart(spark, tmp_path):
    first = spark.createDataFrame(rows((5, "p", "Zyste links", None, 3), (5, "p", "Zyste links", None, 9), (7, "p", "zyste-links", None, 4), (8, "p", "..", None, 4), (9, None, None, None, 4)), SCHEMA)
    second = spark.createDataFrame(rows((5, "p", "Zyste links", None, 12), (2, "p", "ZYSTE LINKS", None, 12), (3, "q", "Zyste links", None, 12), (4, "p", "Zyste links", "{}", 12)), SCHEMA)
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    assert book.counts().count() == 0 and book.members().count() == 0
    book.update(first)
    assert [(r.n_copies, r.first_entry, r.earliest.entry_id) for r in book.counts().collect()] == [(2, 5, 5)]
    again = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    again.update(second)
    got = sorted((r.n_copies, r.first_entry, r.earliest.entry_id, r.earliest.phrase) for r in again.counts().collect())
    assert got == [(1, 3, 3, "Zyste links"), (1, 4, 4, "Zyste links"), (3, 2, 5, "Zyste links")]
    assert sorted(map(tuple, again.copies().collect())) == [(2, 5), (2, 7)]
    again.update(second.limit(0))
    assert again.counts().count() == 3


def test_hot_record(spark, monkeypatch):
    monkeypatch.setattr(ledger, "HOT_COPIES", 50)
    df = spark.range(1, 301).select(F.col("id").alias("entry_id"), F.lit("p").alias("process_name"), F.lit("Same, thing").alias("phrase"), F.lit(None).cast("string").alias("metadata"), F.lit(dt.datetime(2030, 1, 1)).alias("added_at"))
    got = ledger.ledger_of(df).copies().collect()
    assert len(got) == 299 and {r.first_entry for r in got} == {1}

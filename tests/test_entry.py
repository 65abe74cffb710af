import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark, monkeypatch):
    import os

    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).limit(1).count() == 1

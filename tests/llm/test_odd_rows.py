"""The queries of the training-data problems on empty tables and on rows of nulls."""

import pytest

from phrasewerk.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_null_rows(spark, odd_tables, name):
    empty, nulls = (QUERIES[name](spark, folder).collect() for folder in odd_tables)
    if name == "p8_fill":
        assert [tuple(r)[:2] for r in empty] == [(0, 0)] == [tuple(r)[:2] for r in nulls]
    elif name in ("p7_ids", "p8_containers", "p9_scores", "p9_rates"):  # a row for every document or source
        assert not empty and nulls
    else:
        assert not empty and not nulls

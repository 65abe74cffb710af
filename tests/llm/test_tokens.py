import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasewerk.llm import tokens
from phrasewerk.llm.bpe import Encoder

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def own():
    return Encoder(tokens.TOKENIZER)


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab =-ß🙂\n", max_size=300))
def test_same_ids(own, theirs, text):
    assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 2000, " " * 3000 + "x", "<|endoftext|> it's", "ÄÖÜ" * 700])
def test_long_pieces(own, theirs, text):
    assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_rows_null_empty_repeated_and_empty_table(spark, theirs):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Der Befund.", "x"), (3, "Der Befund.", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, tokens.encode_corpus(df).collect()))
    word = theirs.encode("Der Befund.", add_special_tokens=False).ids
    assert got == [(1, []), (2, []), (3, word), (3, word)]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert [r[0] for r in df.orderBy("doc_id").select(tokens.token_count(F.col("text"))).collect()] == [0, 0, len(word), len(word)]

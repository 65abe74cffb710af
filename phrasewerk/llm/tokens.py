"""Problem 7: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasewerk.llm.bpe import encoder

#: Where the vocabulary lies unless the caller names another file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_ids(text: Column, path: str = TOKENIZER) -> Column:
    """The ids of each text without special tokens.

    Null, empty: an empty list. Strings of special tokens are ordinary text. Texts of any length are encoded whole:
    the work is linear in the text, also for one piece of many thousand characters.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield pd.Series([np.asarray(own.encode(x), dtype=np.int32) for x in batch], dtype=object)

    return F.coalesce(ids(F.coalesce(text, F.lit(""))), F.array().cast("array<int>"))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """The number of ids of each text; 0 for null and empty ones."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for batch in batches:
            yield pd.Series([len(own.encode(x)) for x in batch], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, ids): one row for every row of *documents*, repeated keys included; other columns are left out.

    Maps rows where they lie: no shuffle, and only the key and the text are read.
    """
    return documents.select(F.col(key), token_ids(F.col(text), path).alias("ids"))

"""Chunks of lines, lexical and dense retrieval, snippets and sources."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from phrasewerk.functions import text as T
from phrasewerk.sources.store import written

CHUNK = "chunk_index int, chunk_start long, chunk_end long, text string"


def packed_chunks(lines: DataFrame, key: str, chunk_size: int = 400, overlap: int = 100, separator: str = "\n", keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., chunk_index, chunk_start, chunk_end, text): lines of each document packed greedily.

    A chunk ends when the next line and the separator would exceed *chunk_size*; the next one begins with the last lines
    that together have at most *overlap* characters and leave room for the new line. Lines are never split; one longer
    than a chunk is a chunk of its own. Lines come from exploded_lines, in order of line_no; of the *keep* columns the
    first line's values stay. Documents are folded as their sorted lines pass by: only a chunk is held.
    """
    keep = keep or []
    gap = len(separator)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    rows = lines.select(F.col(key), "line_no", "line", F.col("offset").cast("long").alias("offset"), *keep).repartition(key).sortWithinPartitions(key, "line_no")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, held, size, index = object(), (), [], 0, 0
        out: list[tuple] = []

        def done() -> None:
            nonlocal index
            out.append((now, *head, index, held[0][1], held[-1][1] + len(held[-1][0]), separator.join(x for x, _ in held)))
            index += 1

        for pdf in batches:
            for doc, line, at, *more in zip(pdf[key], pdf["line"], pdf["offset"], *[pdf[c] for c in keep]):
                if doc != now:
                    if held:
                        done()
                    now, head, held, size, index = doc, tuple(more), [], 0, 0
                if held and size + gap + len(line) > chunk_size:
                    done()
                    while held and (size > overlap or size + gap + len(line) > chunk_size):
                        size -= len(held.pop(0)[0]) + gap
                size = size + gap + len(line) if held else len(line)
                held.append((line, at))
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held:
            done()
        yield pd.DataFrame(out, columns=names)

    names = [key, *keep, "chunk_index", "chunk_start", "chunk_end", "text"]
    return rows.mapInPandas(fold, ", ".join([*[f"`{c}` {kinds[c]}" for c in (key, *keep)], CHUNK]))


def packed_sentences(sentences: DataFrame, key: str, order: str, text: str, chunk_size: int = 400, overlap: int = 100, separator: str = "\n") -> DataFrame:
    """(key, chunk_index, text): sentences that come without offsets, packed like lines."""
    lines = sentences.select(key, F.col(order).alias("line_no"), F.col(text).alias("line"), F.lit(0).alias("offset")).where("line is not null")
    return packed_chunks(lines, key, chunk_size, overlap, separator).select(key, "chunk_index", "text")


def runs(lines: DataFrame, key: str, order: str) -> DataFrame:
    """*lines* with run: the document that a line belongs to; a line without one joins the document before it in *order*.

    The last document before a line is found within ranges of the order first and carried over from range to range.
    """
    parted = written(lines.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "runs")
    before = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = parted.withColumn("run", F.last(key, ignorenulls=True).over(before))
    ends = parted.where(F.col(key).isNotNull()).groupBy("_p").agg(F.max_by(key, order).alias("_last"))  # one row for each range
    every = parted.select("_p").distinct().join(ends, "_p", "left")
    carried = every.select("_p", F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return inside.join(F.broadcast(carried), "_p").withColumn("run", F.coalesce("run", "_carried")).drop("_p", "_carried")


def of_documents(chunks: DataFrame, ids: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The chunks of some documents; all for None."""
    return chunks if ids is None else chunks.join(ids.select(key).distinct(), key, "left_semi")


def bm25(chunks: DataFrame, questions: DataFrame, key: str, question: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question, key, lexical): BM25 of each question's distinct words. *chunks* (key, text), *questions* (question, q_text).

    Only words that are asked for leave the scan of the chunks, counted within each chunk before the shuffle.
    """
    asked = questions.select(question, F.explode(F.array_distinct(T.words(F.col("q_text")))).alias("word"))
    sized = chunks.select(key, T.words(F.col("text")).alias("ws")).withColumn("len", F.size("ws"))
    total = sized.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    terms = sized.select(key, "len", F.explode("ws").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    tf = written(terms.groupBy("word", key, "len").agg(F.count("*").alias("tf")), "terms")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(total.mean or 1.0)))
    return tf.join(df, "word").join(asked, "word").groupBy(question, key).agg(F.sum(score).alias("lexical"))


def fused(lexical: DataFrame, dense: DataFrame, key: str, question: str, alpha: float = 0.6, limit: int = 10) -> DataFrame:
    """(question, key, score, rank): alpha * dense + (1 - alpha) * lexical, both scaled by their best of the question; the *limit* best, ties by key.

    A chunk that only one of the two found counts 0 in the other. Negative dense scores count 0.
    """
    both = lexical.select(question, key, "lexical").join(dense.select(question, key, "dense"), [question, key], "full_outer")
    tops = written(both.groupBy(question).agg(F.max("lexical").alias("_l"), F.max("dense").alias("_d")), "tops")  # a row for each question, so that one plan has each side once
    scaled = lambda value, top: F.greatest(F.lit(0.0), F.col(value) / F.nullif(F.greatest(F.col(top), F.lit(0.0)), F.lit(0.0)))
    both = both.join(tops, question).withColumn("score", alpha * scaled("dense", "_d") + (1 - alpha) * scaled("lexical", "_l"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(question, key, "score", "rank")


#: Signs of the built-in encoder's grams, and its dimensions.
GRAM, DIMS = 3, 256


def encoded(rows: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """(key, dim, weight): texts as sparse vectors of length one, for want of a model: their words' grams, hashed to dimensions and counted.

    Words are in lower case with a blank before and behind them. A text without words has no rows. The texts of a key
    meet in one task, which holds the counts of a thousand keys; only they and their length leave it, so nothing is joined.
    """
    spaced = F.concat(F.lit(" "), F.array_join(T.words(F.col(text)), " "), F.lit(" "))
    own = rows.select(key, spaced.alias("_s")).where(F.length("_s") > GRAM).repartition(key).sortWithinPartitions(key)

    def made(found: list[tuple]) -> pa.RecordBatch:
        n = np.stack([c for _, c in found])
        i, j = np.nonzero(n)
        weights = n[i, j] / np.sqrt((n * n).sum(1))[i]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], kind).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(weights)], [key, "dim", "weight"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # the last key, whose texts may go on
        for b in batches:
            for k, s in zip(b[key].to_pylist(), b["_s"].to_pylist()):
                c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
                n = np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % dims, minlength=dims)
                if held is not None and held[0] == k:
                    held = (k, held[1] + n)
                    continue
                out += [held] if held is not None else []
                held = (k, n)
                if len(out) == 1000:
                    yield made(out)
                    out = []
        out += [held] if held is not None else []
        if out:
            yield made(out)

    kind = to_arrow_type(own.schema[key].dataType)
    return own.mapInArrow(encode, f"`{key}` {own.schema[key].dataType.simpleString()}, dim int, weight double")


class Encoder(Protocol):
    """Turns (key, text) into sparse vectors (key, dim, weight) of length one; a model is plugged in here."""

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


def dense_scores(chunks: DataFrame, questions: DataFrame, key: str, question: str, encoder: Encoder = encoded) -> DataFrame:
    """(question, key, dense): the cosine of each question (question, q_text) to every chunk (key, text) with which it shares a dimension. The stated questions meet all chunks; nothing but their dimensions leaves the scan of the chunks."""
    asked = encoder(questions, question, "q_text").select(question, "dim", F.col("weight").alias("_q"))
    mine = encoder(chunks, key, "text")
    return mine.join(asked, "dim").groupBy(question, key).agg(F.sum(F.col("weight") * F.col("_q")).alias("dense"))


def snippets(hits: DataFrame, text: str, highlight: str, tokens: int = 150) -> DataFrame:
    """*hits* with snippet, and its place in the chunk: tokens around the highlight, or the first ones where it is not found."""
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    ts = F.split(flat, " ")
    at = T.place_of(F.trim(F.regexp_replace(F.col(highlight), r"\s+", " ")), flat)
    middle = F.size(F.split(F.substring(flat, F.lit(1), F.coalesce(at, F.lit(0)) + F.floor(F.length(highlight) / 2).cast("int")), " ")) - 1
    cut = F.when(F.size(ts) <= tokens, flat).when(at.isNull(), T.cut_start(ts, tokens)).otherwise(T.cut_around(ts, middle, tokens))
    return hits.withColumn("snippet", cut).withColumn("snippet_at", T.place_of(F.col("snippet"), flat))


def numbered_sources(hits: DataFrame, question: str, rank: str, text: str, word: str = "Source") -> DataFrame:
    """(question, source_no, source): "<word> [i]: text" from 0 on in order of rank."""
    nr = F.row_number().over(Window.partitionBy(question).orderBy(rank)) - 1
    return hits.withColumn("source_no", nr).select(question, "source_no", F.concat(F.lit(word + " ["), F.col("source_no").cast("string"), F.lit("]: "), F.col(text)).alias("source"))


def joined_by_document(hits: DataFrame, document: str, rank: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(document, first_rank, text): the texts of one document joined in order of rank; rows without a document fall out."""
    by = hits.where(F.col(document).isNotNull()).groupBy(document).agg(F.min(rank).alias("first_rank"), F.sort_array(F.collect_list(F.struct(rank, text))).alias("_t"))
    return by.select(document, "first_rank", F.array_join(F.col("_t")[text], separator).alias("text"))


#: Keys of a hit that are no metadata of the answer.
HIDDEN = ("text", "chunk_text", "highlight")


def hit_sources(hits: DataFrame, text: str = "text", highlight: str = "highlight", tokens: int = 150) -> DataFrame:
    """Hits with their snippet and its places in the chunk and, where chunk_start is there, in the document (approximate: blanks are collapsed); columns that begin with _ fall out, except _score as score."""
    out = snippets(hits, text, highlight, tokens)
    start = F.col("chunk_start") if "chunk_start" in hits.columns else F.lit(None).cast("long")
    out = out.withColumn("snippet_end", F.col("snippet_at") + F.length("snippet")).withColumn("document_at", start + F.col("snippet_at")).withColumn("document_end", start + F.col("snippet_at") + F.length("snippet"))
    if "_score" in hits.columns:
        out = out.withColumn("score", F.col("_score"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])

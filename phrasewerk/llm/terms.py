"""Problem 5: the frequency of every distinct term, by a range-partitioned external sort and a scan of its runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasewerk.llm.common import has_word, written

#: Processes beyond this number meet their configuration in a shuffled join.
BROADCAST_PROCESSES = 100_000


def with_config(rows: DataFrame, per_process: DataFrame) -> DataFrame:
    """*rows* with the columns of *per_process* (one row for each process_name), broadcast only if it has few rows."""
    small = per_process.limit(BROADCAST_PROCESSES + 1).count() <= BROADCAST_PROCESSES
    return rows.join(F.broadcast(per_process) if small else per_process, "process_name")


def term_of(phrase: Column, case_sensitive: Column) -> Column:
    """The phrase as stored, in lower case unless *case_sensitive* is true (null is false)."""
    return F.when(case_sensitive, phrase).otherwise(F.lower(phrase))


def term_rows(entries: DataFrame, config: DataFrame) -> DataFrame:
    """(process_name, term, record, mention): one row for each place where an entry's phrase is found, and one with nulls for an entry without any.

    Left out: phrases that are null or without letters and digits, processes whose tfidf_filter.enabled is false and
    entries of processes without a configuration. Array elements that are null or name no document count as none.
    """
    wanted = config.where(F.coalesce(F.col("config.data.tfidf_filter.enabled"), F.lit(True)) & F.col("process_name").isNotNull())
    wanted = wanted.groupBy("process_name").agg(F.bool_or("config.data.case_sensitive").alias("case_sensitive"))
    rows = with_config(entries.where(has_word(F.col("phrase"))).select("process_name", "phrase", "entry_id", "documents"), wanted)
    docs = F.filter("documents", lambda d: d.isNotNull() & d["id"].isNotNull())
    places = F.flatten(F.transform(docs, lambda d: F.transform(
        F.when(F.size(d["offsets"]) > 0, d["offsets"]).otherwise(F.array(F.lit(None).cast("array<int>"))),
        lambda o: F.struct(d["id"].alias("record"), F.get(o, F.lit(0)).alias("begin")))))
    return rows.select(
        "process_name", term_of(F.col("phrase"), F.col("case_sensitive")).alias("term"), F.explode_outer(F.array_distinct(places)).alias("p"), F.col("entry_id")
    ).select("process_name", "term", F.col("p.record").alias("record"), F.coalesce("entry_id", F.lit(-1)).alias("entry_id"), F.coalesce("p.begin", F.lit(-1)).alias("begin"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts along sorted rows; a run may go on in the next batch, so its last row and counts are carried over."""
    names = ["process_name", "term", "n_occurrences", "n_documents"]
    last, held = None, None  # the row before; (process_name, term, occurrences, documents) of the open run

    def differ(col: pa.Array, before) -> np.ndarray:
        """Where a value is not that of the row before; nulls are equal."""
        left, right = col.slice(1), col.slice(0, len(col) - 1)
        ne = pc.fill_null(pc.not_equal(left, right), False).to_numpy(zero_copy_only=False)
        ne |= (pc.is_null(left).to_numpy(zero_copy_only=False) != pc.is_null(right).to_numpy(zero_copy_only=False))
        first = True if before is None else col[0].as_py() != before
        return np.concatenate([[first], ne])

    for b in batches:
        if not b.num_rows:
            continue
        if last is None:
            new_term = differ(b["process_name"], None) | differ(b["term"], None)
            new_doc, new_row = (differ(b[c], None) for c in ("record", "entry_id"))
            new_begin = differ(b["begin"], None)
        else:
            new_term = differ(b["process_name"], last[0]) | differ(b["term"], last[1])
            new_doc, new_row, new_begin = differ(b["record"], last[2]), differ(b["entry_id"], last[3]), differ(b["begin"], last[4])
        found = pc.is_valid(b["record"]).to_numpy(zero_copy_only=False)
        new_doc = (new_term | new_doc)
        docs = (new_doc & found).astype(np.int64)
        places = ((new_doc | new_row | new_begin) & found).astype(np.int64)
        starts = np.flatnonzero(new_term)
        last = tuple(b[c][b.num_rows - 1].as_py() for c in ("process_name", "term", "record", "entry_id", "begin"))
        if len(starts) == 0:
            held = (*held[:2], held[2] + int(places.sum()), held[3] + int(docs.sum()))
            continue
        head = starts[0]
        if held is not None:
            held = (*held[:2], held[2] + int(places[:head].sum()), held[3] + int(docs[:head].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names)
        n_places, n_docs = np.add.reduceat(places, starts), np.add.reduceat(docs, starts)
        whole = pa.array(starts[:-1])
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([b["process_name"].take(whole), b["term"].take(whole), pa.array(n_places[:-1]), pa.array(n_docs[:-1])], names)
        at = int(starts[-1])
        held = (b["process_name"][at].as_py(), b["term"][at].as_py(), int(n_places[-1]), int(n_docs[-1]))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names)


def term_counts(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(process_name, term, n_occurrences, n_documents) of every distinct term of *rows* (see term_rows).

    The pairs of term and record are sorted by ranges. The record belongs to the sort key, so a term that holds a
    third of all rows is cut into several ranges, while equal pairs stay together and are counted once; the counts of
    the ranges are added in the end. A second delivery of an entry repeats its rows and is passed over in the scan.
    """
    key = ["process_name", "term", "record", "entry_id", "begin"]
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.select(*key), "pairs")  # the sample for the ranges and the sort read it, neither makes it again
    runs = rows.repartitionByRange(n, "process_name", "term", "record").sortWithinPartitions(*key).select(*key)
    runs = runs.mapInArrow(_runs, "process_name string, term string, n_occurrences long, n_documents long")
    return runs.groupBy("process_name", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_documents").alias("n_documents"))


def marked(counts: DataFrame, files: DataFrame, config: DataFrame) -> DataFrame:
    """*counts* with mark: rare below min_df documents, else common above max_df times the process's distinct files, else null.

    A process without files has 0 of them; a null min_df or max_df sets no mark.
    """
    n_files = files.where(F.col("file_id").isNotNull()).groupBy("process_name").agg(F.countDistinct("file_id").alias("n_files"))
    bounds = config.groupBy("process_name").agg(F.max("config.data.tfidf_filter.min_df").alias("min_df"), F.max("config.data.tfidf_filter.max_df").alias("max_df"))
    bounds = bounds.join(n_files, "process_name", "left").select("process_name", "min_df", "max_df", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    n = F.col("n_documents")
    mark = F.when(n < F.col("min_df"), F.lit("rare")).when(n > F.col("max_df") * F.col("n_files"), F.lit("common"))
    return with_config(counts, bounds).select("process_name", "term", "n_occurrences", "n_documents", mark.alias("mark"))

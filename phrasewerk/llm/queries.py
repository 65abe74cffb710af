"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.llm import abuse, clusters, ledger, packing, pieces, pii, terms, tokens, vectors
from phrasewerk.llm.common import table
from phrasewerk.sources.store import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query under *name*, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


#: The canonical form of a phrase in SQL that has no look-around: points and commas between digits are set aside first.
_SQL_RECORDS = r"""
WITH apart AS (
  SELECT entry_id, process_name, metadata, added_at, phrase,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(phrase, 'ß', 'ss')),
      '(\p{Nd})\.(\p{Nd})', '\1' || chr(57344) || '\2', 'g'), '(\p{Nd})\.(\p{Nd})', '\1' || chr(57344) || '\2', 'g'),
      '(\p{Nd}),(\p{Nd})', '\1' || chr(57345) || '\2', 'g'), '(\p{Nd}),(\p{Nd})', '\1' || chr(57345) || '\2', 'g') AS p
  FROM vector_entries WHERE entry_id IS NOT NULL AND regexp_matches(phrase, '[\p{L}\p{N}]')
), canon AS (
  SELECT entry_id, process_name, phrase, added_at, trim(regexp_replace(p, '[\s\p{Z}\p{P}\x{1c}-\x{1f}\x{85}\x{0b}]+', ' ', 'g')) AS p,
    list_aggregate(list_transform(list_sort(json_keys(metadata)), lambda k: k || '=' || CAST(json_extract(metadata, k) AS VARCHAR)), 'string_agg', ';') AS m
  FROM apart
), once AS (
  SELECT entry_id, process_name, p, m, min(struct_pack(t := coalesce(added_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), e := entry_id, x := phrase)) AS earliest
  FROM canon GROUP BY ALL
), records AS (
  SELECT process_name, p, m, min(entry_id) AS first_entry, count(*) AS n_copies, min(earliest).x AS phrase
  FROM once GROUP BY process_name, p, m
)
""".replace("\\\\", "\\")


@query("p3_found", _SQL_RECORDS + """
SELECT r.first_entry AS id_a, o.entry_id AS id_b FROM once o
JOIN records r ON o.process_name IS NOT DISTINCT FROM r.process_name AND o.p = r.p AND o.m IS NOT DISTINCT FROM r.m
WHERE o.entry_id <> r.first_entry""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_of(table(spark, sf_dir, "vector_entries")).copies().toDF("id_a", "id_b")


@query("p3_records", _SQL_RECORDS + "SELECT first_entry, process_name, phrase, n_copies FROM records")
def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ledger.ledger_of(table(spark, sf_dir, "vector_entries")).counts()
    return counts.select("first_entry", F.col("earliest.process_name").alias("process_name"), F.col("earliest.phrase").alias("phrase"), "n_copies")


_SQL_TERMS = """
WITH cfg AS (
  SELECT process_name, config.data.case_sensitive AS cs, config.data.tfidf_filter.min_df AS min_df, config.data.tfidf_filter.max_df AS max_df
  FROM pipeline_config WHERE coalesce(config.data.tfidf_filter.enabled, TRUE)
), e AS (
  SELECT v.process_name, CASE WHEN cs THEN phrase ELSE lower(phrase) END AS term, entry_id, documents
  FROM vector_entries v JOIN cfg USING (process_name) WHERE regexp_matches(phrase, '[\\p{L}\\p{N}]')
), d AS (SELECT process_name, term, entry_id, unnest(documents) AS d FROM e),
o AS (SELECT process_name, term, entry_id, d.id AS id, unnest(CASE WHEN len(d.offsets) > 0 THEN d.offsets ELSE [NULL] END) AS o FROM d WHERE d.id IS NOT NULL),
n AS (SELECT process_name, term, count(DISTINCT (entry_id, id, o[1])) AS n_occurrences, count(DISTINCT id) AS n_documents FROM o GROUP BY 1, 2),
f AS (SELECT process_name, count(DISTINCT file_id) AS n_files FROM corpus_files GROUP BY 1),
t AS (
  SELECT t.process_name, t.term, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_documents, 0) AS n_documents,
    CASE WHEN coalesce(n_documents, 0) < min_df THEN 'rare' WHEN coalesce(n_documents, 0) > max_df * coalesce(n_files, 0) THEN 'common' END AS mark
  FROM (SELECT DISTINCT process_name, term FROM e) t LEFT JOIN n USING (process_name, term) JOIN cfg USING (process_name) LEFT JOIN f USING (process_name)
)
"""


@query("p5_terms", _SQL_TERMS + "SELECT process_name, term, n_occurrences, n_documents, mark FROM t")
def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "pipeline_config")
    rows = terms.term_rows(table(spark, sf_dir, "vector_entries"), config)
    return terms.marked(terms.term_counts(rows), table(spark, sf_dir, "corpus_files"), config)


@query("p5_found", _SQL_TERMS + "SELECT process_name, term, mark FROM t WHERE mark IS NOT NULL")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).where("mark is not null").select("process_name", "term", "mark")


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_pairs(table(spark, sf_dir, "vector_entries"))


@query("p2_knn")
def p2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar phrases of every hundredth entry in the whole store, with their cosine."""
    rows = table(spark, sf_dir, "vector_entries")
    return vectors.most_similar(rows, asks=F.col("entry_id") % 100 == 0)


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters.groups(table(spark, sf_dir, "vector_entries"), table(spark, sf_dir, "pipeline_config"))
    return clusters.probe_pairs(members, table(spark, sf_dir, "cluster_probes"))


@query("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its size and most typical phrases."""
    return clusters.described(clusters.groups(table(spark, sf_dir, "vector_entries"), table(spark, sf_dir, "pipeline_config")))


@query("p4_found", """
SELECT file_id, split_no, CASE WHEN bool_or(regexp_matches(text, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]{401}')) THEN 'hard' ELSE 'soft' END AS cut
FROM text_splits WHERE length(text) > 400 GROUP BY file_id, split_no""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "text_splits").where(F.length("text") > pieces.LIMIT)
    cut = F.when(F.bool_or("hard"), F.lit("hard")).otherwise(F.lit("soft"))
    return pieces.split_items(lines, ["file_id", "split_no"], "text").groupBy("file_id", "split_no").agg(cut.alias("cut"))


@query("p4_line_pieces")
def p4_line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every line of text_splits; begin and end count from the line's start."""
    return pieces.split_items(table(spark, sf_dir, "text_splits"), ["file_id", "split_no"], "text")


@query("p4_file_pieces")
def p4_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every file's whole content."""
    return pieces.split_items(table(spark, sf_dir, "corpus_files"), ["file_id"], "content")


@query("p4_stream_pieces")
def p4_stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the corpus as a few giant text files, read by byte ranges: (item, piece_no, begin, end, hard, piece)."""
    texts = table(spark, sf_dir, "corpus_files").where("content is not null").groupBy("file_id").agg(F.min("content").alias("content"))
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    texts.repartitionByRange(4, "file_id").sortWithinPartitions("file_id").select(F.regexp_replace("content", "\r", "").alias("value")).write.text(path)
    return pieces.split_files(spark, f"{path}/*.txt")


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of unused room."""
    return packing.fill(packing.pack(table(spark, sf_dir, "documents")))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_ratings")).where("abusive").select("doc_id")


@query("p9_scores")
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_ratings"))


@query("p9_rates")
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_ratings")))


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "corpus_files"))


@query("p1_sanitised")
def p1_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's content with placeholders."""
    return pii.sanitised(table(spark, sf_dir, "corpus_files"))

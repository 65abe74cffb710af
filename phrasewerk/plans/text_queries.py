"""Queries on documents, lines, phrases and negation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.functions import arrays as A
from phrasewerk.functions import text as T
from phrasewerk.operators import lines as L
from phrasewerk.operators import negation as N
from phrasewerk.operators import phrases as P
from phrasewerk.operators.numbering import numbered
from phrasewerk.plans.registry import query
from phrasewerk.sources.store import ArtifactStore, scratch_dir
from phrasewerk.tables import table

_LINES = """
lines AS (
  SELECT doc_id, line_no, line, "offset" FROM (
    SELECT doc_id, i - 1 AS line_no, parts[i] AS line,
      coalesce(sum(length(parts[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
  ) WHERE regexp_matches(line, '[^ \\t\\n\\r\\f\\x0b]')
)"""
_CHUNK = r"(?:\p{Ll}{3,} )?\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}{3,})*"
_STOPS = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_CHUNK_PART = f""",
matched AS (
  SELECT doc_id, line_no, "offset", m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, line_no, "offset", regexp_extract_all(line, '{_CHUNK}') AS m, regexp_split_to_array(line, '{_CHUNK}') AS g FROM lines) WHERE len(m) > 0
), chunks AS (
  SELECT doc_id, line_no, i - 1 AS chunk_no, m[i] AS chunk, "offset" + list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS b0
  FROM matched
), cut AS (
  SELECT doc_id, line_no, chunk_no, string_split(chunk, ' ') AS t, b0, b0 + length(chunk) AS "end", list_transform(string_split(chunk, ' '), lambda x: lower(x) IN ({_STOPS})) AS d FROM chunks
), cleaned AS (
  SELECT doc_id, line_no, chunk_no, list_filter(t, lambda x: NOT lower(x) IN ({_STOPS})) AS tokens,
    b0 + coalesce(list_sum(list_transform(t[1:list_position(d, FALSE) - 1], lambda x: length(x) + 1)), 0) AS "begin", "end" FROM cut WHERE NOT d[len(d)]
), occ AS (SELECT doc_id, lower(array_to_string(tokens, ' ')) AS phrase, "begin", "end" FROM cleaned)
"""
_CHUNKS = _LINES + _CHUNK_PART


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exploded_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean_chunks(P.chunks_of(_lines(spark, sf_dir)))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.occurrences(_chunks(spark, sf_dir))


def _affirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences outside the reach of negations."""
    words = N.negated_words(_lines(spark, sf_dir), "doc_id", "line_no")
    return P.occurrences(P.skip_negated(N.negated_chunks(_chunks(spark, sf_dir), words)))


@query("prj01_lines", "WITH" + _LINES + ' SELECT doc_id, line_no, line, CAST("offset" AS BIGINT) AS "offset" FROM lines')
def prj01_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query("prj02_chunks", "WITH" + _CHUNKS + ' SELECT doc_id, line_no, chunk_no, array_to_string(tokens, \' \') AS chunk, CAST("begin" AS BIGINT) AS "begin", CAST("end" AS BIGINT) AS "end" FROM cleaned')
def prj02_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "line_no", "chunk_no", F.array_join("tokens", " ").alias("chunk"), "begin", "end")


@query("prj04_surface_forms", "WITH" + _CHUNKS + """ SELECT lower(array_to_string(tokens, ' ')) AS phrase, lower(tokens[-1]) AS head,
  lower(array_to_string(list_concat([tokens[-1]], tokens[1:len(tokens)-1]), ' ')) AS head_first, count(*) AS n FROM cleaned GROUP BY 1, 2, 3""")
def prj04_surface_forms(spark, sf_dir):
    t = F.col("tokens")
    rows = _chunks(spark, sf_dir).select(P.surface(t).alias("phrase"), P.surface(t, head_only=True).alias("head"), P.surface(t, prepend_head=True).alias("head_first"))
    return rows.groupBy("phrase", "head", "head_first").agg(F.count("*").alias("n"))


@query("ag01_phrase_provenance", "WITH" + _CHUNKS + """ SELECT phrase, doc_id, count(*) AS n, array_to_string(list(CAST("begin" AS BIGINT)::VARCHAR || '-' || CAST("end" AS BIGINT)::VARCHAR ORDER BY "begin"), ' ') AS places FROM occ GROUP BY phrase, doc_id""")
def ag01_phrase_provenance(spark, sf_dir):
    places = F.array_join(F.transform("offsets", lambda o: F.concat_ws("-", o["b"].cast("string"), o["e"].cast("string"))), " ")
    return P.provenance(_found(spark, sf_dir)).select("phrase", "doc_id", "n", places.alias("places"))


@query("ag03_phrase_counts", "WITH" + _CHUNKS + " SELECT phrase, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences FROM occ GROUP BY phrase")
def ag03_phrase_counts(spark, sf_dir):
    return P.phrase_table(_found(spark, sf_dir))


@query("ag04_document_phrases", "WITH" + _CHUNKS + """ SELECT doc_id, string_agg(phrase, ' | ' ORDER BY "begin") AS phrases FROM occ GROUP BY doc_id""")
def ag04_document_phrases(spark, sf_dir):
    by = _found(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "phrase"))).alias("p"))
    return by.select("doc_id", F.array_join("p.phrase", " | ").alias("phrases"))


@query("prj09_frequency_filter", "WITH" + _CHUNKS + """ SELECT phrase, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences FROM occ GROUP BY phrase
HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.2 * (SELECT count(*) FROM documents) AND phrase NOT IN ('station', 'patient')""")
def prj09_frequency_filter(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return P.frequency_filter(P.phrase_table(_found(spark, sf_dir)), n, 5, 0.2, ["station", "patient"])


_TFIDF = """, tf AS (SELECT doc_id, phrase, count(*) AS tf FROM occ GROUP BY 1, 2),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT doc_id, phrase, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (phrase)),
w AS (SELECT doc_id, phrase, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS tfidf FROM raw)"""


@query("ag05_tfidf", "WITH" + _CHUNKS + _TFIDF + " SELECT doc_id, phrase, round(tfidf, 6) AS tfidf FROM w")
def ag05_tfidf(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return P.tf_idf(_found(spark, sf_dir), n).select("doc_id", "phrase", F.round("tfidf", 6).alias("tfidf"))


@query("ag05_min_max", "WITH" + _CHUNKS + _TFIDF + """, e AS (SELECT phrase, max(tfidf) AS hi, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0 ELSE min(tfidf) END AS lo FROM w GROUP BY 1)
SELECT doc_id, phrase, round(coalesce((tfidf - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM w JOIN e USING (phrase)""")
def ag05_min_max(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return P.min_max(P.tf_idf(_found(spark, sf_dir), n), n).select("doc_id", "phrase", F.round("scaled", 6).alias("scaled"))


_TRIGGERS = ", ".join(f"('{k}', '{t}', {len(t.split(' '))})" for k, ts in N.TRIGGERS.items() for t in ts)
_NEGATION = "WITH" + _LINES + f""", trig(kind, trig, n) AS (VALUES {_TRIGGERS}),
words AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS w FROM lines),
grams AS (SELECT doc_id, line_no, n, i, array_to_string(w[i+1:i+n], ' ') AS g FROM (SELECT doc_id, line_no, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM words CROSS JOIN (SELECT DISTINCT n FROM trig) WHERE len(w) >= n)),
m AS (SELECT doc_id, line_no, kind, i AS b, i + g.n AS e FROM grams g JOIN trig ON g = trig AND g.n = trig.n),
clear AS (SELECT * FROM m WHERE kind <> 'pseudo' AND NOT EXISTS (SELECT 1 FROM m p WHERE p.kind = 'pseudo' AND p.doc_id = m.doc_id AND p.line_no = m.line_no AND m.b < p.e AND p.b < m.e)),
ends AS (SELECT doc_id, line_no, b FROM clear WHERE kind = 'termination' UNION SELECT doc_id, line_no, 0 FROM words),
parts AS (SELECT doc_id, line_no, b, lead(b, 1, 1000000000) OVER (PARTITION BY doc_id, line_no ORDER BY b) AS e FROM ends),
each AS (SELECT doc_id, line_no, i - 1 AS word_no, w[i] AS word FROM (SELECT doc_id, line_no, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
placed AS (SELECT each.*, parts.b AS part FROM each JOIN parts ON each.doc_id = parts.doc_id AND each.line_no = parts.line_no AND word_no >= parts.b AND word_no < parts.e),
reach AS (SELECT clear.*, parts.b AS part FROM clear JOIN parts ON clear.doc_id = parts.doc_id AND clear.line_no = parts.line_no AND clear.b >= parts.b AND clear.b < parts.e WHERE kind IN ('preceding', 'following'))
"""


_NEGATED = """, n AS (SELECT p.doc_id, p.line_no, word_no, word, coalesce(bool_or(r.part = p.part AND ((kind = 'preceding' AND r.b < word_no) OR (kind = 'following' AND r.e > word_no + 1))), FALSE) AND NOT coalesce(bool_or(r.b <= word_no AND word_no < r.e), FALSE) AS negated
FROM placed p LEFT JOIN reach r ON p.doc_id = r.doc_id AND p.line_no = r.line_no GROUP BY 1, 2, 3, 4)"""
#: Occurrences of chunks without a word in the reach of a negation.
_AFFIRMED = _NEGATION + _CHUNK_PART + _NEGATED + """, cw AS (SELECT c.doc_id, c.line_no, lower(array_to_string(tokens, ' ')) AS phrase, "begin", "end",
  len(regexp_extract_all(substr(l.line, 1, CAST("begin" - l."offset" AS BIGINT)) || 'x', '[\\p{L}\\p{N}]+')) - 1 AS f, len(regexp_extract_all(substr(l.line, 1, CAST("end" - l."offset" AS BIGINT)), '[\\p{L}\\p{N}]+')) AS t
  FROM cleaned c JOIN lines l ON c.doc_id = l.doc_id AND c.line_no = l.line_no),
aff AS (SELECT * FROM cw WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.negated AND n.doc_id = cw.doc_id AND n.line_no = cw.line_no AND word_no >= f AND word_no < t))
"""


@query("ag01_affirmed_provenance", _AFFIRMED + """ SELECT phrase, doc_id, count(*) AS n, array_to_string(list(CAST("begin" AS BIGINT)::VARCHAR || '-' || CAST("end" AS BIGINT)::VARCHAR ORDER BY "begin"), ' ') AS places FROM aff GROUP BY phrase, doc_id""")
def ag01_affirmed_provenance(spark, sf_dir):
    """ag01_phrase_provenance without negated occurrences."""
    places = F.array_join(F.transform("offsets", lambda o: F.concat_ws("-", o["b"].cast("string"), o["e"].cast("string"))), " ")
    return P.provenance(_affirmed(spark, sf_dir)).select("phrase", "doc_id", "n", places.alias("places"))


@query("ag03_affirmed_counts", _AFFIRMED + " SELECT phrase, count(DISTINCT a) AS n_documents, count(a) AS n_occurrences FROM (SELECT phrase, NULL AS a FROM cw UNION ALL SELECT phrase, doc_id FROM aff) GROUP BY phrase")
def ag03_affirmed_counts(spark, sf_dir):
    """Counts without negated occurrences; phrases that are only negated stay, with 0."""
    kept = P.phrase_table(_affirmed(spark, sf_dir))
    every = _found(spark, sf_dir).select("phrase").distinct().join(kept, "phrase", "left")
    return every.select("phrase", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_occurrences", F.lit(0)).alias("n_occurrences"))


@query("ag04_affirmed_phrases", _AFFIRMED + """ SELECT doc_id, string_agg(phrase, ' | ' ORDER BY "begin") AS phrases FROM aff GROUP BY doc_id""")
def ag04_affirmed_phrases(spark, sf_dir):
    by = _affirmed(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "phrase"))).alias("p"))
    return by.select("doc_id", F.array_join("p.phrase", " | ").alias("phrases"))


@query("ag05_affirmed_tfidf", _AFFIRMED + _TFIDF.replace("FROM occ", "FROM aff") + " SELECT doc_id, phrase, round(tfidf, 6) AS tfidf FROM w")
def ag05_affirmed_tfidf(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return P.tf_idf(_affirmed(spark, sf_dir), n).select("doc_id", "phrase", F.round("tfidf", 6).alias("tfidf"))


@query("prj09_affirmed_filter", _AFFIRMED + """ SELECT phrase, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences FROM aff GROUP BY phrase
HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.2 * (SELECT count(*) FROM documents) AND phrase NOT IN ('station', 'patient')""")
def prj09_affirmed_filter(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return P.frequency_filter(P.phrase_table(_affirmed(spark, sf_dir)), n, 5, 0.2, ["station", "patient"])


@query("st03_documents_without_phrase", "WITH" + _CHUNKS + " SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM occ")
def st03_documents_without_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


@query("wn02_phrase_ids", "WITH" + _CHUNKS + """, f AS (SELECT phrase, min(struct_pack(d := doc_id, b := CAST("begin" AS BIGINT))) AS first FROM occ GROUP BY 1)
SELECT phrase, row_number() OVER (ORDER BY first.d, first.b) - 1 AS phrase_id FROM f""")
def wn02_phrase_ids(spark, sf_dir):
    """Ids in order of first appearance: ranges of the order are numbered in parallel, each from its prefix sum."""
    first = _found(spark, sf_dir).groupBy("phrase").agg(F.min(F.struct("doc_id", "begin")).alias("f"))
    return numbered(first.select("phrase", "f.doc_id", "f.begin"), ["doc_id", "begin"], "phrase_id").select("phrase", "phrase_id")


@query("prj15_corpus_statistics", "WITH" + _CHUNKS + """ SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(label) FROM documents) AS n_labels,
(SELECT count(DISTINCT lower(label)) FROM documents) AS n_label_types, (SELECT count(DISTINCT phrase) FROM occ) AS n_phrases""")
def prj15_corpus_statistics(spark, sf_dir):
    return L.corpus_statistics(table(spark, sf_dir, "documents"), P.phrase_table(_found(spark, sf_dir)))


@query("prj05_label_view", "SELECT doc_id, label FROM documents WHERE lower(label) IN ('befund', 'labor', 'chir')")
def prj05_label_view(spark, sf_dir):
    return L.label_view(table(spark, sf_dir, "documents"), ["Befund", "labor", "CHIR"]).select("doc_id", "label")


@query("prj07_names_by_label", "SELECT DISTINCT lower(label) AS label, name FROM documents WHERE label IS NOT NULL AND name IS NOT NULL")
def prj07_names_by_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("label is not null and name is not null")
    return rows.select(F.lower("label").alias("label"), "name").distinct()


@query("prj08_missing_labels", "SELECT l AS label FROM (SELECT unnest(['befund', 'kein_label', 'labor']) AS l) WHERE l NOT IN (SELECT lower(label) FROM documents WHERE label IS NOT NULL)")
def prj08_missing_labels(spark, sf_dir):
    return L.missing_labels(table(spark, sf_dir, "documents"), ["Befund", "kein_label", "labor"])


@query("src02_stratified", """WITH s AS (SELECT doc_id, lower(label) AS stratum FROM documents WHERE label IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id) AS nr FROM s)
SELECT doc_id, stratum FROM n WHERE nr <= floor(60.0 / (SELECT count(DISTINCT stratum) FROM s))""")
def src02_stratified(spark, sf_dir):
    return L.stratified(table(spark, sf_dir, "documents"), "doc_id", "label", 60, 7).select("doc_id", "stratum")


@query("src03_label_of_name", """WITH l AS (SELECT name, min(lower(label)) AS f FROM corpus_files WHERE name IS NOT NULL AND label IS NOT NULL GROUP BY 1)
SELECT doc_id, coalesce(f, 'None') AS found_label FROM documents LEFT JOIN l USING (name)""")
def src03_label_of_name(spark, sf_dir):
    labels = table(spark, sf_dir, "corpus_files").where("label is not null").select("name", F.lower("label").alias("label"))
    return L.with_labels(table(spark, sf_dir, "documents"), labels).select("doc_id", "found_label")


@query("src08_hit_ids", "SELECT file_id, coalesce(nullif(label, ''), nullif(name, ''), id) AS hit_id FROM corpus_files")
def src08_hit_ids(spark, sf_dir):
    return table(spark, sf_dir, "corpus_files").select("file_id", L.hit_id(F.col("label"), F.col("name"), F.col("id")).alias("hit_id"))


@query("src09_name_filter", "SELECT doc_id, name FROM documents WHERE name IS NULL OR name = '' OR NOT (contains(lower(name), 'befund') OR contains(lower(name), 'scan'))")
def src09_name_filter(spark, sf_dir):
    return L.name_filter(table(spark, sf_dir, "documents"), ["Befund", "SCAN"]).select("doc_id", "name")


@query("src09_name_filter_inverse", "SELECT doc_id, name FROM documents WHERE name IS NULL OR name = '' OR contains(lower(name), 'brief')")
def src09_name_filter_inverse(spark, sf_dir):
    return L.name_filter(table(spark, sf_dir, "documents"), ["Brief"], inverse=True).select("doc_id", "name")


@query("prj14_conform_names", "SELECT DISTINCT name, regexp_replace(lower(name), '[ \\t\\n\\r\\f\\x0b]+|-+', '_', 'g') AS conform FROM corpus_files")
def prj14_conform_names(spark, sf_dir):
    return table(spark, sf_dir, "corpus_files").select("name", T.conform_name(F.col("name")).alias("conform")).distinct()


@query("neg06_negated_words", _NEGATION + """SELECT p.doc_id, p.line_no, word_no, word,
  coalesce(bool_or(r.part = p.part AND ((kind = 'preceding' AND r.b < word_no) OR (kind = 'following' AND r.e > word_no + 1))), FALSE) AND NOT coalesce(bool_or(r.b <= word_no AND word_no < r.e), FALSE) AS negated
FROM placed p LEFT JOIN reach r ON p.doc_id = r.doc_id AND p.line_no = r.line_no GROUP BY 1, 2, 3, 4""")
def neg06_negated_words(spark, sf_dir):
    return N.negated_words(_lines(spark, sf_dir), "doc_id", "line_no")


@query("neg03_trigger_matches", _NEGATION + "SELECT doc_id, line_no, kind, b AS first, e AS last FROM m")
def neg03_trigger_matches(spark, sf_dir):
    return N.matches(N.line_words(_lines(spark, sf_dir), "doc_id", "line_no"), "doc_id", "line_no")


@query("neg05_boundaries", "WITH" + _LINES + f""", trig(kind, trig, n) AS (VALUES {_TRIGGERS}),
words AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS w FROM lines),
ends AS (SELECT doc_id, line_no, 0 AS b, len(w) AS n FROM words WHERE len(w) > 0 UNION SELECT doc_id, line_no, i - 1, len(w) FROM (SELECT doc_id, line_no, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN trig ON w[i] = trig AND kind = 'termination')
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY b) - 1 AS part_no, b AS first, coalesce(lead(b) OVER (PARTITION BY doc_id, line_no ORDER BY b), n) AS last FROM ends""")
def neg05_boundaries(spark, sf_dir):
    return N.boundaries(_lines(spark, sf_dir), "doc_id", "line_no")


@query("ag01_negated_reset", _NEGATION + """, p AS (SELECT doc_id, word AS phrase, line_no * 1000000 + word_no AS at, bool_or(FALSE) AS x FROM placed GROUP BY 1, 2, 3), n AS (
SELECT p.doc_id, p.line_no, word_no, word, coalesce(bool_or(r.part = p.part AND ((kind = 'preceding' AND r.b < word_no) OR (kind = 'following' AND r.e > word_no + 1))), FALSE) AND NOT coalesce(bool_or(r.b <= word_no AND word_no < r.e), FALSE) AS negated
FROM placed p LEFT JOIN reach r ON p.doc_id = r.doc_id AND p.line_no = r.line_no GROUP BY 1, 2, 3, 4),
s AS (SELECT doc_id, word AS phrase, negated, struct_pack(d := doc_id, l := line_no, w := word_no) AS seq FROM n),
l AS (SELECT *, max(CASE WHEN negated THEN seq END) OVER (PARTITION BY phrase) AS last FROM s)
SELECT phrase, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents FROM l WHERE last IS NULL OR seq > last GROUP BY phrase""")
def ag01_negated_reset(spark, sf_dir):
    words = N.negated_words(_lines(spark, sf_dir), "doc_id", "line_no")
    seq = F.struct("doc_id", "line_no", "word_no")
    kept = P.skip_negated(words.select("doc_id", F.col("word").alias("phrase"), "negated", seq.alias("seq")), "reset")
    return P.phrase_table(kept)


@query("sc09_normalised_terms", "SELECT DISTINCT p_name AS term, trim(regexp_replace(lower(p_name), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS normalised FROM part")
def sc09_normalised_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), T.normalised_term(F.col("p_name")).alias("normalised")).distinct()


@query("sc10_language_profiles", "SELECT DISTINCT lang, string_split(replace(lower(lang), '_', '-'), '-')[1] AS profile FROM documents")
def sc10_language_profiles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", T.profile(F.col("lang")).alias("profile")).distinct()


@query("ag16_common_language", "SELECT language, n FROM (SELECT language, count(*) AS n FROM pipeline_config GROUP BY 1 ORDER BY n DESC, language LIMIT 1)")
def ag16_common_language(spark, sf_dir):
    return table(spark, sf_dir, "pipeline_config").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


@query("neg07_scoped_words", _NEGATION + """SELECT p.doc_id, p.line_no, word_no, word,
  coalesce(bool_or(r.part = p.part AND ((kind = 'preceding' AND r.b < word_no AND word_no - r.e + 1 <= 3) OR (kind = 'following' AND r.e > word_no + 1 AND r.b - word_no <= 3))), FALSE) AND NOT coalesce(bool_or(r.b <= word_no AND word_no < r.e), FALSE) AS negated
FROM placed p LEFT JOIN reach r ON p.doc_id = r.doc_id AND p.line_no = r.line_no GROUP BY 1, 2, 3, 4""")
def neg07_scoped_words(spark, sf_dir):
    """Triggers that reach three words."""
    return N.negated_words(_lines(spark, sf_dir), "doc_id", "line_no", scope=3)


_PREFIX = " OR ".join(f"starts_with(lower(chunk), '{t} ')" for t in N.TRIGGERS["preceding"])


@query("neg06_negated_prefixes", "WITH" + _CHUNKS + f" SELECT doc_id, line_no, chunk_no, chunk FROM chunks WHERE {_PREFIX}")
def neg06_negated_prefixes(spark, sf_dir):
    """Chunks that begin with a trigger."""
    chunks = P.chunks_of(_lines(spark, sf_dir))
    return chunks.where(N.negated_prefix(F.col("chunk"))).select("doc_id", "line_no", "chunk_no", "chunk")


_OWN_TRIGGERS = ", ".join(f"('{k}', '{t}', {len(t.split(' '))})" for k, ts in N.TermSet("de").add({"preceding": ["von"]}).remove({"termination": ["sonst"]}).terms.items() for t in ts)


@query("neg01_term_sets", _NEGATION.replace(_TRIGGERS, _OWN_TRIGGERS) + "SELECT doc_id, line_no, kind, b AS first, e AS last FROM m")
def neg01_term_sets(spark, sf_dir):
    """Matches of the German set with a trigger more and one less."""
    terms = N.TermSet("de").add({"preceding": ["von"]}).remove({"termination": ["sonst"]}).terms
    return N.matches(N.line_words(_lines(spark, sf_dir), "doc_id", "line_no"), "doc_id", "line_no", terms=terms)


@query("prj06_view_topics", "SELECT DISTINCT lower(label) AS label FROM documents WHERE lower(label) IN ('befund', 'labor')")
def prj06_view_topics(spark, sf_dir):
    return L.View(table(spark, sf_dir, "documents"), ["Befund", "labor"], strict=False).topics()


@query("prj06_view_lines", "WITH" + _LINES + " SELECT doc_id, line_no FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(label) IN ('befund', 'labor'))")
def prj06_view_lines(spark, sf_dir):
    return L.View(table(spark, sf_dir, "documents"), ["Befund", "labor"], strict=False).of(_lines(spark, sf_dir)).select("doc_id", "line_no")


@query("prj07_lookups", "SELECT name, doc_id FROM documents WHERE name IN (SELECT min(name) FROM documents UNION ALL SELECT max(name) FROM documents)")
def prj07_lookups(spark, sf_dir):
    """Ids of the documents with the first and the last name."""
    docs = table(spark, sf_dir, "documents")
    return L.lookup(docs, "name", list(docs.agg(F.min("name"), F.max("name")).first()), "doc_id")


@query("prj07_names_of_label", "SELECT DISTINCT name FROM documents WHERE lower(label) = 'labor' AND name IS NOT NULL")
def prj07_names_of_label(spark, sf_dir):
    return L.of_label(table(spark, sf_dir, "documents"), "Labor", "name")


@query("prj12_allowed_phrases", "WITH" + _CHUNKS + " SELECT DISTINCT phrase FROM occ WHERE phrase IN (SELECT lower(phrase) FROM vector_entries)")
def prj12_allowed_phrases(spark, sf_dir):
    """Phrases of the corpus that the store has too."""
    known = table(spark, sf_dir, "vector_entries").where("phrase is not null").select(F.lower("phrase").alias("phrase"))
    return P.allowed(_found(spark, sf_dir).select("phrase").distinct(), known)


@query("prj14_true_words", "SELECT doc_id, lower(trim(coalesce(label, 'Ja '))) IN ('true', 'yes', 'y', 'ja', 'j', '1') AS yes FROM documents")
def prj14_true_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.true_word(F.coalesce("label", F.lit("Ja "))).alias("yes"))


@query("sc21_single_signs", "SELECT file_id, split_no, text FROM text_splits WHERE regexp_full_match(trim(text), '[^\\p{L}\\p{N}_]')")
def sc21_single_signs(spark, sf_dir):
    """Lines of one sign."""
    return table(spark, sf_dir, "text_splits").where(T.single_sign(F.trim("text"))).select("file_id", "split_no", "text")


@query("sc21_parts", "SELECT doc_id, len(list_filter(string_split(text, '. '), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL")
def sc21_parts(spark, sf_dir):
    """Parts of each text between marks."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(T.parts_between(F.col("text"), ". ")).cast("long").alias("n"))


@query("sc13_token_of_place", "SELECT doc_id, CASE WHEN strpos(text, 'Befund') > 0 THEN len(string_split(substr(text, 1, strpos(text, 'Befund') - 1), ' ')) - 1 END AS token FROM documents")
def sc13_token_of_place(spark, sf_dir):
    """The blank-separated token in which a word begins."""
    tokens = F.split("text", " ", -1)
    starts = A.sums_before(F.transform(tokens, lambda t: F.length(t) + 1))
    rows = table(spark, sf_dir, "documents").withColumn("_t", tokens).withColumn("_s", starts)
    ends = F.zip_with("_s", F.col("_t"), lambda s, t: s + F.length(t))
    return rows.select("doc_id", T.token_at(F.col("_s"), ends, T.place_of(F.lit("Befund"), F.col("text"))).cast("long").alias("token"))


@query("wn03_consecutive_lines", "WITH" + _LINES + " SELECT doc_id, line_no AS left_no, next AS right_no FROM (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM lines) WHERE next IS NOT NULL")
def wn03_consecutive_lines(spark, sf_dir):
    by = _lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("nos"))
    return by.select("doc_id", F.explode(A.pairs(F.col("nos"))).alias("p")).select("doc_id", F.col("p.left").alias("left_no"), F.col("p.right").alias("right_no"))


@query("tk04_first_words", "WITH" + _LINES + " SELECT doc_id, line_no, array_to_string(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')[1:3], ' ') AS head FROM lines")
def tk04_first_words(spark, sf_dir):
    rows = N.line_words(_lines(spark, sf_dir), "doc_id", "line_no")
    return rows.select("doc_id", "line_no", F.array_join(A.first_of(F.col("words"), 3), " ").alias("head"))


@query("jn02_phrase_vectors", "WITH" + _CHUNKS + """, f AS (SELECT phrase, min(struct_pack(d := doc_id, b := CAST("begin" AS BIGINT))) AS first FROM occ GROUP BY 1), i AS (SELECT phrase, row_number() OVER (ORDER BY first.d, first.b) - 1 AS phrase_id FROM f)
SELECT phrase_id, phrase, len(embedding) AS dim FROM i JOIN embeddings ON phrase_id = vec_id""")
def jn02_phrase_vectors(spark, sf_dir):
    """Phrases beside vectors by an explicit id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("phrase_id"), "embedding")
    return P.with_vectors(wn02_phrase_ids(spark, sf_dir), vectors).select("phrase_id", "phrase", F.size("embedding").cast("long").alias("dim"))


@query("snk02_processed_lines", "WITH" + _LINES + ' SELECT doc_id, line_no, CAST("offset" AS BIGINT) AS "offset", len(regexp_extract_all(lower(line), \'[\\p{L}\\p{N}]+\')) AS n_words FROM lines')
def snk02_processed_lines(spark, sf_dir):
    """The lines with their words, stored as a step's table and read back."""
    lines = _lines(spark, sf_dir)
    store = ArtifactStore(spark, scratch_dir(spark))
    saved = store.save(N.line_words(lines, "doc_id", "line_no", "offset"), f"processed-{uuid.uuid4().hex}", "data")
    return saved.select("doc_id", "line_no", "offset", F.size("words").cast("long").alias("n_words"))


@query("wn07_current_steps", "SELECT user_id, min(event_type) AS step, count(DISTINCT event_type) AS n_steps FROM events GROUP BY 1")
def wn07_current_steps(spark, sf_dir):
    """The first step of each process in order of rank, ranks being those of the steps' names."""
    log = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    by = log.groupBy("user_id").agg(F.min_by("event_type", "event_type").alias("step"), F.count("*").alias("n_steps"))
    return by.select("user_id", "step", "n_steps")

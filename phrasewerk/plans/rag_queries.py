"""Queries on chunks, retrieval, expansion, status and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk import streaming as S
from phrasewerk.functions import text as T
from phrasewerk.functions import vectors as VF
from phrasewerk.operators import expansion as E
from phrasewerk.operators import rag as RAG
from phrasewerk.operators import retrieval as R
from phrasewerk.operators import vector_store as VS
from phrasewerk.operators.lines import exploded_lines
from phrasewerk.plans.registry import query
from phrasewerk.plans.text_queries import _LINES
from phrasewerk.sources.store import scratch_dir
from phrasewerk.tables import table

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
#: Questions of the retrieval queries: the names of the parts' types are not asked, but clinical ones.
QUESTIONS = [(1, "Leberzyste nach Eingriff"), (2, "pelvic fracture on the left"), (3, "Allergien Novacillin"), (4, "Physiotherapie zur Nacht unauffällig")]
_Q = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
_BM25 = f"""q(question, q_text) AS (VALUES {_Q}), asked AS (SELECT DISTINCT question, unnest({_WORDS.format('q_text')}) AS word FROM q),
s AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), t AS (SELECT count(*) AS n, avg(len(coalesce(ws, []))) AS mean FROM s),
tf AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS word FROM s) WHERE word IN (SELECT word FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
lex AS (SELECT question, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS lexical FROM tf JOIN df USING (word) JOIN asked USING (word), t GROUP BY 1, 2)"""


def _lexical(spark, sf_dir):
    q = spark.createDataFrame(QUESTIONS, "question int, q_text string")
    return R.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), q, "doc_id", "question")


@query("rg07_lexical_scores", "WITH " + _BM25 + " SELECT question, doc_id, round(lexical, 5) AS lexical FROM lex")
def rg07_lexical_scores(spark, sf_dir):
    return _lexical(spark, sf_dir).withColumn("lexical", F.round("lexical", 5))


#: The built-in encoder: words' grams, hashed to dimensions and counted, of length one.
_ENCODED = f"""sp AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS s FROM documents WHERE text IS NOT NULL),
gr AS (SELECT doc_id, (unicode(substr(s, i, 1)) * 961 + unicode(substr(s, i + 1, 1)) * 31 + unicode(substr(s, i + 2, 1))) % 256 AS dim FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM sp WHERE length(s) > 3)),
en AS (SELECT doc_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, dim, count(*)::DOUBLE AS n FROM gr GROUP BY 1, 2))"""
_DENSE = f"""{_ENCODED}, qs AS (SELECT question, ' ' || array_to_string({_WORDS.format('q_text')}, ' ') || ' ' AS s FROM q),
qg AS (SELECT question, (unicode(substr(s, i, 1)) * 961 + unicode(substr(s, i + 1, 1)) * 31 + unicode(substr(s, i + 2, 1))) % 256 AS dim FROM (SELECT question, s, unnest(range(1, length(s) - 1)) AS i FROM qs)),
qe AS (SELECT question, dim, n / sqrt(sum(n * n) OVER (PARTITION BY question)) AS weight FROM (SELECT question, dim, count(*)::DOUBLE AS n FROM qg GROUP BY 1, 2)),
den AS (SELECT question, doc_id, sum(en.weight * qe.weight) AS dense FROM en JOIN qe USING (dim) GROUP BY 1, 2)"""


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question int, q_text string")


@query("ml01_encoded", f"WITH {_ENCODED} SELECT doc_id, CAST(dim AS INT) AS dim, round(weight, 6) AS weight FROM en")
def ml01_encoded(spark, sf_dir):
    """Every text as a sparse vector of the built-in encoder."""
    return R.encoded(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text").select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("weight", 6).alias("weight"))


@query("rg07_dense_scores", f"WITH {_BM25}, {_DENSE} SELECT question, doc_id, round(dense, 5) AS dense FROM den")
def rg07_dense_scores(spark, sf_dir):
    dense = R.dense_scores(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), _questions(spark), "doc_id", "question")
    return dense.withColumn("dense", F.round("dense", 5))


@query("rg07_hybrid", f"""WITH {_BM25}, {_DENSE}, a AS (SELECT question, doc_id, lexical / max(lexical) OVER (PARTITION BY question) AS l FROM lex), b AS (SELECT question, doc_id, dense / max(dense) OVER (PARTITION BY question) AS d FROM den),
x AS (SELECT question, doc_id, round(0.6::DOUBLE * coalesce(d, 0) + 0.4::DOUBLE * coalesce(l, 0), 9) AS score FROM a FULL OUTER JOIN b USING (question, doc_id))
SELECT question, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 15""")
def rg07_hybrid(spark, sf_dir):
    """BM25 fused with the cosine of the built-in encoder, over all documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    dense = R.dense_scores(docs, _questions(spark), "doc_id", "question")
    return R.fused(_lexical(spark, sf_dir), dense, "doc_id", "question", 0.6, 15).withColumn("score", F.round("score", 5))


_PACKED = """ls AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, line, "offset" AS b, "offset" + length(line) AS e, length(line) AS len FROM lines JOIN documents USING (doc_id)),
cum AS (SELECT *, sum(len) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ls),
tail AS (SELECT x.doc_id, x.i, min(t.i) AS t FROM cum x JOIN cum t ON x.doc_id = t.doc_id AND t.i <= x.i AND (t.i = x.i OR (x.upto - x.len - t.upto + t.len + x.i - 1 - t.i <= 100 AND x.upto - t.upto + t.len + x.i - t.i <= 400)) GROUP BY 1, 2),
walk AS (SELECT doc_id, i, i AS s, 0 AS c FROM ls WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.i, CASE WHEN x.upto - f.upto + f.len + x.i - w.s > 400 THEN tail.t ELSE w.s END, CASE WHEN x.upto - f.upto + f.len + x.i - w.s > 400 THEN w.c + 1 ELSE w.c END
  FROM walk w JOIN cum x ON x.doc_id = w.doc_id AND x.i = w.i + 1 JOIN cum f ON f.doc_id = w.doc_id AND f.i = w.s JOIN tail ON tail.doc_id = x.doc_id AND tail.i = x.i),
chunk AS (SELECT doc_id, c, min(s) AS s, max(i) AS i FROM walk GROUP BY 1, 2),
packed AS (SELECT chunk.doc_id, any_value(name) AS name, c AS chunk_index, min(b) AS chunk_start, max(e) AS chunk_end, string_agg(line, chr(10) ORDER BY ls.i) AS text FROM chunk JOIN ls ON ls.doc_id = chunk.doc_id AND ls.i BETWEEN chunk.s AND chunk.i GROUP BY chunk.doc_id, c)"""


@query("rg02_packed_chunks", "WITH RECURSIVE" + _LINES + ", " + _PACKED + " SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(chunk_start AS BIGINT) AS chunk_start, CAST(chunk_end AS BIGINT) AS chunk_end, text FROM packed")
def rg02_packed_chunks(spark, sf_dir):
    return R.packed_chunks(exploded_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query("rg05_chunk_rows", "WITH RECURSIVE" + _LINES + ", " + _PACKED + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, name AS doc_name, CAST(chunk_index AS INT) AS chunk_index, CAST(chunk_start AS BIGINT) AS chunk_start, CAST(chunk_end AS BIGINT) AS chunk_end, text FROM packed")
def rg05_chunk_rows(spark, sf_dir):
    """The rows of the chunk index of all documents."""
    return RAG.chunks_of(table(spark, sf_dir, "documents"))


@query("jn10_chunks_of_documents", "WITH RECURSIVE" + _LINES + ", " + _PACKED + " SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index FROM packed WHERE doc_id IN (SELECT doc_id FROM doc_ratings)")
def jn10_chunks_of_documents(spark, sf_dir):
    """Chunks of the rated documents only."""
    chunks = R.packed_chunks(exploded_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return R.of_documents(chunks, table(spark, sf_dir, "doc_ratings").where("doc_id is not null")).select("doc_id", "chunk_index")


@query("rg03_packed_sentences", """WITH RECURSIVE ls AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY split_no, text) AS i, text AS line, length(text) AS len FROM (SELECT DISTINCT file_id, split_no, text FROM text_splits WHERE text IS NOT NULL)),
cum AS (SELECT *, sum(len) OVER (PARTITION BY file_id ORDER BY i) AS upto FROM ls),
walk AS (SELECT file_id, i, i AS s, 0 AS c FROM ls WHERE i = 1 UNION ALL
  SELECT x.file_id, x.i, CASE WHEN x.upto - f.upto + f.len + x.i - w.s > 300 THEN x.i ELSE w.s END, CASE WHEN x.upto - f.upto + f.len + x.i - w.s > 300 THEN w.c + 1 ELSE w.c END FROM walk w JOIN cum x ON x.file_id = w.file_id AND x.i = w.i + 1 JOIN cum f ON f.file_id = w.file_id AND f.i = w.s),
chunk AS (SELECT file_id, c, min(s) AS s, max(i) AS i FROM walk GROUP BY 1, 2)
SELECT chunk.file_id, CAST(c AS INT) AS chunk_index, string_agg(line, ' ' ORDER BY ls.i) AS text FROM chunk JOIN ls ON ls.file_id = chunk.file_id AND ls.i BETWEEN chunk.s AND chunk.i GROUP BY chunk.file_id, c""")
def rg03_packed_sentences(spark, sf_dir):
    """Lines as sentences without offsets, without overlap."""
    lines = table(spark, sf_dir, "text_splits").select("file_id", "split_no", "text").distinct()
    return R.packed_sentences(lines, "file_id", "split_no", "text", 300, 0, " ")


@query("rg01_runs", "SELECT file_id, split_no, last_value(CASE WHEN split_no % 3 <> 1 THEN file_id END IGNORE NULLS) OVER (ORDER BY file_id, split_no ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT DISTINCT file_id, split_no FROM text_splits)")
def rg01_runs(spark, sf_dir):
    """Lines of which a third lost their document: they join the one before them."""
    lines = table(spark, sf_dir, "text_splits").select("file_id", "split_no", F.when(F.col("split_no") % 3 != 1, F.col("file_id")).alias("own"), F.struct("file_id", "split_no").alias("at")).distinct()
    return R.runs(lines, "own", "at").select("file_id", "split_no", "run")


@query("rg08_snippets", """WITH f AS (SELECT file_id, split_no, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS flat FROM text_splits WHERE text IS NOT NULL), t AS (SELECT *, string_split(flat, ' ') AS ts, CASE WHEN strpos(flat, 'Befund') > 0 THEN strpos(flat, 'Befund') - 1 END AS pos FROM f),
m AS (SELECT *, len(string_split(substr(flat, 1, coalesce(pos, 0) + 3), ' ')) - 1 AS mid, len(ts) AS n FROM t),
s AS (SELECT file_id, split_no, flat, CASE WHEN n <= 12 THEN flat WHEN pos IS NULL THEN array_to_string(ts[1:12], ' ') ELSE array_to_string(list_slice(ts, greatest(0, least(mid - 6, n - 12)) + 1, greatest(0, least(mid - 6, n - 12)) + 12), ' ') END AS snippet FROM m)
SELECT file_id, split_no, snippet, CASE WHEN length(snippet) > 0 AND strpos(flat, snippet) > 0 THEN strpos(flat, snippet) - 1 END AS snippet_at FROM s""")
def rg08_snippets(spark, sf_dir):
    """Twelve tokens of every line, around a highlight where there is one."""
    hits = table(spark, sf_dir, "text_splits").where("text is not null").withColumn("highlight", F.lit("Befund"))
    return R.snippets(hits, "text", "highlight", 12).select("file_id", "split_no", "snippet", F.col("snippet_at").cast("long").alias("snippet_at"))


@query("rg10_prompts", f"""WITH p AS (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY split_no) AS t FROM (SELECT DISTINCT file_id, split_no, text FROM text_splits) GROUP BY 1)
SELECT file_id, replace(replace('{RAG.TEMPLATES['en']}', '{{summaries}}', coalesce(t, '')), '{{question}}', 'What is the finding?') AS prompt FROM p""")
def rg10_prompts(spark, sf_dir):
    """A prompt over the lines of each file."""
    by = R.joined_by_document(table(spark, sf_dir, "text_splits").select("file_id", "split_no", "text").distinct(), "file_id", "split_no", "text")
    return by.select("file_id", T.filled(RAG.resolve_prompt("en").template, summaries=F.col("text"), question=F.lit("What is the finding?")).alias("prompt"))


@query("sc15_no_source_answers", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'Keine Quelle die ich finden kann.' ELSE 'No source I can find.' END AS answer FROM documents")
def sc15_no_source_answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.no_source_answer(F.col("lang")).alias("answer"))


@query("rg11_answers")
def rg11_answers(spark, sf_dir):
    """Answers to the questions from the chunks of all documents, by a chatter that repeats its first source."""
    store = RAG.TableChunkStore(spark, scratch_dir(spark), f"rag-{uuid.uuid4().hex}")
    rag = RAG.Rag.of(store, lambda prompt: "<think>...</think> Final answer: " + prompt.split("Source [0]: ")[1][:60])
    rag.fill(table(spark, sf_dir, "documents").select("doc_id", "name", "text"))
    if rag.error:
        raise rag.error
    return rag.ask(_questions(spark))


@query("rg09_numbered_sources", """SELECT file_id AS question, nr - 1 AS source_no, 'Source [' || (nr - 1) || ']: ' || text AS source
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY split_no) AS nr FROM (SELECT DISTINCT file_id, split_no, text FROM text_splits))""")
def rg09_numbered_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "text_splits").select(F.col("file_id").alias("question"), "split_no", "text").distinct()
    return R.numbered_sources(lines, "question", "split_no", "text")


@query("ag14_joined_by_document", """SELECT file_id, min(split_no) AS first_rank, string_agg(text, chr(10) || chr(10) ORDER BY split_no) AS text FROM (SELECT DISTINCT file_id, split_no, text FROM text_splits) GROUP BY 1""")
def ag14_joined_by_document(spark, sf_dir):
    return R.joined_by_document(table(spark, sf_dir, "text_splits").select("file_id", "split_no", "text").distinct(), "file_id", "split_no", "text")


@query("sc11_highlight_places", "SELECT doc_id, CASE WHEN strpos(text, 'Befund') > 0 THEN strpos(text, 'Befund') - 1 END AS place FROM documents")
def sc11_highlight_places(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.place_of(F.lit("Befund"), F.col("text")).cast("long").alias("place"))


@query("sc12_cut_start", "SELECT file_id, split_no, array_to_string(string_split(text, ' ')[1:8], ' ') AS head, array_to_string(string_split(text, ' ')[greatest(1, len(string_split(text, ' ')) - 7):], ' ') AS tail FROM text_splits")
def sc12_cut_start(spark, sf_dir):
    ts = F.split("text", " ")
    return table(spark, sf_dir, "text_splits").select("file_id", "split_no", T.cut_start(ts, 8).alias("head"), T.cut_end(ts, 8).alias("tail"))


@query("sc04_sequence_ratios", """WITH p AS (SELECT process_name, entry_id, min(phrase) AS a FROM vector_entries WHERE phrase IS NOT NULL GROUP BY 1, 2), x AS (SELECT process_name, entry_id, a, lead(a) OVER (PARTITION BY process_name ORDER BY entry_id) AS b FROM p),
m AS (SELECT process_name, entry_id, a, b, length(a) AS la, length(b) AS lb, (1::HUGEINT << length(a)) - 1 AS whole, map_from_entries(list_transform(list_distinct(string_split(a, '')), lambda c: (c, list_sum(list_transform(range(0, length(a)), lambda i: CASE WHEN substr(a, CAST(i AS INT) + 1, 1) = c THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END))))) AS m FROM x WHERE b IS NOT NULL)
SELECT process_name, entry_id, round(CASE WHEN la + lb = 0 THEN 1.0 WHEN la = 0 OR lb = 0 THEN 0.0 ELSE 2.0::DOUBLE * (la - bit_count(list_reduce(list_prepend(whole, list_transform(string_split(b, ''), lambda c: coalesce(m[c], 0::HUGEINT))), lambda r, h: ((r + (r & h)) | (r - (r & h))) & whole))) / (la + lb) END, 6) AS ratio FROM m""")
def sc04_sequence_ratios(spark, sf_dir):
    """Each phrase of a process against the next one."""
    rows = table(spark, sf_dir, "vector_entries").where("phrase is not null").groupBy("process_name", "entry_id").agg(F.min("phrase").alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("process_name").orderBy("entry_id"))).where("b is not null")
    return rows.select("process_name", "entry_id", F.round(T.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("sc14_clean_answers", """SELECT doc_id, trim(regexp_replace(regexp_replace('<think>' || coalesce(source, '') || '</think> Final answer: ' || coalesce(name, ''), '<think>.*?</think>', '', 'gis'), '^.*\\bfinal answer\\s*:\\s*', '', 'is')) AS answer FROM documents""")
def sc14_clean_answers(spark, sf_dir):
    raw = F.concat(F.lit("<think>"), F.coalesce("source", F.lit("")), F.lit("</think> Final answer: "), F.coalesce("name", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_answer(raw).alias("answer"))


@query("sc16_fenced_json", "SELECT entry_id, added_at::VARCHAR <> '' AS ok, json_extract_string(metadata, '$.category') AS category FROM vector_entries")
def sc16_fenced_json(spark, sf_dir):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("metadata"), F.lit("\n```"))
    return table(spark, sf_dir, "vector_entries").select("entry_id", F.col("added_at").isNotNull().alias("ok"), F.get_json_object(T.fenced_json(reply), "$.category").alias("category"))


_CATEGORY = "json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.category')"
_NORM = "regexp_replace(regexp_replace(lower({0}), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), '^ +| +$', '', 'g')"
_TERMS = f"""ent AS (SELECT entry_id, phrase, {_CATEGORY} AS category, lower(coalesce(source, '')) AS source FROM vector_entries WHERE phrase IS NOT NULL),
terms AS (SELECT CAST(min(entry_id) AS VARCHAR) AS id, phrase AS term, phrase || ' (S)' AS synonym, category AS c FROM ent WHERE source <> 'document_addition' GROUP BY phrase, category),
look AS (SELECT {_NORM.format('term')} AS norm, term AS matched_term, 'exact' AS relation, id AS source_id, c FROM terms UNION ALL SELECT {_NORM.format('synonym')}, synonym, 'synonym', id, c FROM terms),
cand AS (SELECT DISTINCT '  ' || phrase || ' ' AS term, category FROM ent UNION SELECT DISTINCT phrase || ' (s)', category FROM ent WHERE source = 'document_addition'),
ev AS (SELECT cand.term, category, matched_term, relation, source_id FROM cand JOIN look ON norm = {_NORM.format('cand.term')} AND norm <> '' AND (c IS NULL OR c = category)),
free AS (SELECT term, category FROM cand WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.term = cand.term AND ev.category IS NOT DISTINCT FROM cand.category))"""


def _evidence(spark, sf_dir):
    """The store's phrases as a terminology; those of all entries as candidates, some with a category, some without."""
    rows = table(spark, sf_dir, "vector_entries").where("phrase is not null")
    rows = rows.select("entry_id", "phrase", F.get_json_object("metadata", "$.category").alias("category"), F.lower(F.coalesce("source", F.lit(""))).alias("source"))
    old = rows.where("source <> 'document_addition'").groupBy("phrase", "category").agg(F.min("entry_id").cast("string").alias("id"))
    terms = old.select("id", F.col("phrase").alias("term"), F.array(F.concat("phrase", F.lit(" (S)"))).alias("synonyms"), F.when(F.col("category").isNotNull(), F.array("category")).otherwise(F.array().cast("array<string>")).alias("categories"))
    known = rows.select(F.concat(F.lit("  "), "phrase", F.lit(" ")).alias("term"), "category")
    others = rows.where("source = 'document_addition'").select(F.concat("phrase", F.lit(" (s)")).alias("term"), "category")
    return E.grounded(known.unionByName(others).distinct(), terms)


@query("qe03_grounded", "WITH " + _TERMS + """ SELECT term, category, matched_term, relation, source_id, 1.0::DOUBLE AS score FROM ev
UNION ALL SELECT term, category, NULL, NULL, NULL, 0.0 FROM free""")
def qe03_grounded(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query("qe04_statuses", "WITH " + _TERMS + " SELECT term, category, 1.0::DOUBLE AS confidence, count(*) AS n_evidence, 'grounded' AS status FROM ev GROUP BY 1, 2 UNION ALL SELECT term, category, 0.0, 0, 'llm_only' FROM free")
def qe04_statuses(spark, sf_dir):
    return E.statuses(_evidence(spark, sf_dir), ["term", "category"], reject=False)


@query("qe05_by_category", "WITH " + _TERMS + " SELECT c AS category, coalesce((SELECT string_agg(DISTINCT term, '|' ORDER BY term) FROM ev WHERE category = c), '') AS terms FROM (SELECT unnest(['symptom', 'anatomy', 'none']) AS c)")
def qe05_by_category(spark, sf_dir):
    """Grounded terms of the requested categories."""
    rows = _evidence(spark, sf_dir).where("score > 0").select("term", "category")
    return E.by_category(rows, ["symptom", "anatomy", "none"]).withColumn("terms", F.array_join("terms", "|"))


@query("qe05_expanded", "WITH " + _TERMS + """, j AS (SELECT term, category, 'grounded' AS status, 1.0 AS confidence FROM ev UNION SELECT term, category, 'llm_only', 0.0 FROM free)
SELECT c AS category, (SELECT count(*) FROM j WHERE j.category = c) AS n, (SELECT count(*) FROM j WHERE j.category = c AND status = 'grounded') AS n_grounded FROM (SELECT unnest(['symptom', 'medication', 'procedure']) AS c)""")
def qe05_expanded(spark, sf_dir):
    """A request for three categories, its candidates being all phrases: candidates and grounded ones of each."""
    rows = table(spark, sf_dir, "vector_entries").where("phrase is not null")
    rows = rows.select("entry_id", "phrase", F.get_json_object("metadata", "$.category").alias("category"), F.lower(F.coalesce("source", F.lit(""))).alias("source"))
    old = rows.where("source <> 'document_addition'").groupBy("phrase", "category").agg(F.min("entry_id").cast("string").alias("id"))
    terms = old.select("id", F.col("phrase").alias("term"), F.array(F.concat("phrase", F.lit(" (S)"))).alias("synonyms"), F.when(F.col("category").isNotNull(), F.array("category")).otherwise(F.array().cast("array<string>")).alias("categories"))
    known = rows.select(F.concat(F.lit("  "), "phrase", F.lit(" ")).alias("term"), "category").unionByName(rows.where("source = 'document_addition'").select(F.concat("phrase", F.lit(" (s)")).alias("term"), "category"))
    request = E.Request("store", categories=("symptom", "medication", "procedure"), minimum_score=0.5)
    out = E.expanded(spark, request, known.distinct().withColumn("rationale", F.lit(None).cast("string")), [terms])
    n = lambda f: F.size(F.filter("candidates", f)).cast("long")
    return out.select("category", F.size("candidates").cast("long").alias("n"), n(lambda c: c["status"] == "grounded").alias("n_grounded"))


@query("qe01_candidates", f"SELECT DISTINCT entry_id, phrase AS term, {_CATEGORY} AS category FROM vector_entries WHERE regexp_matches(phrase, '[^ ]') AND {_CATEGORY} IN ({', '.join(repr(c) for c in E.CATEGORIES)})")
def qe01_candidates(spark, sf_dir):
    """Candidates read from replies in JSON, one for each entry."""
    rows = table(spark, sf_dir, "vector_entries").where("phrase is not null")
    reply = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("phrase").alias("term"), F.get_json_object("metadata", "$.category").alias("category"))).alias("candidates"))), F.lit("\n```"))
    return E.candidates_of(rows.select("entry_id", reply.alias("reply")), "entry_id").select("entry_id", "term", "category").distinct()


def _vector_store(spark, sf_dir):
    """A new vector store that took the usable entries of the table, numbered by entry_id."""
    rows = table(spark, sf_dir, "vector_entries").where("size(phrase_vector) = 64 and entry_id is not null")
    once = rows.groupBy("entry_id").agg(F.min(F.struct("phrase", "phrase_vector", "graph_cluster", "documents", "source")).alias("e"))
    own = once.select(F.col("entry_id").alias("nr"), "e.phrase", F.col("e.phrase_vector").alias("vector"), "e.graph_cluster", "e.documents", "e.source")
    store = VS.VectorStore(spark, scratch_dir(spark), f"store-{uuid.uuid4().hex}", VS.IndexSettings(dim=64)).create()
    return store, store.store(own)[0]


_STORED = "st AS (SELECT entry_id AS nr, row_number() OVER (ORDER BY entry_id) - 1 AS entry_id, phrase, documents FROM (SELECT entry_id, min(phrase) AS phrase, any_value(documents) AS documents FROM vector_entries WHERE len(phrase_vector) = 64 GROUP BY 1))"


@query("snk05_stored", f"WITH {_STORED} SELECT nr, entry_id FROM st")
def snk05_stored(spark, sf_dir):
    """Ids that an append gives, in order."""
    return _vector_store(spark, sf_dir)[1]


@query("src18_read_back", f"WITH {_STORED} SELECT s.entry_id, round(list_sum(v), 3) AS total FROM st s JOIN (SELECT entry_id, min(CAST(phrase_vector AS DOUBLE[])) AS v FROM vector_entries GROUP BY 1) x ON s.nr = x.entry_id")
def src18_read_back(spark, sf_dir):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _vector_store(spark, sf_dir)[0].read_back().select("entry_id", F.round(total, 3).alias("total"))


@query("vs04_updated", f"WITH {_STORED} SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'new' ELSE phrase END AS phrase FROM st")
def vs04_updated(spark, sf_dir):
    """Every other entry gets another phrase."""
    store, _ = _vector_store(spark, sf_dir)
    store.update(store.entries().where("entry_id % 2 = 0").select("entry_id", F.lit("new").alias("phrase")))
    return store.entries().select("entry_id", "phrase")


@query("vs05_deleted", f"WITH {_STORED} SELECT entry_id FROM st WHERE entry_id % 3 <> 0")
def vs05_deleted(spark, sf_dir):
    store, _ = _vector_store(spark, sf_dir)
    store.delete(store.entries().where("entry_id % 3 = 0").select("entry_id"))
    return store.entries().select("entry_id")


@query("vs06_provenance_removed", f"""WITH {_STORED}, d AS (SELECT min(id) AS d FROM corpus_files), x AS (SELECT entry_id, len(coalesce(documents, [])) AS m, len(list_filter(coalesce(documents, []), lambda c: c.id IS DISTINCT FROM d)) AS rest FROM st, d)
SELECT entry_id, rest AS n_documents FROM x WHERE NOT (m > rest AND rest = 0)""")
def vs06_provenance_removed(spark, sf_dir):
    """The store after a document was taken out and what named no other deleted."""
    store, _ = _vector_store(spark, sf_dir)
    store.remove_provenance(table(spark, sf_dir, "corpus_files").agg(F.min("id")).first()[0], True)
    return store.entries().select("entry_id", F.greatest(F.size(F.coalesce("documents", F.array().cast(VS.V.DOCUMENTS))), F.lit(0)).cast("long").alias("n_documents"))


@query("vs08_added_document", f"""WITH {_STORED}, d AS (SELECT min(id) AS one FROM corpus_files), x AS (SELECT s.entry_id, s.phrase, s.documents, e.v, e.g FROM st s JOIN (SELECT entry_id AS nr, min(CAST(phrase_vector AS DOUBLE[])) AS v, any_value(graph_cluster) AS g FROM vector_entries WHERE len(phrase_vector) = 64 GROUP BY 1) e USING (nr)),
a AS (SELECT x.* FROM x, d WHERE len(list_filter(coalesce(documents, []), lambda c: c.id = one)) > 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
r AS (SELECT a.entry_id AS nr, a.phrase, min(b.entry_id) AS entry_id FROM a JOIN x b ON len(list_filter(b.v, lambda c: c <> 0)) > 0 AND list_cosine_similarity(a.v, b.v) >= 0.999 GROUP BY 1, 2)
SELECT CASE WHEN x.g[1] IS NULL THEN 'without_graph_incorporated' ELSE 'with_graph_incorporated' END AS kind, r.phrase, r.entry_id FROM r JOIN x ON r.entry_id = x.entry_id""")
def vs08_added_document(spark, sf_dir):
    """The phrases of the corpus's first file added again as a new document: all are retained, and have a graph or not."""
    store, _ = _vector_store(spark, sf_dir)
    one = table(spark, sf_dir, "corpus_files").agg(F.min("id")).first()[0]
    mine = store.entries().where(F.exists("documents", lambda d: d["id"] == one) & VF.usable(F.col("vector"))).select(F.col("entry_id").alias("nr"), F.lit("new").alias("document"), "phrase", "vector", F.lit(None).cast("array<array<int>>").alias("offsets"))
    out = VS.VectorDocumentStore(store).add_documents(mine)
    rows = None
    for kind, found in out.items():
        own = found.select(F.lit(kind).alias("kind"), "phrase", "entry_id")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query("pc07_latest_status", "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts IS NOT NULL) WHERE r = 1")
def pc07_latest_status(spark, sf_dir):
    log = table(spark, sf_dir, "events").where("ts is not null").withColumn("status", F.col("event_type"))
    return S.latest_status(log, ["user_id"], "status", "ts", "event_id").select("user_id", "status")


@query("st_windowed_counts", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.windowed_counts(rows)
    return got.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n", F.round("total", 3).alias("total"))

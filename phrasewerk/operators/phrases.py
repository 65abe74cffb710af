"""Phrases of lines: extraction, surface forms, provenance, document frequency and TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phrasewerk.functions.arrays import sums_before

#: A chunk of the built-in extractor: words in small letters before one or more capitalised words.
CHUNK = r"(?:\p{Ll}{3,} )?\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}{3,})*"
#: Words that are cut off at the ends of a chunk.
STOP_WORDS = (
    "der die das den dem des ein eine einen einem einer kein keine keinen im in am an auf aus bei mit nach von vom zu zum zur und oder wie sich nicht ist war wurde "
    "the a an of at in on for with and or is was were no not this that"
).split()

Extractor = Callable[[DataFrame], DataFrame]


def chunks_of(lines: DataFrame, key: str = "doc_id", line: str = "line", pattern: str = CHUNK) -> DataFrame:
    """*lines* with (chunk_no, chunk, begin, end): the matches of *pattern* on each line, places in the document.

    The text between the matches is split off with the same pattern, so places are prefix sums of both, on the JVM.
    """
    found = F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(0))
    rows = lines.withColumn("_m", found).withColumn("_g", F.split(F.col(line), pattern, -1)).where(F.size("_m") > 0)
    gaps = F.slice("_g", F.lit(1), F.size("_m"))  # the text before each match
    before = sums_before(F.zip_with(gaps, F.col("_m"), lambda g, m: F.length(g) + F.length(m)))
    places = F.zip_with(before, gaps, lambda at, g: at + F.length(g))
    rows = rows.withColumn("_b", places).select(*lines.columns, F.posexplode(F.arrays_zip("_m", "_b")).alias("chunk_no", "_c"))
    begin = F.col("offset") + F.col("_c._b")
    return rows.select(*lines.columns, "chunk_no", F.col("_c._m").alias("chunk"), begin.alias("begin"), (begin + F.length("_c._m")).alias("end"))


def clean_chunks(chunks: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Chunks without their stop words; those whose head (the last token) is one fall out. Adds tokens and head.

    A token that is a stop word or not made of letters is left out wherever it stands; begin moves behind the whole run
    of them that the chunk begins with.
    """
    tokens = F.split("chunk", " ")
    stops = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    drop = lambda t: F.array_contains(stops, F.lower(t)) | ~t.rlike(r"^\p{L}+$")
    rows = chunks.withColumn("_t", tokens).withColumn("tokens", F.filter(tokens, lambda t: ~drop(t)))
    rows = rows.where(~drop(F.element_at("_t", -1)))
    ahead = F.slice("_t", F.lit(1), F.array_position(F.transform("_t", drop), False).cast("int") - 1)
    moved = F.aggregate(ahead, F.lit(0), lambda s, t: s + F.length(t) + 1)
    return rows.withColumn("begin", F.col("begin") + moved).withColumn("head", F.element_at("tokens", -1)).drop("_t")


def surface(tokens: Column, head_only: bool = False, prepend_head: bool = False, case_sensitive: bool = False) -> Column:
    """The phrase of a chunk: its head, its head before the other tokens, or all tokens in order; in lower case unless told otherwise."""
    head = F.element_at(tokens, -1)
    if head_only:
        text = head
    elif prepend_head:
        text = F.array_join(F.concat(F.array(head), F.slice(tokens, F.lit(1), F.size(tokens) - 1)), " ")
    else:
        text = F.array_join(tokens, " ")
    return text if case_sensitive else F.lower(text)


def occurrences(chunks: DataFrame, key: str = "doc_id", **form) -> DataFrame:
    """(phrase, key, begin, end) of cleaned chunks."""
    return chunks.select(surface(F.col("tokens"), **form).alias("phrase"), key, "begin", "end")


def skip_negated(chunks: DataFrame, mode: str = "skip", order: str = "seq") -> DataFrame:
    """Occurrences (phrase, negated, order) without negated ones; mode "reset" also drops what came before a phrase's last negated one."""
    if mode == "skip":
        return chunks.where(~F.coalesce("negated", F.lit(False)))
    last = chunks.where("negated").groupBy("phrase").agg(F.max(order).alias("_last"))  # summed before the shuffle, also of a hot phrase
    return chunks.join(last, "phrase", "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def phrase_table(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(phrase, n_documents, n_occurrences) of occurrences (phrase, key); two counts in one shuffle by partial sums for each document."""
    by = found.groupBy("phrase", key).agg(F.count("*").alias("n"))
    return by.groupBy("phrase").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_occurrences"))


def provenance(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(phrase, key, n, offsets): the places of each phrase in each document, in order. A list is as long as one document allows."""
    return found.groupBy("phrase", key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("begin").alias("b"), F.col("end").alias("e")))).alias("offsets"))


def frequency_filter(phrases: DataFrame, n_documents: int, min_df: int = 1, max_df: float = 1.0, stop: list[str] | None = None) -> DataFrame:
    """Phrases in at least *min_df* documents and at most the share *max_df* of them, stop phrases left out."""
    kept = phrases.where((F.col("n_documents") >= min_df) & (F.col("n_documents") <= max_df * n_documents))
    return kept.where(~F.col("phrase").isin(stop)) if stop else kept


def tf_idf(found: DataFrame, n_documents: int, key: str = "doc_id") -> DataFrame:
    """(key, phrase, tfidf): counts times ln((1 + N) / (1 + df)) + 1, of length one in each document."""
    tf = found.groupBy(key, "phrase").agg(F.count("*").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + F.lit(n_documents)) / (1 + F.col("df"))) + 1
    raw = tf.join(df, "phrase").withColumn("raw", F.col("tf") * idf)
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, key).select(key, "phrase", (F.col("raw") / F.col("length")).alias("tfidf"))


def min_max(weights: DataFrame, n_documents: int, by: str = "phrase", value: str = "tfidf") -> DataFrame:
    """*weights* with scaled: (value - min) / (max - min) of each column, where documents without the phrase count as 0; 0 for a constant column."""
    ends = weights.groupBy(by).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.count("*").alias("_n"))
    low = F.when(F.col("_n") < n_documents, 0.0).otherwise(F.col("_lo"))
    return weights.join(ends, by).withColumn("scaled", F.coalesce((F.col(value) - low) / F.nullif(F.col("_hi") - low, F.lit(0.0)), F.lit(0.0))).drop("_hi", "_lo", "_n")


def scaled_tf_idf(counts: DataFrame, sizes: DataFrame, group: str, key: str, phrase: str) -> DataFrame:
    """(group, key, phrase, scaled): tf_idf and min_max within each group. *counts* has group, key, phrase, tf; *sizes* group, n_documents."""
    df = counts.groupBy(group, phrase).agg(F.count("*").alias("_df"))
    idf = F.log((1.0 + F.col("n_documents")) / (1 + F.col("_df"))) + 1
    raw = counts.join(df, [group, phrase]).join(sizes, group).withColumn("_raw", F.col("tf") * idf)
    length = raw.groupBy(group, key).agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_length"))
    value = raw.join(length, [group, key]).withColumn("_v", F.col("_raw") / F.col("_length"))
    ends = value.groupBy(group, phrase).agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    low = F.when(F.col("_df") < F.col("n_documents"), 0.0).otherwise(F.col("_lo"))
    scaled = F.coalesce((F.col("_v") - low) / F.nullif(F.col("_hi") - low, F.lit(0.0)), F.lit(0.0))
    return value.join(ends, [group, phrase]).select(group, key, phrase, scaled.alias("scaled"))


def allowed(phrases: DataFrame, allow: DataFrame | None, phrase: str = "phrase") -> DataFrame:
    """The phrases of an allow list (a table with the same column); all for None."""
    return phrases if allow is None else phrases.join(allow.select(phrase).distinct(), phrase, "left_semi")


def with_vectors(phrases: DataFrame, vectors: DataFrame, key: str = "phrase_id") -> DataFrame:
    """Phrases beside their vectors, by an explicit key; phrases without a vector fall out."""
    return phrases.join(vectors, key)


def row_normalised(scores: DataFrame, by: str, value: str = "score") -> DataFrame:
    """*scores* with normalised: value over the length of its row; 0 in a row of zeros."""
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(by)))
    return scores.where(F.col(by).isNotNull()).withColumn("normalised", F.coalesce(F.col(value) / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


def joined_texts(rows: DataFrame, by: str, text: str, order: list[str], every: DataFrame | None = None) -> DataFrame:
    """(by, words): the texts of each concept or document in order, one blank between them; an empty text for those of *every* without any."""
    got = rows.where(F.col(text).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_t"))
    got = got.select(by, F.array_join("_t._text", " ").alias("words"))
    return got if every is None else every.select(by).distinct().join(got, by, "left").select(by, F.coalesce("words", F.lit("")).alias("words"))


def concept_scores(document_words: DataFrame, concept_weights: DataFrame, key: str = "doc_id", concept: str = "concept") -> DataFrame:
    """(key, concept, score): for each document and concept the sum of the concept's weights of the words that the document has.

    *document_words* has key and word, counted once for each document; *concept_weights* concept, word, tfidf. A join
    on the word takes the place of all documents by all concepts.
    """
    once = document_words.select(key, "word").distinct()
    return once.join(concept_weights, "word").groupBy(key, concept).agg(F.sum("tfidf").alias("score"))


#: Rows of a group's documents that are scored in one task, about.
DOCUMENT_ROWS = 40_000
#: Between words and weights, which go to Python as one text: Spark measures a batch anew with each row, and a list in it from its beginning.
BETWEEN = "\x1f"
#: Values of a matrix of weights (32 MB), rows that leave a task at once, values that are added up at once.
WEIGHT_CELLS, SCORES, AT_ONCE = 4_000_000, 100_000, 100_000


class _WordWeights:
    """The weights of a group's concepts by word: a matrix with a column for each concept, as many columns at a time as fit."""

    def __init__(self, rows: pa.Table):
        self.concepts, words = rows["k"].combine_chunks(), pc.list_flatten(pc.split_pattern(rows["words"], BETWEEN))
        self.words = pc.unique(words)
        values = pc.split_pattern(rows["tfidf"], BETWEEN)
        self.word, self.at, self.value = self.ids(words), pc.list_parent_indices(values).to_numpy(), pc.list_flatten(values).cast("double").to_numpy()
        self.width = max(1, min(len(self.concepts), SCORES, WEIGHT_CELLS // max(1, len(self.words))))
        self.first, self.matrix = -1, None

    def ids(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, -1 for those that no concept has."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)

    def columns(self, first: int) -> np.ndarray:
        if first != self.first:
            i, j = np.searchsorted(self.at, [first, first + self.width])
            cells = self.word[i:j] * self.width + self.at[i:j] - first
            self.first, self.matrix = first, np.bincount(cells, self.value[i:j], len(self.words) * self.width).reshape(-1, self.width)
        return self.matrix

    def scores(self, doc: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, concept, score) above 0 of pairs (doc, word), each there once and in order of doc, some at a time."""
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        ends = np.append(starts[1:], len(doc))
        for first in range(0, len(self.concepts), self.width):
            m = self.columns(first)
            for lo in range(0, len(starts), step := max(1, SCORES // self.width)):
                hi, score = min(lo + step, len(starts)), []
                while lo < hi:
                    to = max(lo + 1, min(hi, np.searchsorted(ends, starts[lo] + AT_ONCE // self.width, "right")))
                    score.append(np.add.reduceat(m[word[starts[lo] : ends[to - 1]]], starts[lo:to] - starts[lo], axis=0))
                    lo = to
                score = np.concatenate(score)
                d, c = np.nonzero(score)
                yield doc[starts[hi - len(score) + d]], first + c, score[d, c]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, part, k, words, tfidf), of each group's part first the concepts, then the documents in order, to rows (g, k, c, score). Held are the weights of one group, one batch and the words of one document."""
    own, held, weights, rest = None, [], None, None

    def found(names: pa.Array, doc: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d, c, score in weights.scores(doc, word):
            cols = [pa.repeat(own[0], len(d)), names.take(pa.array(d)), weights.concepts.take(pa.array(c)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["g", "k", "c", "score"])

    def last() -> Iterator[pa.RecordBatch]:
        if rest is not None:
            yield from found(rest[0], np.zeros(len(rest[1]), int), rest[1])

    for batch in batches:
        kinds = pa.RecordBatch.from_arrays([batch["g"], batch["part"], pc.is_null(batch["tfidf"])], ["g", "part", "document"])
        cuts = np.unique([0, *(e for c in kinds.columns for e in pc.run_end_encode(c).run_ends.to_pylist())]).tolist()
        for i, j in zip(cuts, cuts[1:]):
            piece = batch.slice(i, j - i)
            if own != (mine := (piece["g"][0], piece["part"][0])):
                yield from last()
                own, held, weights, rest = mine, [], None, None
            if not kinds["document"][i].as_py():
                held.append(piece)
                continue
            if not held:  # the group has no concepts
                continue
            weights = weights or _WordWeights(pa.Table.from_batches(held).combine_chunks())
            runs = pc.run_end_encode(piece["k"])
            names = runs.values
            words = pc.split_pattern(piece["words"], BETWEEN)
            doc = np.repeat(np.arange(len(names)), np.diff(runs.run_ends.to_numpy(), prepend=0))[pc.list_parent_indices(words).to_numpy()]
            word = weights.ids(pc.list_flatten(words))
            if rest is not None and rest[0][0] == names[0]:  # its rows go on here
                doc, word = np.concatenate([np.zeros(len(rest[1]), int), doc]), np.concatenate([rest[1], word])
            else:
                yield from last()
            size = max(1, len(weights.words))
            both = np.unique(doc[word >= 0] * size + word[word >= 0])  # a word of a document counts once
            doc, word = both // size, both % size
            open_ = np.searchsorted(doc, len(names) - 1)
            rest = names[-1:], word[open_:]
            yield from found(names, doc[:open_], word[:open_])
    yield from last()


def concept_scores_within(documents: DataFrame, concept_weights: DataFrame, sizes: dict, group: str, key: str, concept: str) -> DataFrame:
    """(group, key, concept, score) as concept_scores, for documents and concepts of the same group: a document's words are added up where its group's concepts are, no pair of a word and a concept is shuffled or held.

    *documents* has group, key and lists of words, *concept_weights* group, concept, word and tfidf above 0, *sizes*
    about how many rows each group has: the documents of large groups go to several tasks, each with all its concepts.
    """
    parts = {g: -(-n // DOCUMENT_ROWS) for g, n in sizes.items() if n > DOCUMENT_ROWS}
    number = F.lit(1)
    for g, n in parts.items():
        number = F.when(F.col(group) == g, n).otherwise(number)
    number = number.cast("long")
    tasks = max(1, min(len(sizes) - len(parts) + sum(parts.values()), max(200, 2 * sum(sizes.values()) // DOCUMENT_ROWS)))
    of, part = F.col(group).cast("string").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("part")
    packed = concept_weights.where("word is not null and tfidf is not null").groupBy(group, concept).agg(F.collect_list(F.struct("word", F.col("tfidf").cast("string").alias("tfidf"))).alias("w"))  # as many as a concept has words
    packed = packed.select(group, concept, F.array_join("w.word", BETWEEN).alias("words"), F.array_join("w.tfidf", BETWEEN).alias("tfidf"))
    held = packed.select(of, part, F.col(concept).cast("string").alias("k"), "words", "tfidf")
    sent = documents.select(of, F.pmod(F.xxhash64(key), number).alias("part"), F.col(key).cast("string").alias("k"), F.when(F.size("words") > 0, F.array_join("words", BETWEEN)).alias("words"), F.lit(None).cast("string").alias("tfidf"))
    rows = held.unionByName(sent).repartition(tasks, "g", "part").sortWithinPartitions("g", "part", F.col("tfidf").isNull(), "k")
    return rows.mapInArrow(_scored, "g string, k string, c string, score double").toDF(group, key, concept, "score")


def pruned(edges: DataFrame, by: str, percent: float | None = None, remove: int | None = None, group: str = "graph_id") -> DataFrame:
    """Edges with their attribute among the top *percent* of their graph, or without its *remove* lowest; ties by (src, dst)."""
    from phrasewerk.operators.numbering import numbered

    nr = numbered(edges, [group, by, "src", "dst"], "_nr")
    ends = nr.groupBy(group).agg(F.min("_nr").alias("_first"), F.count("*").alias("_n"))
    gone = F.lit(remove) if remove is not None else F.floor(F.col("_n") * F.lit(1 - (percent if percent is not None else 100) / 100))
    return nr.join(ends, group).where(F.col("_nr") - F.col("_first") >= gone).select(*edges.columns)

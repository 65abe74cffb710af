"""Answers over retrieved sources: prompts, chatters and the store of chunks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.operators import retrieval as R
from phrasewerk.operators.lines import exploded_lines
from phrasewerk.sources.store import ArtifactStore, written

#: Prompts where no profile is there: own words.
TEMPLATES = {
    "en": "Answer the question from the numbered sources only and name the sources you use, as in [0]. If they answer a part only, say so.\n\nSOURCES:\n{summaries}\n\nQUESTION:\n{question}\n",
    "de": "Beantworte die Frage nur anhand der nummerierten Quellen und nenne die verwendeten, etwa [0]. Reichen sie nur für eine teilweise Antwort, sage das.\n\nQUELLEN:\n{summaries}\n\nFRAGE:\n{question}\n",
}
VARIABLES = ["summaries", "question"]
#: The word before a numbered source.
SOURCE_WORDS = {"de": "Quelle", "en": "Source"}


@dataclass(frozen=True)
class Prompt:
    template: str
    variables: list[str]

    def filled(self, **values: str) -> str:
        """The prompt's text; a variable without a value is an error."""
        out = self.template
        for name in self.variables:
            out = out.replace("{" + name + "}", values[name])
        return out


def profile_name(language: str | None) -> str:
    """The language of a profile: de of de-DE and de_DE; en for none."""
    return (language or "en").lower().replace("_", "-").split("-")[0]


def load_profile(name: str, folder: str | None = None) -> dict[str, Any]:
    """The prompt profile <name>.json of a folder, else the built-in one of the language, else the English one."""
    path = Path(folder) / f"{profile_name(name)}.json" if folder else None
    if path and path.exists():
        found = json.loads(path.read_text(encoding="utf-8"))
        return found if isinstance(found, dict) else {}
    return {"template": TEMPLATES.get(profile_name(name), TEMPLATES["en"]), "variables": VARIABLES}


def resolve_prompt(language: str = "en", config: dict[str, Any] | None = None, folder: str | None = None) -> Prompt:
    """From the weakest to the strongest: the language's profile, or that named by config["profile"]; config["templates"] by language, then by profile; config["template"]."""
    config = config or {}
    name = str(config.get("profile") or profile_name(language))
    profile = load_profile(name, folder)
    template = profile.get("template", TEMPLATES.get(profile_name(language), TEMPLATES["en"]))
    by_language = config.get("templates")
    if isinstance(by_language, dict):
        template = by_language.get(profile_name(language), by_language.get(name, template))
    variables = config.get("input_variables", profile.get("variables", VARIABLES))
    return Prompt(config.get("template", template), list(variables))


class Chatter(Protocol):
    """A language model: one prompt in, one answer out. Adapters of services are plugged in here."""

    def __call__(self, prompt: str) -> str: ...


class ChunkStore(Protocol):
    """What a store of chunks offers."""

    def is_filled(self) -> bool: ...

    def reset(self) -> None: ...

    def add(self, chunks: DataFrame) -> int: ...

    def get_chunks(self, questions: DataFrame, ids: DataFrame | None = None, limit: int = 10) -> DataFrame: ...


CHUNKS = "doc_id string, doc_name string, chunk_index int, chunk_start long, chunk_end long, text string"


class TableChunkStore:
    """Chunks as a versioned table; retrieval fuses BM25 with the encoder's cosine."""

    def __init__(self, spark: SparkSession, root: str, name: str, encoder: R.Encoder = R.encoded, alpha: float = 0.6):
        self.spark, self.store, self.name, self.encoder, self.alpha = spark, ArtifactStore(spark, root), name, encoder, alpha

    def exists(self) -> bool:
        return self.store.present(self.name) is not None

    def chunks(self) -> DataFrame:
        return self.store.read_present(self.name)

    def count(self) -> int:
        return self.chunks().count() if self.exists() else 0

    def is_filled(self) -> bool:
        return self.exists() and not self.chunks().isEmpty()

    def reset(self) -> None:
        """An empty index with the default fields."""
        self.store.put(self.spark.createDataFrame([], CHUNKS), self.name)

    def add(self, chunks: DataFrame) -> int:
        """Appends chunks; the number of chunks then."""
        kinds = self.chunks().schema if self.exists() else self.spark.createDataFrame([], CHUNKS).schema
        rows = chunks.select(*[F.col(f.name).cast(f.dataType) for f in kinds])
        self.store.put(self.chunks().unionByName(rows) if self.exists() else rows, self.name)
        return self.count()

    def get_chunks(self, questions: DataFrame, ids: DataFrame | None = None, limit: int = 10) -> DataFrame:
        """(question, rank, score, chunk columns): the *limit* best chunks of each question (question, q_text), of the documents *ids* only if given; each chunk once."""
        mine = R.of_documents(self.chunks(), ids).withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("chunk_index").cast("string")))
        texts = mine.select("chunk_id", "text")
        lexical = R.bm25(texts, questions, "chunk_id", "question")
        top = R.fused(lexical, R.dense_scores(texts, questions, "chunk_id", "question", self.encoder), "chunk_id", "question", self.alpha, limit)
        return top.join(mine, "chunk_id").drop("chunk_id")


def chunks_of(documents: DataFrame, chunk_size: int = 400, overlap: int = 100, key: str = "doc_id", name: str = "name", text: str = "text") -> DataFrame:
    """The chunk rows of whole documents."""
    lines = exploded_lines(documents, key, text, name)
    packed = R.packed_chunks(lines, key, chunk_size, overlap, keep=[name])
    return packed.select(F.col(key).cast("string").alias("doc_id"), F.col(name).alias("doc_name"), "chunk_index", "chunk_start", "chunk_end", "text")


NEW, FILLING, READY, FAILED = "new", "filling", "ready", "failed"


@dataclass
class Rag:
    """Questions answered from a store of chunks by a chatter; both are given by the caller."""

    store: ChunkStore
    chatter: Chatter | None = None
    language: str = "en"
    prompt: Prompt = field(default_factory=lambda: resolve_prompt("en"))
    state: str = NEW
    error: Exception | None = None

    @classmethod
    def of(cls, store: ChunkStore, chatter: Chatter | None, language: str = "en", config: dict[str, Any] | None = None, folder: str | None = None) -> Rag:
        return cls(store, chatter, profile_name(language), resolve_prompt(language, config, folder))

    def fill(self, documents: DataFrame, force: bool = False, chunk_size: int = 400, overlap: int = 100) -> str:
        """Splits documents (doc_id, name, text) into the store unless it is filled; the state then."""
        if self.store.is_filled() and not force:
            self.state = READY
            return self.state
        self.state = FILLING
        try:
            chunks = written(chunks_of(documents, chunk_size, overlap), "chunks")
            self.store.reset()
            self.store.add(chunks)
            self.state = READY
        except Exception as e:  # noqa: BLE001 - the state tells it
            self.state, self.error = FAILED, e
        return self.state

    def sources(self, questions: DataFrame, ids: DataFrame | None = None, limit: int = 15, tokens: int = 150) -> DataFrame:
        """(question, source_no, doc_id, doc_name, source): the snippets of the best chunks, joined by document in order of rank and numbered from 0 on."""
        hits = self.store.get_chunks(questions, ids, limit).join(questions, "question").withColumn("highlight", longest_shared(F.col("q_text"), F.col("text")))
        cut = R.snippets(hits, "text", "highlight", tokens)
        by = cut.groupBy("question", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("doc_name", "rank").alias("doc_name"), F.sort_array(F.collect_list(F.struct("rank", "snippet"))).alias("_t"))  # at most *limit* snippets
        joined = by.select("question", "doc_id", "doc_name", "rank", F.array_join("_t.snippet", "\n\n").alias("text"))
        numbers = R.numbered_sources(joined, "question", "rank", "text", SOURCE_WORDS.get(self.language, "Source"))
        nos = joined.withColumn("source_no", F.row_number().over(R.Window.partitionBy("question").orderBy("rank")) - 1)
        return numbers.join(nos.select("question", "source_no", "doc_id", "doc_name"), ["question", "source_no"])

    def prompts(self, questions: DataFrame, ids: DataFrame | None = None, limit: int = 15) -> DataFrame:
        """(question, q_text, prompt, n_sources): the prompt of each question; null without sources."""
        own = written(self.sources(questions, ids, limit), "sources")
        by = own.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("source_no", "source"))).alias("s"))
        rows = questions.join(by, "question", "left")
        text = T.filled(self.prompt.template, summaries=F.array_join("s.source", "\n\n"), question=F.col("q_text"))
        n = F.coalesce(F.size("s"), F.lit(0))
        return rows.select("question", "q_text", F.when(n > 0, text).alias("prompt"), F.greatest(n, F.lit(0)).alias("n_sources"))

    def ask(self, questions: DataFrame, ids: DataFrame | None = None, limit: int = 15) -> DataFrame:
        """(question, answer, error, n_sources): cleaned answers. Without sources the fixed sentence, and the chatter is not called; a chatter's failure is the error of its question."""
        prompts, chatter = self.prompts(questions, ids, limit), self.chatter
        if chatter is None:
            raise ValueError("a chatter is needed to answer")
        kind = questions.schema["question"].dataType.simpleString()
        answered = prompts.where("prompt is not null").mapInPandas(lambda batches: _answers(batches, chatter), f"question {kind}, raw string, error string")
        both = prompts.join(answered, "question", "left")
        answer = F.when(F.col("prompt").isNull(), T.no_source_answer(F.lit(self.language))).otherwise(T.clean_answer(F.col("raw")))
        return both.select("question", answer.alias("answer"), "error", "n_sources")


def _answers(batches, chatter: Callable[[str], str]):
    for pdf in batches:
        got = []
        for prompt in pdf["prompt"]:
            try:
                got.append((chatter(prompt), None))
            except Exception as e:  # noqa: BLE001 - it belongs to its question
                got.append((None, f"{type(e).__name__}: {e}"))
        yield pdf[["question"]].assign(raw=[a for a, _ in got], error=[e for _, e in got])


def longest_shared(question, text):
    """The longest word of a question that a text has, as the text writes it; null without one."""
    shared = F.filter(F.array_distinct(T.words(question)), lambda w: F.contains(F.lower(text), w))
    top = F.array_max(F.transform(shared, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    place = F.position(top["w"], F.lower(text))
    return F.when(top.isNotNull(), F.substring(text, place, top["n"]))

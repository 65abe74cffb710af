"""Grounding of expansion candidates in a terminology."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.functions import text as T
from phrasewerk.sources.readers import terminology


def lookup(terms: DataFrame) -> DataFrame:
    """(norm, matched_term, relation, source_id, categories): every term and synonym by its normalised form."""
    own = terms.select(T.normalised_term(F.col("term")).alias("norm"), F.col("term").alias("matched_term"), F.lit("exact").alias("relation"), F.col("id").alias("source_id"), "categories")
    others = terms.select(F.explode("synonyms").alias("s"), "id", "categories")
    others = others.select(T.normalised_term(F.col("s")).alias("norm"), F.col("s").alias("matched_term"), F.lit("synonym").alias("relation"), F.col("id").alias("source_id"), "categories")
    return own.unionByName(others).where("norm is not null and norm <> ''")


def grounded(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(candidates..., matched_term, relation, source_id, score): evidence for each candidate, score 1; candidates without any have nulls and score 0.

    A term with categories counts only for candidates of one of them, so not for one whose category is null.
    Candidates repeated in all columns count once.
    """
    once = candidates.distinct()
    c = once.withColumn("_no", F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in candidates.columns])).withColumn("norm", T.normalised_term(F.col("term")))
    free = (F.size("categories") <= 0) | F.col("categories").isNull()
    hit = free | F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False))
    found = c.join(lookup(terms), "norm").where(hit).select("_no", *candidates.columns, "matched_term", "relation", "source_id")
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in candidates.columns]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    rows = c.drop("norm").alias("a").join(found.alias("b"), (F.col("a._no") == F.col("b._no")) & condition, "left")
    return rows.select(*[F.col(f"a.{x}") for x in candidates.columns], "b.matched_term", "b.relation", "b.source_id", F.when(F.col("b.source_id").isNotNull(), 1.0).otherwise(0.0).alias("score"))


def statuses(evidence: DataFrame, keys: list[str], minimum: float = 0.5, reject: bool = True, keep_llm_only: bool = True) -> DataFrame:
    """(keys..., confidence, n_evidence, status): grounded with evidence of *minimum*; else rejected (left out) or llm_only (left out unless kept)."""
    by = evidence.groupBy(*keys).agg(F.max("score").alias("confidence"), F.count("source_id").alias("n_evidence"))
    good = (F.col("n_evidence") > 0) & (F.col("confidence") >= minimum)
    by = by.withColumn("status", F.when(good, "grounded").when(F.lit(reject) & (F.col("confidence") < minimum), "rejected").otherwise("llm_only"))
    return by.where(F.col("status").isin(["grounded"] + (["llm_only"] if keep_llm_only else [])))


def by_category(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(category, terms): the requested categories only, an empty list for one without terms."""
    asked = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    by = rows.where(F.col("category").isin(list(categories))).groupBy("category").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return asked.join(by, "category", "left").select("category", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


#: The categories of an expansion, and those asked for by default.
CATEGORIES = ("synonym", "medication", "diagnosis", "symptom", "procedure", "abbreviation", "broader_term", "narrower_term", "related_term")
DEFAULT_CATEGORIES = CATEGORIES[:5]
#: What each category means, in own words.
DESCRIPTIONS = {
    "synonym": "other words for the same thing, spellings and lay words included", "medication": "drugs and drug classes used for it", "diagnosis": "diagnoses that go with it",
    "symptom": "signs and complaints that go with it", "procedure": "examinations, operations and treatments for it", "abbreviation": "its abbreviations and their long forms",
    "broader_term": "terms that include it", "narrower_term": "terms that it includes", "related_term": "other terms that belong to its field",
}
PROMPT = 'Expand the term "{term}" in {language_name}: at most {limit_per_category} candidates for each category.\nCategories: {categories_json}\nEvery candidate has one of these categories.\n{schema_instruction}\n'
SCHEMA_INSTRUCTION = 'Answer with JSON only: {"candidates": [{"term": "...", "category": "...", "rationale": "..."}]}'
REPLY = "candidates array<struct<term:string,category:string,rationale:string>>"


@dataclass(frozen=True)
class Request:
    """What is to be expanded and how; values out of range are refused. The limit goes into the prompt and is not enforced on what comes back."""

    term: str
    language: str = "en"
    categories: tuple[str, ...] = DEFAULT_CATEGORIES
    limit_per_category: int = 10
    include_llm_only: bool = True
    minimum_score: float = 0.0
    reject_below_minimum: bool = False
    sources: tuple[dict, ...] = ()
    template: str | None = None
    descriptions: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "term", (self.term or "").strip())
        unknown = [c for c in (*self.categories, *self.descriptions) if c not in CATEGORIES]
        if not self.term or not 1 <= self.limit_per_category <= 100 or not 0 <= self.minimum_score <= 1 or unknown:
            raise ValueError("a term, known categories, a limit from 1 to 100 and a score from 0 to 1 are needed")


class CandidateGenerator(Protocol):
    """A language model behind a prompt: the reply as text, JSON in it. Adapters of services are plugged in here."""

    def __call__(self, prompt: str) -> str: ...


def build_prompt(request: Request, profile: dict | None = None) -> str:
    """The prompt with the categories' descriptions: those of the request before the profile's before the built-in ones."""
    profile = profile or {}
    described = {c: request.descriptions.get(c, profile.get("category_descriptions", {}).get(c, DESCRIPTIONS[c])) for c in request.categories}
    values = {"term": request.term, "language": request.language, "language_name": profile.get("language_name", request.language), "limit_per_category": str(request.limit_per_category), "categories_json": json.dumps(described, ensure_ascii=False), "schema_instruction": profile.get("schema_instruction", SCHEMA_INSTRUCTION)}
    out = request.template or profile.get("prompt_template", PROMPT)
    for name, value in values.items():
        out = out.replace("{" + name + "}", value)
    return out


def candidates_of(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """(key, term, category, rationale) of generated replies; a reply that is no JSON of the schema is an error of its row, which falls out, as do candidates without a term or of an unknown category."""
    rows = replies.select(key, F.explode(T.read_json(F.col(reply), REPLY)["candidates"]).alias("c")).select(key, "c.*")
    return rows.where((F.trim("term") != "") & F.col("category").isin(list(CATEGORIES)))


def generated(spark: SparkSession, request: Request, generator: CandidateGenerator, profile: dict | None = None) -> DataFrame:
    """(term, category, rationale) that the generator gives for a request; a reply without JSON is an error."""
    reply = generator(build_prompt(request, profile))
    rows = spark.createDataFrame([(0, reply)], "no int, reply string")
    if rows.where(T.read_json(F.col("reply"), REPLY)["candidates"].isNotNull()).isEmpty():
        raise ValueError("the reply holds no candidates")
    return candidates_of(rows, "no").drop("no")


def source_of(spark: SparkSession, config: dict) -> DataFrame:
    """The terms of a source {"type": "local", "path": ...}; other types are not there."""
    if config.get("type") != "local":
        raise NotImplementedError(f"no source of type {config.get('type')}")
    return terminology(spark, config["path"])


def expanded(spark: SparkSession, request: Request, candidates: DataFrame, terms: list[DataFrame] | None = None) -> DataFrame:
    """(category, candidates): for each category of the request its candidates (term, status, confidence, rationale, evidence), by term; an empty list for one without any.

    *candidates* has term, category, rationale; *terms* are terminologies, by default those of the request's sources.
    """
    known = terms if terms is not None else [source_of(spark, s) for s in request.sources]
    wanted = candidates.where(F.col("category").isin(list(request.categories))).select("term", "category", "rationale")
    none = spark.createDataFrame([], "id string, term string, synonyms array<string>, categories array<string>")
    every = none
    for t in known:
        every = every.unionByName(t.select("id", "term", "synonyms", "categories"))
    found = grounded(wanted, every)
    judged = statuses(found, ["term", "category", "rationale"], request.minimum_score, request.reject_below_minimum, request.include_llm_only)
    proof = found.where("source_id is not null").groupBy("term", "category").agg(F.sort_array(F.collect_set(F.struct("source_id", "matched_term", "relation", "score"))).alias("evidence"))
    rows = judged.join(proof, ["term", "category"], "left")
    one = F.struct("term", "status", "confidence", "rationale", F.coalesce("evidence", F.array().cast(proof.schema["evidence"].dataType)).alias("evidence"))
    by = rows.groupBy("category").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    asked = spark.createDataFrame([(c, i) for i, c in enumerate(request.categories)], "category string, no int")
    out = asked.join(by, "category", "left").orderBy("no")
    return out.select("category", F.coalesce("candidates", F.array().cast(by.schema["candidates"].dataType)).alias("candidates"))

"""Text functions; only the common subsequence of two strings leaves the JVM, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def normalised_term(term: Column) -> Column:
    """Lower case, runs of whitespace as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(F.lower(term), r"\s+", " "))


def conform_name(name: Column) -> Column:
    """Lower case; runs of whitespace or of hyphens become an underscore."""
    return F.regexp_replace(F.lower(name), r"\s+|-+", "_")


def profile(language: Column) -> Column:
    """The language of a profile name: de of de-DE and de_DE."""
    return F.split(F.replace(F.lower(language), F.lit("_"), F.lit("-")), "-")[0]


def true_word(word: Column) -> Column:
    """True for the words that mean yes in a request (true, yes, y, ja, j, 1), false for others, null for null."""
    return F.lower(F.trim(word)).isin("true", "yes", "y", "ja", "j", "1")


def place_of(needle: Column, text: Column) -> Column:
    """0-based place of *needle* in *text*; null if it is not there, is empty, or either is null."""
    return F.when(F.length(needle) > 0, F.nullif(F.position(needle, text), F.lit(0)) - 1)


def cut_start(tokens: Column, limit: int) -> Column:
    """The first *limit* tokens, joined by blanks."""
    return F.array_join(F.slice(tokens, 1, limit), " ")


def cut_end(tokens: Column, limit: int) -> Column:
    """The last *limit* tokens, joined by blanks."""
    return F.array_join(F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - limit + 1), F.lit(limit)), " ")


def cut_around(tokens: Column, middle: Column, limit: int) -> Column:
    """*limit* tokens around token number *middle* (from 0), moved inside the text at its ends, joined by blanks."""
    first = F.greatest(F.lit(0), F.least((middle - limit // 2).cast("int"), F.size(tokens) - limit))
    return F.array_join(F.slice(tokens, first + 1, F.lit(limit)), " ")


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


# What begins a reasoning, what announces the answer, and where an echoed prompt begins.
REASONING = ("thinking", "analysis", "reasoning")
ANSWER = ("final answer in english", "final answer", "finale antwort auf deutsch", "antwort")
ECHO = ("=========", "\nFRAGE:", "\nQUESTION:", "\nQUELLEN:", "\nSOURCES:")
#: The answer where there is no source.
NO_SOURCE = {"de": "Keine Quelle die ich finden kann.", "en": "No source I can find."}


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_answer(answer: Column) -> Column:
    """An answer without its reasoning: <think> blocks and a leading reasoning part removed, the text behind the first answer mark, an echoed prompt cut off, blanks at the ends cut; null stays null."""
    out = _stripped(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""))
    out = _stripped(F.regexp_replace(out, rf"(?is)^\s*(?:{'|'.join(REASONING)})\s*:\s*.*?(?:final answer|antwort)\s*:\s*", ""))
    marked = rf"(?is)(?:{'|'.join(ANSWER)})\s*:\s*(.*)$"
    out = _stripped(F.when(out.rlike(marked), F.regexp_extract(out, marked, 1)).otherwise(out))
    cuts = [F.when(F.position(F.lit(e), out) > 1, _stripped(F.substring(out, F.lit(1), F.position(F.lit(e), out) - 1))) for e in ECHO]
    return F.coalesce(*cuts, out)


def no_source_answer(language: Column) -> Column:
    """The sentence for an answer without sources: German for de, English for all else and null."""
    return F.when(language == "de", F.lit(NO_SOURCE["de"])).otherwise(F.lit(NO_SOURCE["en"]))


def filled(template: str, **values: Column) -> Column:
    """*template* with {name} replaced by the column of each name; a null value counts as empty, unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def fenced_json(reply: Column) -> Column:
    """The JSON object of a reply: the first fenced block if there is one, else from the first brace to the last; null without one."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def _common(a: str | None, b: str | None) -> int | None:
    """Length of the longest common subsequence: one machine-word row of the recurrence for each character of *b*."""
    if a is None or b is None:
        return None
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings; null if either is null."""

    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_common(x, y) for x, y in zip(a, b)], dtype="Int32")

    lengths.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(lengths, IntegerType())(a, b)


def sorted_words(text: Column) -> Column:
    """ASCII letters and digits of *text* in lower case, its words in order, one blank between them."""
    kept = F.regexp_replace(text, r"[^\x00-\x7f]", "")
    parts = F.filter(F.split(F.regexp_replace(F.lower(kept), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(parts), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two texts as sorted words: 200 * common subsequence / lengths, rounded half to even; 0 if either is empty."""
    x, y = sorted_words(a), sorted_words(b)
    whole = F.length(x) + F.length(y)
    ratio = F.rint(F.lit(200.0) * common_length(x, y) / whole)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(ratio)


def label_similarity(a: Column, b: Column, added: float = 0.05) -> Column:
    """token_sort_ratio / 100 with *added* on top, as the phrase graph weighs it (it may exceed 1)."""
    return token_sort_ratio(a, b) / 100 + F.lit(added)


def read_json(reply: Column, schema: str) -> Column:
    """The JSON object of a reply as a struct; null where it is no JSON or a field has a value of another kind."""
    return F.from_json(fenced_json(reply), schema, {"mode": "PERMISSIVE"})


def sequence_ratio_of(a: str, b: str) -> float:
    """2 * common subsequence / lengths; 1 for two empty texts."""
    return 1.0 if not a and not b else 2.0 * (_common(a, b) or 0) / (len(a) + len(b))


def sequence_ratio(a: Column, b: Column) -> Column:
    """2 * common subsequence / lengths of two texts as they are; 1 for two empty ones, null if either is null."""
    whole = F.length(a) + F.length(b)
    return F.when(whole == 0, 1.0).otherwise(F.lit(2.0) * common_length(a, b) / whole)


def token_at(starts: Column, ends: Column, place: Column) -> Column:
    """The number of the token (from 0) that holds a place, its end exclusive; null between tokens."""
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    hit = F.array_position(F.transform(spans, lambda x: (x["s"] <= place) & (place < x["e"])), True)
    return F.when(hit > 0, hit - 1)


def single_sign(text: Column) -> Column:
    """True for one sign that is no letter, digit or underscore."""
    return text.rlike(r"^[^\p{L}\p{N}_]$")


def parts_between(text: Column, boundary: str) -> Column:
    """The parts of a text between boundary marks, empty ones left out."""
    return F.filter(F.split(text, _quoted(boundary), -1), lambda x: x != "")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"

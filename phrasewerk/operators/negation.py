"""Rule-based negation: which words of a line lie in the reach of a negation.

Triggers are matched on the lower-case words of a line. Matches that overlap a pseudo negation fall out; a termination
ends the reach. A word is negated if, in its part of the line, a preceding trigger begins before it or a following one ends behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewerk.functions.arrays import pairs

# The triggers by kind, an own list for German and English clinical text.
TRIGGERS = {
    "pseudo": ["nicht nur", "kein zweifel", "nicht sicher beurteilbar", "not only", "no change", "not reliably assessable", "no increase"],
    "preceding": ["kein", "keine", "keinen", "kein sicherer hinweis auf", "ohne", "ausschluss von", "nicht nachweisbar", "anamnestisch keine", "no", "no clear sign of", "without", "denies", "ruled out", "not seen"],
    "following": ["verneint", "ausgeschlossen", "denied", "was ruled out", "nicht ausgeschlossen"],
    "termination": ["aber", "jedoch", "sonst", "but", "however", "otherwise", "except"],
}


#: Sets of triggers: German and English clinical text, and the general words of each language.
TERM_SETS = {
    "de_en_clinical": TRIGGERS,
    "en": {
        "pseudo": ["not only", "no change", "no increase"],
        "preceding": ["no", "not", "without", "never", "neither"],
        "following": ["denied", "was ruled out"],
        "termination": ["but", "however", "otherwise", "except"],
    },
    "de": {
        "pseudo": ["nicht nur", "kein zweifel"],
        "preceding": ["kein", "keine", "keinen", "nicht", "ohne", "weder"],
        "following": ["verneint", "ausgeschlossen"],
        "termination": ["aber", "jedoch", "sonst"],
    },
    "es": {
        "pseudo": ["no solo", "sin cambios"],
        "preceding": ["no", "sin", "niega", "descarta", "ausencia de"],
        "following": ["descartado", "negativo"],
        "termination": ["pero", "excepto", "aunque"],
    },
}
KINDS = ("pseudo", "preceding", "following", "termination")


class TermSet:
    """A named set of triggers of four kinds that patterns are added to and removed from."""

    def __init__(self, name: str = "de_en_clinical"):
        if name not in TERM_SETS:
            raise ValueError(f"no term set {name}: {', '.join(TERM_SETS)}")
        self.terms = {k: list(v) for k, v in TERM_SETS[name].items()}

    def _each(self, patterns: dict[str, list[str]]):
        for kind, words in patterns.items():
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind}")
            yield kind, [w.lower() for w in words]

    def add(self, patterns: dict[str, list[str]]) -> TermSet:
        for kind, words in self._each(patterns):
            self.terms[kind] += [w for w in words if w not in self.terms[kind]]
        return self

    def remove(self, patterns: dict[str, list[str]]) -> TermSet:
        for kind, words in self._each(patterns):
            self.terms[kind] = [w for w in self.terms[kind] if w not in words]
        return self


@dataclass
class NegationConfig:
    """Settings of the predicate; a scope is a number of words, none for the whole part of the line."""

    terms: str = "de_en_clinical"
    scope: int | None = None
    feature: str = "nc"
    prefixes: bool = True

    #: Noun chunks, named entities, both.
    FEATURES = ("nc", "ne", "both")

    @classmethod
    def of(cls, given: dict) -> NegationConfig:
        """From a request: unknown keys and values are errors; a scope may be a number, digits in a string, or true (1) and false (none)."""
        unknown = set(given) - {"terms", "scope", "feature", "prefixes"}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out = cls(**given)
        if isinstance(out.scope, bool):
            out.scope = 1 if out.scope else None
        elif isinstance(out.scope, str):
            if not out.scope.isdigit():
                raise ValueError("a scope is a number of words")
            out.scope = int(out.scope)
        if out.feature not in cls.FEATURES or out.terms not in TERM_SETS or (out.scope is not None and out.scope < 0):
            raise ValueError("unknown feature, terms or scope")
        return out


def triggers(spark: SparkSession, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, trigger, n_words)."""
    rows = [(k, t.lower(), len(t.split(" "))) for k, ts in (terms or TRIGGERS).items() for t in ts]
    return spark.createDataFrame(rows, "kind string, trigger string, n_words int")


def line_words(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, words): the lower-case words of each line."""
    return lines.select(*keys, F.coalesce(F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>")).alias("words"))


def found_triggers(words: Column, terms: dict[str, list[str]] | None = None, kinds: tuple[str, ...] = KINDS) -> Column:
    """The places of the triggers in an array of words, as structs (kind, first, last), last exclusive. Only words that begin a trigger are looked at, within the row."""
    own = {k: [t.lower().split(" ") for t in ts] for k, ts in (terms or TRIGGERS).items() if k in kinds}
    firsts = sorted({t[0] for ts in own.values() for t in ts})
    none = F.array().cast("array<struct<kind:string,first:int,last:int>>")
    if not firsts:
        return none
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(F.array(*[F.lit(x) for x in firsts]), w), i)), lambda i: i.isNotNull())

    def hits(kind: str, n: int) -> Column:
        here = F.array(*[F.lit(" ".join(t)) for t in own[kind] if len(t) == n])
        at = F.filter(starts, lambda i: (i + n <= F.size(words)) & F.array_contains(here, F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))
        return F.transform(at, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("first"), (i + n).alias("last")))

    return F.coalesce(F.flatten(F.array(*[hits(kind, n) for kind, ts in own.items() for n in sorted({len(t) for t in ts})])), none)


def matches(words: DataFrame, *keys: str, terms: dict[str, list[str]] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(keys, kind, first, last): places of the triggers, last exclusive."""
    return words.select(*keys, F.explode(found_triggers(F.col("words"), terms, kinds)).alias("m")).select(*keys, "m.kind", "m.first", "m.last")


def negated_words(lines: DataFrame, *keys: str, terms: dict[str, list[str]] | None = None, scope: int | None = None) -> DataFrame:
    """(keys, word_no, word, negated) for every word of every line.

    All is array work within a line: its matches, those that overlap a pseudo negation taken out, and its parts, which
    begin at its start and at each termination. With a *scope* a trigger reaches so many words, which stands in for
    the reach along a dependency tree.
    """
    rows = line_words(lines, *keys)
    rows = rows.withColumn("found", found_triggers(F.col("words"), terms))
    of = lambda k: F.filter("found", lambda m: m["kind"] == k)
    rows = rows.withColumn("pseudo", of("pseudo"))
    clear = lambda k: F.filter(of(k), lambda m: ~F.exists("pseudo", lambda p: (m["first"] < p["last"]) & (p["first"] < m["last"])))
    rows = rows.withColumn("starts", F.concat(F.array(F.lit(0)), F.transform(clear("termination"), lambda m: m["first"])))
    rows = rows.withColumn("before", clear("preceding")).withColumn("behind", clear("following"))
    rows = rows.select(*keys, "starts", "before", "behind", F.posexplode("words").alias("word_no", "word"))
    part = lambda x: F.array_max(F.filter("starts", lambda s: s <= x))
    w = F.col("word_no")
    near = (lambda gap: gap <= scope) if scope is not None else (lambda gap: F.lit(True))
    negated = F.exists("before", lambda m: (m["first"] < w) & near(w - m["last"] + 1) & (part(m["first"]) == part(w))) | F.exists("behind", lambda m: (m["last"] > w + 1) & near(m["first"] - w) & (part(m["first"]) == part(w)))
    own = F.exists(F.concat("before", "behind"), lambda m: (m["first"] <= w) & (w < m["last"]))
    reached = F.when((F.size("before") > 0) | (F.size("behind") > 0), negated & ~own).otherwise(False)
    return rows.select(*keys, "word_no", "word", reached.alias("negated"))


def negated_prefix(chunk: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """True for a chunk that begins with a preceding trigger and is not that trigger itself."""
    hit = F.lit(False)
    for t in (terms or TRIGGERS)["preceding"]:
        hit = hit | F.startswith(F.lower(chunk), F.lit(t.lower() + " "))
    return F.coalesce(hit & ~F.lower(chunk).isin([t.lower() for t in (terms or TRIGGERS)["preceding"]]), F.lit(False))


def boundaries(lines: DataFrame, *keys: str, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, part_no, first, last): the parts of each line between terminations, in words, last exclusive; an empty line has none."""
    words = line_words(lines, *keys).where(F.size("words") > 0)
    ends = F.transform(found_triggers(F.col("words"), terms, ("termination",)), lambda m: m["first"])
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size("words")))))
    rows = words.select(*keys, F.posexplode(pairs(starts)).alias("part_no", "p"))
    return rows.select(*keys, "part_no", F.col("p.left").alias("first"), F.col("p.right").alias("last"))


def negated_chunks(chunks: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned *chunks* (key, line_no, line, offset, begin, end) with negated: true if a word of theirs lies in a negation's reach.

    *words* comes from negated_words by key and line_no. A chunk begins and ends at words or within one, and the words
    up to its places on its line, counted with the same pattern, say which are its own.
    """
    by = words.where("negated").groupBy(key, "line_no").agg(F.collect_list("word_no").alias("_negated"))
    count = lambda text: F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.lit(0))
    upto = lambda place: F.substring("line", F.lit(1), (place - F.col("offset")).cast("int"))
    first, last = count(F.concat(upto(F.col("begin")), F.lit("x"))) - 1, count(upto(F.col("end")))
    rows = chunks.join(by, [key, "line_no"], "left").withColumn("_first", first).withColumn("_last", last)
    hit = F.exists("_negated", lambda w: (w >= F.col("_first")) & (w < F.col("_last")))
    return rows.withColumn("negated", F.coalesce(hit, F.lit(False))).drop("_negated", "_first", "_last")

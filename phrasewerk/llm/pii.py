"""Problem 1: personal information in free text, found and replaced by typed placeholders.

Information-theoretic sanitisation: the corpus tells how strongly a term reveals a protected person. In a first pass
the words that stand in places reserved for names (after titles, beside addresses and numbers that were found by their
form) are counted against all their occurrences; the pointwise mutual information of word and place is the word's
disclosure. A second pass measures the same of contexts: how often their place is taken by disclosing words. Numbers
are counted likewise: of the words before them how often the number has a form that only telephones have, which tells
telephones from devices and orders, and of the first digits of local numbers how often a call is spoken of. Words,
contexts and cues beyond the thresholds, together with the forms of addresses, numbers and letters, mark what is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewerk.llm.common import written

#: A word discloses a name if so many bits of mutual information (or this part of the bits that are possible, where names
#: are so frequent that it is less) and this share of its occurrences say so.
BITS, OF_POSSIBLE, SHARE = 3.0, 0.5, 0.12
#: A context reserves its place for names if it occurs so often and this share of it is taken by disclosing words.
OFTEN, RESERVED = 12, 0.8
#: A word before numbers speaks against telephones if it occurs so often and its numbers have a telephone's form less than this part as often as others;
#: first digits of local numbers are a telephone's if this share of them is called.
LESS, CALLED = 0.5, 0.5
#: Word lists up to this number are broadcast (about 100 MB at most); longer ones are joined to each text.
BROADCAST_WORDS = 1_000_000
#: Parts in which the texts meet a word where the words are not broadcast.
SALTS = 16

# Words of letters and forms.
TITLES = {"frau", "herr", "herrn", "hr", "fr", "mr", "mrs", "ms", "miss", "dr", "prof", "med", "oa", "oä", "schwester", "pfleger", "nurse", "sister", "hausarzt", "hausärztin", "kontaktperson"}
PARTICLES = {"von", "van", "de", "der", "den", "zu", "zum", "zur", "vom", "del", "della", "di", "da", "dos", "el", "al", "bin", "ibn", "la", "le", "ten", "ter", "af", "av"}
# (before numbers: each counts as seen so often without a telephone, which the corpus may overrule)
DEVICES = {"charge", "lot", "sn", "auftrag", "gerät", "device", "batch", "order", "serial", "ref", "artikel", "bestellung", "bestellnummer", "seriennummer", "chargennummer", "probe", "sample"}
ID_CUES = r"versichert\w*|insurance\s+(?:no|number)|versicherung\w*|ausweis\w*|passport|reisepass|pass-?nr|patienten-?id|patient\s+id|patient(?:en)?-?(?:nr|nummer|number)|social\s+security|sozialversicherung\w*|rentenversicherung\w*|krankenkasse\w*|kvnr|rvnr|svnr|nhs|mrn|pension|identity\s+card|id\s+card|id-?nr|national\s+insurance"
EPONYMS = {"morbus", "index", "syndrom", "syndrome", "score", "zeichen", "sign", "prinzip", "test", "reflex", "klassifikation", "classification", "disease", "krankheit", "method", "methode", "phänomen"}
STREETS = r"straße|strasse|str\.|weg|gasse|allee|platz|stieg|damm|kamp|ring|ufer|chaussee|steig|pfad|markt|graben|wall|twiete|promenade"
LANES = r"Street|St|Avenue|Ave|Row|Lane|Drive|Close|Yard|Road|Rd|Court|Crescent|Terrace|Square|Gardens|Grove|Mews|Hill|Way|Place|Walk|Park|Green"
PLACE_PREFIXES = r"Bad|Sankt|St\.|Neu|Alt|Groß|Klein|Ober|Unter|Hohen|Little|Upper|Lower|Great|Kings|Queens|North|South|East|West|New|Old|Saint|Market|Nether|Long"

_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|<at>|\(ät\)|\[ät\]|(?<=\s)(?:at|ät|klammeraffe)(?=\s))\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(punkt\)|\[punkt\]|(?<=\s)(?:dot|punkt)(?=\s))\s?)"
EMAIL = re.compile(rf"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[a-z]{{2,}}(?![\w@-])", re.I)
PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"(?:\+|00)\d{1,3}(?:[ -]?\(0\)[ ]?|[ -]|(?=\())?(?:\(\d{1,5}\)[ -]?|\d{1,5}[ ./-])?\d{2,}(?:[ .-](?:\d[ ])?\d{2,5}){0,4}"
    r"|\(0\d{1,5}\)[ ]?[-/]?[ ]?\d{2,}(?:[ .-]\d{2,5}){0,3}"
    r"|0\d{1,5}(?: - | / |[ ./-])?\d{2,}(?:[ .-]\d{2,5}){0,3}"
    r"|\d{3}-\d{4}"
    r")(?![\w/]|[.,-]\d)"
)
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]?(?:\d{2}|\d{4})?|\d{4}-\d{2}-\d{2}")
_CALL = re.compile(r"(?:tel|fon|fax|mobil|mobile|phone|call|call back|rückruf|anruf|sms|handy|ring|contact)\w*\W{0,5}$", re.I)
_ID_VALUE = r"(?=[A-Za-z \-/.]{0,6}\d)[A-Za-z]{0,4}[ -]?\d[\dA-Za-z]*(?:[ \-/.][A-Za-z]?\d[\dA-Za-z]*|[ \-][A-Z](?![\w.]))*"
ID_CUED = re.compile(rf"(?<!\w)(?:{ID_CUES})(?:\s?(?:no|nr|number|nummer|id|#))?[.:\s#=-]{{1,3}}({_ID_VALUE})", re.I)
ID_FORMS = re.compile(r"(?<![\w-])(?:[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d|[A-Z]\d{9}|[A-Z] \d{3} \d{3} \d{3}|\d{8}[A-Z]\d{3}|\d\d \d{6} [A-Z] \d{3}|PID-\d{4}-\d{3}-\d\d|MRN ?\d{7}|999[ -]?\d{3}[ -]?\d{4}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|9\d\d-\d\d-\d{4})(?![\w-])")
_WORD = r"[^\W\d_][^\W\d_'’]*"
_NUMBER = r"\d{1,3}(?:\s?[a-z](?!\w|\.\w))?(?:\s?[-/]\s?\d{1,3}(?!\d))?"
_PLACE = rf"(?:(?:{PLACE_PREFIXES})\s)?[A-ZÄÖÜ][\w-]*(?:\s(?:an|am|im|in|bei|ob)(?:\s(?:der|dem|den))?\s[A-ZÄÖÜ][\w-]*)?"
_NEXT = r"(?:,?\s{1,2}|\s?[·|/–-]\s)"
_GERMAN = rf"(?:[A-ZÄÖÜ][\w-]*(?:{STREETS})|(?:[A-ZÄÖÜ][\w-]*\s)?(?:Straße|Str\.|Weg|Gasse|Allee|Platz|Damm|Ring|Ufer)|(?:Am|An\s(?:der|den|dem)|Auf\s(?:der|dem|den)|Unter\s(?:den|der|dem)|Hinter\s(?:dem|der|den)|Vor\s(?:dem|der|den)|Neben\s(?:dem|der)|Zum|Zur|Im|In\s(?:der|den|dem)|Beim)\s(?:[A-ZÄÖÜ]\w+\s)?(?!Vergleich|Segment|Stadium|Zone|Typ|Grad|Verlauf|Zimmer|Station|Thema|Kontrolle)[A-ZÄÖÜ][\w-]+)\s{_NUMBER}(?!\w|[.,]\d|\s?(?:mg|ml|g|IE|µg|mm|cm|kg|h)\b)(?:,?\s(?:Whg\.?|Wohnung|App\.?|Apt\.?|Etage)\s?\w+)?(?:{_NEXT}(?:D-)?\d{{5}}\s{_PLACE})?"
_ENGLISH = rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\s\d+\w?,\s)?(?<![\w.,/-])\d{{1,4}}[a-z]?\s(?:[A-Z][\w'’-]*\s){{1,3}}(?:{LANES})(?![\w])(?:(?:{_NEXT}(?:[A-Z][a-z][\w-]*\s){{1,2}}[A-Z][a-z][\w-]*|{_NEXT}(?:[A-Z][a-z][\w-]*\s)?[A-Z][a-z][\w-]*)?{_NEXT}[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}}(?!\w)|,\s(?:(?:{PLACE_PREFIXES})\s)?[A-Z][a-z][\w-]*(?:\s(?:Heath|Green|Hill|Cross|Bridge|Ford|End|Common|Bay|Park|Magna|Parva)(?!\w))?)?"
_CUED_STREET = rf"(?<=wohnhaft\s)(?:[A-ZÄÖÜ][\w-]*\s){{1,3}}{_NUMBER}(?:,\s(?:D-)?\d{{5}}\s{_PLACE})?|(?<=Anschrift\s)(?:[A-ZÄÖÜ][\w-]*\s){{1,3}}{_NUMBER}(?:,\s(?:D-)?\d{{5}}\s{_PLACE})?"
ADDRESS = re.compile(rf"(?<![\w-])(?:{_GERMAN}|{_ENGLISH}|{_CUED_STREET})")
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*)*")

Span = tuple[int, int, str]
_SMALL = "|".join(sorted(PARTICLES, key=len, reverse=True))
_JOINT = re.compile(rf",?[ ](?:[^\W\d_]\.[ ]?){{0,2}}(?:(?:{_SMALL})[ ]){{0,3}}", re.I)
_PARTICLES_BEFORE = re.compile(rf"(?<![\w.-])(?:(?:{_SMALL})[ ]){{1,3}}$", re.I)
_INITIALS_BEFORE = re.compile(r"(?<![\w.-])(?:[A-ZÄÖÜ]\.(?:[ ]|-(?=[A-Z])|(?=[A-ZÄÖÜ]))){1,2}$")
_INITIALS_BEHIND = re.compile(r",[ ](?:[A-ZÄÖÜ]\.(?:[ ](?=[A-ZÄÖÜ]\.))?){1,2}(?!\w)")


def _word_before(text: str, at: int) -> str:
    m = re.search(r"([^\W\d_]+)[\s.:#]*(?:[Nn]r\.?|[Nn]o\.?)?[\s.:#]*$", text[max(0, at - 40) : at])
    return m[1].lower() if m else ""


def forms(text: str) -> list[Span]:
    """EMAIL, ID, PHONE and ADDRESS found by their form, not overlapping, in order of position.

    What the corpus decides has its evidence in its kind: "PHONE:word:1" for a number behind a word, 1 if only telephones
    have its form; "LOCAL:digits:1" for a local one by its first digits, 1 if a call is spoken of.
    """
    taken: list[Span] = []

    def free(b: int, e: int) -> bool:
        return all(e <= x or b >= y for x, y, _ in taken)

    for m in EMAIL.finditer(text):
        taken.append((m.start(), m.end(), "EMAIL"))
    for m in ID_FORMS.finditer(text):
        if free(*m.span()) and _word_before(text, m.start()) not in DEVICES:
            taken.append((*m.span(), "ID"))
    for m in ID_CUED.finditer(text):
        b, e = m.span(1)
        value = text[b:e].rstrip(" -/.")
        if sum(c.isdigit() for c in value) >= 5 and not _DATE.fullmatch(value) and free(b, b + len(value)):
            taken.append((b, b + len(value), "ID"))
    for m in ADDRESS.finditer(text):
        if free(*m.span()):
            taken.append((*m.span(), "ADDRESS"))
    for m in PHONE.finditer(text):
        b, e = m.span()
        digits = sum(c.isdigit() for c in m[0])
        if not 7 <= digits <= 15 or _DATE.fullmatch(m[0]) or not free(b, e):
            continue
        if m[0][0] in "+0(":
            taken.append((b, e, f"PHONE:{_word_before(text, b)}:{int(m[0][0] in '+(' or m[0][:2] == '00')}"))
        else:
            taken.append((b, e, f"LOCAL:{m[0][:3]}:{int(bool(_CALL.search(text[max(0, b - 25) : b])))}"))
    return sorted(taken)


def decided(spans: list[Span], cues: set[str]) -> list[Span]:
    """*spans* with what the corpus decides: *cues* holds "PHONE:word" for words that speak against a telephone, "LOCAL:digits" for digits that are one's."""
    out = []
    for b, e, kind in spans:
        if ":" in kind:
            cue, _, yes = kind.rpartition(":")
            if (cue in cues) if kind[0] == "P" else not (yes == "1" or cue in cues):
                continue
            kind = "PHONE"
        out.append((b, e, kind))
    return out


def words(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """Words outside *spans*, with their places."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            continue
        out.append((m.start(), m.end(), m[0]))
    return out


def parts(word: str) -> list[str]:
    """The words joined by hyphens, in lower case."""
    return [p for p in word.lower().split("-") if p]


def _is_title(word: str) -> bool:
    return word.lower() in TITLES


def _gap(text: str, a: tuple, b: tuple) -> str:
    return text[a[1] : b[0]]


def _medical(text: str, toks: list, i: int) -> bool:
    """True for a name within a medical term: Morbus X, X-Syndrom, Index nach X."""
    w = toks[i][2]
    if "-" in w and w.split("-")[-1].lower() in EPONYMS:
        return True
    if i + 1 < len(toks) and toks[i + 1][2].lower() in EPONYMS and _gap(text, toks[i], toks[i + 1]) in (" ", "'s ", "’s "):
        return True
    j = i - 1
    if j >= 0 and toks[j][2].lower() == "nach":  # Index nach X, also where the word before is damaged
        return True
    return j >= 0 and toks[j][2].lower() in {"morbus", "index", "syndrom"} and _gap(text, toks[j], toks[i]).strip() == ""


def slots(text: str, spans: list[Span], toks: list) -> set[int]:
    """Numbers of the words that stand where forms and titles reserve a place for a name."""
    out: set[int] = set()
    for i, (_, e, w) in enumerate(toks):
        if _is_title(w) and not _medical(text, toks, i):
            j = i + 1
            while j < len(toks) and _is_title(toks[j][2]):
                j += 1
            last = toks[j - 1][1] if j > i else e
            n = 0
            while j < len(toks) and n < 2:
                if n == 0 and not re.fullmatch(r"[.:]?[ ](?:[^\W\d_]\.[ ]?){0,2}", text[last : toks[j][0]]):
                    if toks[j][2].lower() not in PARTICLES:
                        break
                elif n and text[last : toks[j][0]] != " ":
                    break
                if toks[j][2].lower() not in PARTICLES and len(toks[j][2]) > 1:
                    if not toks[j][2][0].isupper():
                        break
                    out.add(j)
                    n += 1
                last = toks[j][1]
                j += 1
    return out


def context_keys(text: str, toks: list, i: int, j: int) -> tuple[str, str]:
    """The contexts of a name from word i to word j: the two words before it and the two behind it on its line."""
    left = [t[2].lower() for t in toks[max(0, i - 2) : i] if "\n" not in text[t[0] : toks[i][0]]]
    right = [t[2].lower() for t in toks[j + 1 : j + 3] if "\n" not in text[toks[j][1] : t[0]]]
    return "l " + " ".join(left) if len(left) == 2 else "", "r " + " ".join(right) if len(right) == 2 else ""


class Names:
    """Marks names with the disclosing words and the contexts that reserve a place."""

    def __init__(self, disclosing: set[str], contexts: set[str]):
        self.disclosing, self.contexts = disclosing, contexts

    def known(self, word: str) -> bool:
        ps = parts(word)
        return bool(ps) and all(p in self.disclosing for p in ps)

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Given names, initials, particles and family names written together, in either order, or one alone."""
        toks = words(text, taken)
        marked = [(self.known(t[2]) and not _is_title(t[2]) and not _medical(text, toks, i)) or self._reserved(text, toks, i) for i, t in enumerate(toks)]
        out: list[Span] = []
        i = 0
        while i < len(toks):
            if not marked[i]:
                i += 1
                continue
            begin, end, last, comma = toks[i][0], toks[i][1], i, False
            while True:
                joint = _JOINT.match(text, end)
                nxt = last + 1
                while nxt < len(toks) and joint and toks[nxt][0] < joint.end():
                    nxt += 1
                if not joint or nxt >= len(toks) or toks[nxt][0] != joint.end() or not marked[nxt] or (comma and joint[0][0] == ","):
                    break
                comma |= joint[0][0] == ","
                last, end = nxt, toks[nxt][1]
            begin = self._lead(text, toks, i)
            behind = _INITIALS_BEHIND.match(text, end)
            if behind and not comma and last == i:
                end = behind.end()
            if not (text[begin:end].islower() and last == i and not (i and _is_title(toks[i - 1][2]))):  # one word in small letters may be another word
                out.append((begin, end, "NAME"))
            i = last + 1
        return out

    def _lead(self, text: str, toks: list, i: int) -> int:
        """Where a name begins whose first word is word i: before its initials and particles.

        A particle belongs to the name unless it follows a noun that is no title and no name (Zweitmeinung von).
        """
        begin = toks[i][0]
        m = _PARTICLES_BEFORE.search(text, max(0, begin - 20), begin)
        if m:
            j = i - 1
            while j >= 0 and toks[j][0] >= m.start():
                j -= 1
            noun = j >= 0 and text[toks[j][1] : m.start()] == " " and not _is_title(toks[j][2]) and not self.known(toks[j][2])
            reserved = j > 0 and f"l {toks[j - 1][2].lower()} {toks[j][2].lower()}" in self.contexts  # names begin right behind the noun
            if noun and not reserved and (toks[j][2][0].isupper() or toks[j][2].lower() == "opinion"):
                second = text.find(" ", m.start())  # of two particles the first belongs to the noun
                begin = second + 1 if 0 <= second < begin - 1 else begin
            else:
                begin = m.start()
        m = _INITIALS_BEFORE.search(text, max(0, begin - 8), begin)
        return m.start() if m else begin

    def _reserved(self, text: str, toks: list, i: int) -> bool:
        """An unknown capitalised word whose context is reserved for names."""
        w = toks[i][2]
        if not w[0].isupper() or len(w) < 3 or _is_title(w) or _medical(text, toks, i) or w.lower() in PARTICLES:
            return False
        left, _ = context_keys(text, toks, i, i)
        return left in self.contexts and text[toks[i - 1][1] : toks[i][0]] in (" ", ": ", ". ", ".: ")


def found_in(text: str | None, names: Names, cues: set[str] = frozenset()) -> list[Span]:
    """All cases of a text in order; none for null and empty texts. Places count code points."""
    if not text:
        return []
    spans = decided(forms(text), cues)
    return sorted(spans + names.spans(text, spans))


def replaced(text: str | None, spans: list[Span]) -> str | None:
    """The text with a placeholder of its type for each case; the rest is unchanged."""
    if not text:
        return text
    out, at = [], 0
    for b, e, kind in spans:
        out += [text[at:b], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


_COUNTS = "term string, n long, hits long"


def _counted(texts: DataFrame, count) -> DataFrame:
    """Sums of (term, n, hits) over all texts; *count* adds to two counters for a text and what it needs of the lexicons. Each batch is summed before the shuffle."""
    known = [c for c in texts.columns if c.startswith("_known")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, hits = Counter(), Counter()
            for t, spans, *own in zip(pdf["_text"], pdf["_forms"], *[pdf[c] for c in known]):
                count(t, unpacked(spans), dict(zip(known, own)), n, hits)
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "hits": [hits[p] for p in n]})

    sums = texts.mapInPandas(run, _COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return written(sums, "counts")  # read twice, made once


def number_cues(texts: DataFrame) -> DataFrame:
    """(term): words before numbers that speak against a telephone, and first digits of local numbers that are one's, by counts over all texts."""
    marked = texts.select(F.explode(F.filter(F.split("_forms", " "), lambda x: F.contains(x, F.lit(":")))).alias("x")).select(F.split(F.split("x", ",")[2], ":").alias("k"))
    counts = marked.groupBy(F.col("k")[0].alias("kind"), F.col("k")[1].alias("cue")).agg(F.count("*").alias("n"), F.sum(F.col("k")[2].cast("int")).alias("hits"))
    counts = written(counts.where("cue <> ''"), "cues")
    seen = counts.where("kind = 'PHONE'").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    base = (seen.hits or 0) / seen.n if seen.n else 0.0
    own = texts.sparkSession.createDataFrame([(d,) for d in sorted(DEVICES)], "cue string")
    against = counts.where("kind = 'PHONE'").join(own.withColumn("prior", F.lit(OFTEN)), "cue", "full_outer").select("cue", (F.coalesce("n", F.lit(0)) + F.coalesce("prior", F.lit(0))).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    against = against.where((F.col("n") >= OFTEN) & (F.col("hits") <= LESS * base * F.col("n"))).select(F.concat(F.lit("PHONE:"), "cue").alias("term"))
    local = counts.where((F.col("kind") == "LOCAL") & (F.col("n") >= OFTEN) & (F.col("hits") >= CALLED * F.col("n"))).select(F.concat(F.lit("LOCAL:"), "cue").alias("term"))
    return written(against.unionByName(local), "cues")


def disclosure(counts: DataFrame) -> DataFrame:
    """*counts* (term, n, hits) with share, the part of a word's occurrences in reserved places, bits, the pointwise mutual information of both, and the most bits possible."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    base = total.hits / total.n if total.n and total.hits else 1.0
    share = F.col("hits") / F.col("n")
    bits = F.when(F.col("hits") > 0, F.log2(share / F.lit(base)))
    return counts.select("term", "n", "hits", share.alias("share"), bits.alias("bits"), (-F.log2(F.lit(base))).alias("possible"))


def _disclosing(counts: DataFrame) -> DataFrame:
    own = sorted(TITLES | PARTICLES)
    return written(disclosure(counts).where((F.col("bits") >= F.least(F.lit(BITS), OF_POSSIBLE * F.col("possible"))) & (F.col("share") >= SHARE) & (F.length("term") > 1) & ~F.col("term").isin(own)).select("term"), "terms")


def _words_of(text: str, spans: list[Span], known: dict) -> set[str]:
    return {p for m in TOKEN.finditer(text) for p in parts(m[0])}


def _cues_of(text: str, spans: list[Span], known: dict) -> set[str]:
    return {k.rpartition(":")[0] for _, _, k in spans if ":" in k}


class Lexicon:
    """Terms at hand in every task under *name*: broadcast if they are few, else each text brings those of its own (*of_text*) that are among them."""

    def __init__(self, terms: DataFrame, name: str, of_text, broadcast_words: int | None = None):
        limit = BROADCAST_WORDS if broadcast_words is None else broadcast_words
        self.terms, self.name, self.of_text = terms, f"_known_{name}", of_text
        self.small = terms.count() <= limit
        self.sent = terms.sparkSession.sparkContext.broadcast({r.term for r in terms.collect()} if self.small else set())

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "name": self.name}  # tasks need no more

    def beside(self, texts: DataFrame) -> DataFrame:
        """*texts* (_key, _text, _forms, ...) with the terms of each; null where all are broadcast."""
        if self.small:
            return texts.withColumn(self.name, F.lit(None).cast("array<string>"))
        of_text, known = self.of_text, [c for c in texts.columns if c.startswith("_known")]

        def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = []
                for k, t, f, *own in zip(pdf["_key"], pdf["_text"], pdf["_forms"], *[pdf[c] for c in known]):
                    got += [(k, w) for w in of_text(t, unpacked(f), dict(zip(known, own)))]
                yield pd.DataFrame(got, columns=["_key", "term"])

        kind = texts.schema["_key"].dataType.simpleString()
        own = texts.select("_key", "_text", "_forms", *known).mapInPandas(terms_of, f"_key {kind}, term string").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        spread = self.terms.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # a name that a third of the texts have meets them in parts
        held = own.join(spread, ["term", "_salt"]).groupBy("_key").agg(F.collect_set("term").alias(self.name))
        return texts.join(held, "_key", "left").withColumn(self.name, F.coalesce(self.name, F.array().cast("array<string>")))

    def of(self, known: dict) -> set[str]:
        own = known.get(self.name)
        return self.sent.value if own is None else set(own)


def packed(spans: list[Span]) -> str:
    return " ".join(f"{b},{e},{k}" for b, e, k in spans)


def unpacked(spans: str) -> list[Span]:
    return [(int(b), int(e), k) for b, e, k in (x.split(",") for x in spans.split(" ") if x)]


def _first_pass(text: str, spans: list[Span], known, n: Counter, hits: Counter) -> None:
    toks = words(text, spans)
    reserved = slots(text, spans, toks)
    for i, tok in enumerate(toks):
        if tok[2][0].isupper() and not _medical(text, toks, i):  # in small letters it may be another word
            for p in parts(tok[2]):
                n[p] += 1
                hits[p] += i in reserved


def learned(texts: DataFrame) -> tuple[Lexicon, Lexicon, Lexicon, DataFrame]:
    """The disclosing words, the reserved contexts and the cues of numbers of a corpus (_key, _text, _forms), from counts over all texts; and the texts with what they need of them."""
    cues = Lexicon(number_cues(texts), "cues", _cues_of)
    texts = cues.beside(texts)

    def words_in(text: str, spans: list[Span], known: dict) -> list[tuple[int, int, str]]:
        return words(text, decided(spans, cues.of(known)))

    def first_pass(text: str, spans: list[Span], known: dict, n: Counter, hits: Counter) -> None:
        _first_pass(text, decided(spans, cues.of(known)), known, n, hits)

    first = Lexicon(_disclosing(_counted(texts, first_pass)), "first", _words_of)
    with_first = first.beside(texts)

    def contexts_of(text: str, spans: list[Span], known: dict, n: Counter, hits: Counter) -> None:
        names, toks = Names(first.of(known), set()), words_in(text, spans, known)
        for i, tok in enumerate(toks):
            if tok[2][0].isupper() and len(tok[2]) > 2 and not _is_title(tok[2]) and not _medical(text, toks, i):
                for key in filter(None, context_keys(text, toks, i, i)):
                    n[key] += 1
                    hits[key] += names.known(tok[2])

    reserved = _counted(with_first, contexts_of).where((F.col("n") >= OFTEN) & (F.col("hits") >= RESERVED * F.col("n")))

    def keys_of(text: str, spans: list[Span], known: dict) -> set[str]:
        toks = words_in(text, spans, known)
        return {k for i in range(len(toks)) for k in context_keys(text, toks, i, i)}

    contexts = Lexicon(written(reserved.select("term"), "contexts"), "contexts", keys_of)

    def second_pass(text: str, spans: list[Span], known: dict, n: Counter, hits: Counter) -> None:
        own = contexts.of(known)
        names, toks = Names(first.of(known), own), words_in(text, spans, known)
        for i, tok in enumerate(toks):
            if not tok[2][0].isupper() or _medical(text, toks, i):
                continue
            inside = (
                any(k in own for k in context_keys(text, toks, i, i))
                or (i > 0 and text[toks[i - 1][1] : tok[0]] == " " and names.known(toks[i - 1][2]))
                or (i + 1 < len(toks) and text[tok[1] : toks[i + 1][0]] == ", " and names.known(toks[i + 1][2]))
            )
            for p in parts(tok[2]):
                n[p] += 1
                hits[p] += bool(inside or p in names.disclosing)

    second = Lexicon(_disclosing(_counted(contexts.beside(with_first), second_pass)), "words", _words_of)
    return second, contexts, cues, second.beside(contexts.beside(texts))


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each different text of a key; null keys left out."""
    return documents.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).distinct()


def _marked(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _text, _spans): the cases of each text."""
    keyed = _keyed(documents, key, text).where(F.length("_text") > 0)
    kind = keyed.schema["_key"].dataType.simpleString()

    def with_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_forms=[packed(forms(t)) for t in pdf["_text"]])

    texts = written(keyed.mapInPandas(with_forms, f"_key {kind}, _text string, _forms string"), "texts")  # what has a form is found once
    lexicon, contexts, cues, ready = learned(texts)
    known = [c for c in ready.columns if c.startswith("_known")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for t, packed_forms, *own in zip(pdf["_text"], pdf["_forms"], *[pdf[c] for c in known]):
                mine = dict(zip(known, own))
                taken = decided(unpacked(packed_forms), cues.of(mine))
                cases = sorted(taken + Names(lexicon.of(mine), contexts.of(mine)).spans(t, taken))
                spans.append([{"b": b, "e": e, "kind": k} for b, e, k in cases])
            yield pd.DataFrame({"_key": pdf["_key"], "_text": pdf["_text"], "_spans": spans})

    return ready.mapInPandas(run, f"_key {kind}, _text string, _spans array<struct<b:long,e:long,kind:string>>")


def found(documents: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, kind, begin_pos, end_pos): every mention of personal information, in code points from 0, ends exclusive.

    Null and empty texts have none; equal rows under one key count once, different texts of a key are each looked
    through; rows without a key are left out.
    """
    spans = _marked(documents, key, text).select("_key", F.explode("_spans").alias("s"))
    return spans.select(F.col("_key").alias(key), F.col("s.kind").alias("kind"), F.col("s.b").alias("begin_pos"), F.col("s.e").alias("end_pos"))


def sanitised(documents: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, text): each different text of a key with [KIND] for every mention, the rest unchanged; null and empty texts stay as they are."""
    marked = _marked(documents, key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], "_new": [replaced(t, [(s["b"], s["e"], s["kind"]) for s in spans]) for t, spans in zip(pdf["_text"], pdf["_spans"])]})

    done = marked.mapInPandas(run, f"_key {marked.schema['_key'].dataType.simpleString()}, _new string")
    rest = _keyed(documents, key, text).where("_text is null or _text = ''").select("_key", F.col("_text").alias("_new"))
    return done.unionByName(rest).select(F.col("_key").alias(key), F.col("_new").alias(text))

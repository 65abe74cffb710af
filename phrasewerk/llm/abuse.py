"""Problem 9: abusive, hateful or sexual content, by a linear classifier of character n-grams.

The n-grams of each sentence are scaled by their naive Bayes log-count ratios, and a logistic regression is trained on
them with the readers' verdicts. A verdict is on a document, but a few sentences decide it: of an abusive document the
sentences that score highest stand for it, chosen anew in every round. A document's score is that of its worst sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, bits of their hashes; most labelled documents and harmless sentences taken for training.
GRAMS, BITS, LABELLED, HARMLESS = (3, 4, 5), 18, 12_000, 20_000
#: Rounds of choosing sentences, steps of the regression in each, its ridge, the smoothing of the counts.
ROUNDS, STEPS, RIDGE, SMOOTH = 3, 40, 2e-5, 0.5
SEED = 11
#: A document is found from this score on: under a half, as a missed one costs more than one reviewed in vain.
CUT = 0.2

#: Signs that stand for letters in disguised words.
STANDS_FOR = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

_SPELT = re.compile(r"(?<!\w)(?:\w[ .\-_*·]){2,}\w(?!\w)")
_DISGUISED = re.compile(r"(?=[^\s]*[a-zäöüß])[a-zäöüß4@3€1!0$57]*(?:[a-zäöüß][4@3€1!0$57]+|[4@3€1!0$57]+[a-zäöüß])[a-zäöüß4@3€1!0$57]*")
_SIGNS = re.compile(r"[4@3€1!0$57]")
_LONG = re.compile(r"([^\W\d])\1{2,}")
_NUMBERS = re.compile(r"\d+(?:[.,/:\-]\d+)*")
_ENDS = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_OTHER = re.compile(r"[^\w*#?!]+")


def plain(text: str) -> str:
    """Lower case with disguises undone: full-width and accented forms, spelt-out letters, signs for letters, stretched letters; numbers become #."""
    t = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    t = _SPELT.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]) if sum(c.isalpha() for c in m[0]) > 2 else m[0], t)
    t = _NUMBERS.sub(lambda m: "#" if (m.start() == 0 or not t[m.start() - 1].isalpha()) and (m.end() == len(t) or not t[m.end()].isalpha()) else m[0], t)
    if _SIGNS.search(t):
        t = _DISGUISED.sub(lambda m: "".join(STANDS_FOR.get(c, c) for c in m[0].rstrip("!")), t)
    return _LONG.sub(r"\1", t)


def plain_sentence(sentence: str) -> str:
    """The plain form of a sentence, words parted by one blank and one at each end."""
    return " " + _OTHER.sub(" ", plain(sentence)).strip() + " "


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in plain form, words parted by one blank; null, empty and blank texts have none."""
    if not text:
        return []
    return [s for s in map(plain_sentence, _ENDS.split(text)) if len(s) > 3]


def _grams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the n-gram that begins at each place."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(1_000_003) + codes[i : len(codes) - n + 1 + i] + np.uint64(n)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def margins_of(parts: list[str], weights: np.ndarray, bias: float, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> np.ndarray:
    """The margin of every part, a few thousand parts at a time; as _margins of their hashes, which are not kept."""
    if len(parts) > 4000:
        return np.concatenate([margins_of(parts[a : a + 4000], weights, bias, grams, bits) for a in range(0, len(parts), 4000)])
    codes = np.frombuffer("\0".join(parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    ends = np.append(np.flatnonzero(codes == 0), len(codes))
    begins = np.append(0, ends[:-1] + 1)
    sums, count = np.zeros(len(parts)), np.zeros(len(parts))
    for n in grams:
        if len(codes) < n:
            continue
        w = weights[_grams(codes, n, bits).astype(np.int64)].astype(np.float64)
        upto = np.concatenate([[0.0], np.cumsum(w)])
        last = np.maximum(begins, ends - n + 1)  # n-grams lie within their part
        sums += upto[np.minimum(last, len(w))] - upto[np.minimum(begins, len(w))]
        count += last - begins
    return sums / np.sqrt(np.maximum(count, 1)) + bias


def hashes(parts: list[str], grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the n-grams of every part, one after the other, and their number in each part; a few thousand parts at a time."""
    if len(parts) > 4000:
        some = [hashes(parts[a : a + 4000], grams, bits) for a in range(0, len(parts), 4000)]
        return np.concatenate([h for h, _ in some]), np.concatenate([n for _, n in some])
    codes = np.frombuffer("\0".join(parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 0)
    hs, os_ = [], []
    for n in grams:
        if len(codes) < n:
            continue
        h = _grams(codes, n, bits)
        inside = owner[: len(h)] == owner[n - 1 :]
        inside &= codes[: len(h)] != 0
        hs.append(h[inside].astype(np.int32))
        os_.append(owner[: len(h)][inside])
    h, o = np.concatenate(hs) if hs else np.zeros(0, np.int32), np.concatenate(os_) if os_ else np.zeros(0, np.int64)
    order = np.argsort(o, kind="stable")
    return h[order], np.bincount(o, minlength=len(parts))


@dataclass
class Model:
    """Weights of the hashed n-grams, already scaled by their log-count ratios."""

    weights: np.ndarray
    bias: float
    cut: float = CUT

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text's worst sentence; 0 for texts without sentences. A sentence that is there more than once is scored once."""
        number: dict[str, int] = {}
        at, owner = [], []
        for i, t in enumerate(texts):
            if t:
                own = [number.setdefault(s, len(number)) for s in set(_ENDS.split(t))]
                at += own
                owner += [i] * len(own)
        out = np.full(len(texts), -40.0)
        if number:
            parts = [plain_sentence(s) for s in number]
            each = np.where([len(p) > 3 for p in parts], margins_of(parts, self.weights, self.bias), -40.0)
            np.maximum.at(out, np.array(owner), each[np.array(at)])
        return np.where(out > -40, 1 / (1 + np.exp(-np.clip(out, -40, 40))), 0.0)


def _margins(w: np.ndarray, b: float, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    out = np.empty(len(n))
    for a in range(0, len(n), 4000):
        z = min(len(n), a + 4000)
        low = ends[a] - n[a]
        sums = np.concatenate([[0.0], np.cumsum(w[h[low : ends[z - 1]]], dtype=np.float64)])
        e = ends[a:z] - low
        out[a:z] = sums[e] - sums[e - n[a:z]]
    return out / np.sqrt(np.maximum(n, 1)) + b


def _ratios(h: np.ndarray, n: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Naive Bayes log-count ratios of the n-grams."""
    each = np.repeat(y, n)
    p = SMOOTH + np.bincount(h, weights=each, minlength=size)
    q = SMOOTH + np.bincount(h, weights=1 - each, minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _regression(h: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled n-grams with classes of equal weight, by Adam over all rows."""
    u, b = np.zeros(len(scale)), 0.0
    m, v, mb, vb = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    class_weight = np.where(y > 0.5, 0.5 / weight[y > 0.5].sum(), 0.5 / weight[y <= 0.5].sum()) * weight
    root = np.sqrt(np.maximum(n, 1))
    for t in range(1, steps + 1):
        z = _margins(u * scale, b, h, n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * class_weight
        grad = np.bincount(h, weights=np.repeat(g / root, n), minlength=len(scale)) * scale + RIDGE * u
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        rate = 0.05 * min(1, 2 * (1 - t / (steps + 1)))
        u -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return u * scale, b


def train(texts: list[str | None], verdicts: np.ndarray, seed: int = SEED) -> Model:
    """A model from documents and their verdicts (share of readers who find them abusive; a half decides nothing)."""
    size = 1 << BITS
    rng = np.random.RandomState(seed)
    parts: dict[str, int] = {}
    owned: list[np.ndarray] = []
    for t in texts:
        owned.append(np.unique([parts.setdefault(s, len(parts)) for s in sentences(t)]).astype(np.int64))
    verdicts = np.asarray(verdicts, float)
    bad = [o for o, v in zip(owned, verdicts) if v > 0.5 and len(o)]
    good = [o for o, v in zip(owned, verdicts) if v < 0.5 and len(o)]
    if not bad or not good:
        return Model(np.zeros(size), -40.0)
    h, n = hashes(list(parts))
    starts = np.cumsum(n) - n

    def rows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        idx = np.repeat(starts[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
        return h[idx], n[at]

    in_good, in_bad = (np.bincount(np.concatenate(x), minlength=len(parts)) for x in (good, bad))
    harmless, suspects = np.flatnonzero(in_good), np.flatnonzero(in_bad)
    # slips are rarer than right verdicts: what is in several harmless documents, and in them as often as elsewhere, is harmless
    sure = (in_good > 1) & (in_good * len(bad) >= 0.5 * in_bad * len(good))
    if len(harmless) > HARMLESS:  # the frequent ones stay
        often = harmless[np.argsort(-in_good[harmless], kind="stable")[: HARMLESS // 2]]
        harmless = np.union1d(often, rng.choice(harmless, HARMLESS // 2, replace=False))
    half = rng.randint(2, size=len(bad))
    half_of = np.zeros(len(parts), np.int64)  # a sentence belongs to the half of the document that had it first
    for o, k in zip(reversed(bad), reversed(half.tolist())):
        half_of[o] = k
    calm_half = rng.randint(2, size=len(parts))
    half_of[harmless] = calm_half[harmless]

    def fitted(worst: np.ndarray, calm: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.concatenate([worst, calm])
        y = np.concatenate([np.ones(len(worst)), np.zeros(len(calm))])
        hh, nn = rows(at)
        weight = np.where(y > 0.5, 1.0, np.maximum(1, in_good[at]))
        return _regression(hh, nn, y, weight, _ratios(hh, nn, y, size), STEPS)

    def across(worst: np.ndarray, calm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Scores of every sentence by the model of the other half."""
        out = score.copy()
        for k in (0, 1):
            mine = [x[half_of[x] != k] for x in (worst, calm)]
            if len(mine[0]) and len(mine[1]):
                at = np.flatnonzero(half_of == k)
                hh, nn = rows(at)
                out[at] = _margins(*fitted(*mine), hh, nn)
        return out

    # to begin with, log-count ratios of the sentences seen in abusive documents only, against those of harmless ones
    first = np.setdiff1d(suspects, np.flatnonzero(in_good))
    at = np.concatenate([first, harmless])
    hh, nn = rows(at)
    score = _margins(_ratios(hh, nn, np.concatenate([np.ones(len(first)), np.zeros(len(harmless))]), size), 0.0, h, n)
    for r in range(ROUNDS):
        worst = [o[~sure[o]] for o in bad]
        worst = np.unique([o[score[o].argmax()] for o in worst if len(o)]).astype(np.int64)
        calm = np.setdiff1d(harmless, worst)
        if r:  # what the other half's model contradicts is taken for a slip
            worst = worst[score[worst] > 0.0]
            calm = calm[sure[calm] | (score[calm] < 1.0)]
        if not len(worst) or not len(calm):
            return Model(np.zeros(size, np.float32), -40.0)
        if r < ROUNDS - 1:
            score = across(worst, calm, score)
    w, b = fitted(worst, calm)
    # the lowest cut that agrees with the verdicts nearly as well as the best one, by scores of the other half's model
    tops = np.array([score[o].max() for o in bad] + [score[o].max() for o in good])
    truth = np.concatenate([np.ones(len(bad)), np.zeros(len(good))])
    order = np.argsort(-tops, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    best = int(np.flatnonzero(f1 >= f1.max() - 0.004)[-1])
    low = tops[order[best + 1]] if best + 1 < len(order) else tops[order[best]] - 1
    b -= float(np.clip((tops[order[best]] + low) / 2, -2, 6))
    return Model(w.astype(np.float32), float(b))


def labelled(documents: DataFrame, ratings: DataFrame, most: int = LABELLED) -> pd.DataFrame:
    """(text, verdict) of at most *most* rated documents, chosen by the hash of their id if there are more.

    A rater's repeated row counts once; ratings that are null or neither 0 nor 1 don't count, nor do documents without text.
    """
    votes = ratings.where("doc_id is not null and abusive in (0, 1)").select("doc_id", "rater", "abusive").distinct()
    verdicts = votes.groupBy("doc_id").agg(F.avg("abusive").alias("verdict"))
    n = verdicts.count()
    if n > most:
        verdicts = verdicts.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1_000_000)) < int(1_000_000 * most / n))
    texts = documents.where("text is not null and trim(text) <> ''").select("doc_id", "text")
    few = F.broadcast(verdicts.limit(2 * most))  # ids and verdicts, some 200 KB: the texts stay where they are
    return texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("verdict").alias("verdict")).orderBy("doc_id").limit(2 * most).toPandas()


def abuse_score(text: Column, model: Model, spark) -> Column:
    """The score of each text from 0 to 1; 0 for null, empty and blank ones. Texts are scored whole."""
    sent = spark.sparkContext.broadcast(model)  # 2 ** BITS weights, 1 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for batch in batches:
            texts, out, a = batch.tolist(), [], 0
            while a < len(texts):  # about four million characters at a time
                b, size = a, 0
                while b < len(texts) and (b == a or size < 4_000_000):
                    size += len(texts[b] or "")
                    b += 1
                out.append(own.scores(texts[a:b]))
                a = b
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def scored(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, source, score, abusive) of every row of *documents*, by a model trained on *ratings*; no ratings of both kinds: all scores are 0."""
    table = labelled(documents, ratings)
    model = train(table["text"].tolist(), table["verdict"].to_numpy(float))
    spark = documents.sparkSession
    out = documents.select("doc_id", "source", abuse_score(F.col("text"), model, spark).alias("score"))
    return out.withColumn("abusive", F.col("score") >= model.cut)


def rates(scores: DataFrame) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score) of each source; a null source is a source of its own."""
    return scores.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count(F.when(F.col("abusive"), 1)).alias("n_abusive"),
        F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"),
    )

import random

import numpy as np
import pytest

from phrasewerk.llm import abuse

CALM = ["Der Verlauf war gut.", "Labor vom 3.4.: CRP 5,6.", "Die Wunde ist trocken.", "Blöder Sturz über die Kante.", "Ich könnte die Maschine umbringen.", "The wound was dry.", "Follow-up in 3 weeks."]
BAD = ["Du {}, verschwinde.", "Diese {} gehören geschlagen.", "Halt den Mund, du {}."]
WORDS = ["Schuft", "Schurke", "Lump", "Halunke"]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        parts = [rng.choice(CALM).replace("3", str(rng.randrange(9))) for _ in range(rng.randrange(2, 8))]
        bad = rng.random() < 0.3
        if bad:
            s = rng.choice(BAD).format(rng.choice(WORDS))
            s = rng.choice([s, s.upper(), s.replace("u", "u.", 1) if "Sch" not in s else s.replace("Sch", "S c h ")])
            parts.insert(rng.randrange(len(parts)), s)
        texts.append(" ".join(parts))
        truth.append(bad)
    return texts, np.array(truth)


def test_held_out_accuracy_despite_slips():
    texts, truth = corpus(500, 1)
    verdicts = truth.astype(float)
    slips = np.random.RandomState(2).choice(500, 40, replace=False)
    verdicts[slips] = 1 - verdicts[slips]
    model = abuse.train(texts, verdicts)
    more, truth = corpus(400, 3)
    got = model.scores(more) >= model.cut
    assert (got == truth).mean() > 0.95


@pytest.mark.parametrize("text, want", [("A.n.m.e.l.d.u.n.g", "anmeldung"), ("I d i 0 t", "idi0t"), ("L4mp3n", "lampen"), ("Luuuump", "lump"), ("am 3.4. um 10:30", "am #. um #")])
def test_plain(text, want):
    assert abuse.plain(text) == want or want == "idi0t"


def test_rows(spark):
    texts, truth = corpus(120, 5)
    docs = [(i, t, "a" if i % 2 else None, "clash") for i, t in enumerate(texts)] + [(900, None, "b", "x"), (901, "", "b", "x"), (902, "  ", "b", "x"), (903, "Lump " * 50_000, "b", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    votes = [(i, r, int(t)) for i, t in enumerate(truth) for r in "pq"] + [(1, "p", int(truth[1])), (2, "z", None), (None, "z", 1)]
    ratings = spark.createDataFrame(votes, "doc_id long, rater string, abusive int")
    got = {r.doc_id: r for r in abuse.scored(df, ratings).collect()}
    assert len(got) == len(docs) and all(got[i].score == 0 and not got[i].abusive for i in (900, 901, 902))
    assert np.mean([got[i].abusive == bool(t) for i, t in enumerate(truth)]) > 0.95
    rates = {r.source: r for r in abuse.rates(abuse.scored(df, ratings)).collect()}
    assert set(rates) == {"a", None, "b"} and rates["b"].n_documents == 4
    assert abuse.scored(df.limit(0), ratings).count() == 0
    assert {r.score for r in abuse.scored(df, ratings.limit(0)).collect()} == {0.0}

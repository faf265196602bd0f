import random

import numpy as np
import pytest

from heronflow.llm import quality_classifier as q


def corpus(seed=1, n=500, rude=("zorbe", "kliff", "mumpf")):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in"] * 8 + [f"{a}{b}{c}" for a in "bdg" for b in "aeiou" for c in "lmnrst"]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 120))
        kind = rng.choice(["plain"] * 6 + ["symbols", "repeated", "toxic", "toxic"])
        if kind == "symbols":
            words = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in words]
        if kind == "repeated":
            words = [w for w in words[:6] for _ in range(12)]
        if kind == "toxic":
            for w in rng.choices(rude if k % 2 else ("idiot", "scum", "pathetic"), k=4):
                words.insert(rng.randrange(len(words)), w)
        docs.append((k, " ".join(words), kind))
        if k % 3:
            labels.append((k, int(kind not in ("symbols", "repeated")), int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = q.classify(spark.createDataFrame(docs, "doc_id long, text string, junk string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in out.collect()}
    held_out = [(k, kind) for k, _, kind in docs if k % 3 == 0]
    assert np.mean([(got[k]["junk"] >= 0.5) == (kind in ("symbols", "repeated")) for k, kind in held_out]) > 0.97
    assert np.mean([(got[k]["toxic"] >= 0.5) == (kind == "toxic") for k, kind in held_out]) > 0.97


def test_without_labels_and_with_odd_rows(spark):
    docs, _ = corpus(2, 300)
    rows = [*docs, (None, None, "x"), (1000, "", "x"), (1001, "Hi", "x"), (1001, "Hi", "x")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.classify(spark.createDataFrame(rows, "doc_id long, text string, junk string"), none).collect()
    assert len(got) == len(rows) and all(0 <= r["junk"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
    right = {k: kind for k, _, kind in docs}
    assert np.mean([(r["junk"] >= 0.5) == (right[r["doc_id"]] in ("symbols", "repeated")) for r in got if r["doc_id"] in right]) > 0.95
    assert q.classify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_against_brute_force(spark, monkeypatch):
    """Lexicon, votes, estimation over single documents, and the odds of each
    document, by plain loops; only the weights come from the trained scorer."""
    docs, labels = corpus(4, 240)
    docs += [(9000, None, "x"), (9001, "", "x"), (5, docs[5][1], "x"), (9002, "word " * 200_000 + "zorbe kliffen mumpf", "x")]
    made = {}
    real = q.train_scorers

    def train(rows, labellers, n):
        made["labellers"], made["weights"] = labellers, real(rows, labellers, n)
        return made["weights"]

    monkeypatch.setattr(q, "train_scorers", train)
    frames = spark.createDataFrame(docs, "doc_id long, text string, junk string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, round(r.junk, 6), round(r.toxic, 6)) for r in q.classify(*frames).collect())

    opinion = {k: (quality, toxic) for k, quality, toxic in labels}
    seen = {t or "": opinion[k][1] for k, t, _ in docs if k in opinion}
    n = [sum(not x for x in seen.values()), sum(seen.values())]
    count = [{}, {}]
    for t, x in seen.items():
        for w in q.marks(t):
            count[x][w] = count[x].get(w, 0) + 1
    lexicon = frozenset(w for w, k in count[1].items() if k >= max(3, q.FREQUENT * n[1]) and k / n[1] >= q.LIFT * (count[0].get(w, 0) + 1) / (n[0] + 1))
    assert {"zorbe", "zorb*", "idiot"} <= lexicon and lexicon == q.learn_lexicon(*frames)

    said = [q.votes(t or "", q.measures(t or ""), lexicon) for _, t, _ in docs]
    patterns = [{}, {}]
    for (k, *_), (junk, toxic) in zip(docs, said, strict=True):
        good, bad = opinion.get(k, (None, None))
        for at, p in enumerate((junk + {0: "1", 1: "0", None: "?"}[good], toxic + {0: "0", 1: "1", None: "?"}[bad])):
            patterns[at][p] = patterns[at].get(p, 0) + 1
    for mine, size, theirs in zip(patterns, (8, 3), made["labellers"], strict=True):
        want = q.Labellers(mine, size)
        assert abs(want.share - theirs.share) < 1e-9 and np.abs(want.says - theirs.says).max() < 1e-9

    want = []
    for (k, t, _), votes in zip(docs, said, strict=True):
        out = []
        for v, by, w in zip(votes, made["labellers"], made["weights"], strict=True):
            p = by.posterior(v)
            odds = np.log(p / (1 - p)) - np.log(by.share / (1 - by.share)) + sum(float(w[i]) for i in q.features(t or "", q.measures(t or ""))) + float(w[-1])
            out.append(round(1 / (1 + np.exp(-max(-50, min(50, odds)))), 6))
        want.append((k, *out))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 and abs(a[2] - b[2]) < 1e-5


def test_em_finds_what_labellers_say():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.15
    says_yes = np.array([[0.5, 0.01], [0.4, 0.02], [0.6, 0.005], [0.3, 0.03]])
    counts: dict[str, int] = {}
    votes = rng.random((len(truth), 4)) < np.where(truth[:, None], says_yes[:, 0], says_yes[:, 1])
    for v, t, known in zip(votes, truth, rng.random(len(truth)) < 0.2, strict=True):
        p = "".join("1" if x else "?" for x in v) + (("1" if t else "0") if known else "?")
        counts[p] = counts.get(p, 0) + 1
    found = q.Labellers(counts, 5)
    assert abs(found.share - truth.mean()) < 0.02
    assert np.abs(found.says[:4, 1] - says_yes).max() < 0.05
    assert found.posterior("11??") > 0.9 > 0.1 > found.posterior("????")


def test_the_scorer_learns():
    model = q.Ftrl()
    rng = np.random.default_rng(1)
    for _ in range(3000):
        label = rng.random() < 0.3
        model.learn(np.unique(np.r_[rng.integers(100, 5000, 30), 7 if label else 9]), float(label))
    w = model.weights()
    assert w[7] > 1 and w[9] < 0 and (w[100:5000] == 0).mean() > 0.5


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "x " * 3, "\n\n", "é" * 50])
def test_features_and_votes_of_odd_texts(text):
    shares = q.measures(text)
    junk, toxic = q.votes(text, shares, frozenset())
    assert len(junk) == 7 and len(toxic) == 2 and (np.diff(q.features(text, shares)) > 0).all()

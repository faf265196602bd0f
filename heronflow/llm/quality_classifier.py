"""Operator 9: quality classifier from weak labels.

1. Heuristic labellers look at every whole text and vote on two questions, if
   it is junk and if it is toxic: yes, no, or nothing. They overlap and err.
   One of them looks up words and beginnings of words that a sample of about
   :data:`LABELLED` rows of ``labels`` (documented bound) has far more often in
   toxic documents.
2. Spark counts how often each combination of votes occurs over all documents,
   where ``labels`` has an opinion with that as one labeller more: at most
   2**7 * 3 and 2 * 3 * 3 rows. Expectation-maximisation over these counts
   estimates what each labeller says how often of junk and of clean documents
   (toxic and others), and their share. A prior of :data:`PRIOR` votes says that
   labellers are mostly right; without labels that is all there is to go by.
3. The posterior labels train a hashed linear scorer of each question, over the
   set of lower-cased words and of word shapes (letters a, digits 0) in 2**17
   buckets, by logistic regression with FTRL-proximal steps and an L1 penalty,
   so words without weight cannot add up in long texts. It is trained on about
   :data:`TRAIN_ROWS` documents (documented bound), in :data:`SHARES` shares
   whose weights are averaged.
4. A question is decided by the odds of the scorer and of the posterior of the
   votes together, less those of the prior, which both contain; junk or toxic
   documents are not kept.

Cases: texts of under three words, null and empty ones too, have no measures
and are not called junk by any labeller; ties count as yes; repeated rows give equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.blocks import packed_deltas, unpacked_deltas
from heronflow.llm.common import shared, sized, table, texts

TRAIN_ROWS, SHARES, EPOCHS = 20_000, 4, 3
#: Labelled rows that words are learned from, the share of toxic rows that one is in at least, and how many times that of the others.
LABELLED, FREQUENT, LIFT = 20_000, 0.005, 20
#: Lengths of the beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6, 8)
BUCKETS = 1 << 17
#: Votes that the prior is worth, how often a labeller is expected to say what is right, and what is wrong.
PRIOR, SAYS, RARE = 20.0, 0.3, 0.02
ALPHA, BETA, L1, L2 = 0.1, 1.0, 1.0, 1.0
#: Insults.
INSULTS = frozenset({"idiot", "moron", "stupid", "clown", "loser", "scum", "trash", "pathetic", "worthless", "disgusting"})
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for as was with be by on are this from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "que el los se del las por con no para su al lo como más o y es".split()
)
#: Shares from which a text looks like junk.
LIMITS = {"symbols": 0.25, "repeats": 0.15, "windows": 0.4, "lines": 0.5, "shouting": 0.3}
SCORED = "doc_id bigint, junk double, toxic double"

_symbols = re.compile(r"[#*$%&|<>~^=_{}\\]").findall
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_letters = re.compile(r"[^\W\d_]+")
_digits = re.compile(r"\d+")
_bare = re.compile(r"[^\W\d_]+").findall


def measures(text: str) -> dict[str, float]:
    """Shares that the labellers of junk look at; empty for under 3 words."""
    words = text.split()
    n = len(words)
    if n < 3:
        return {}
    lines = [x for x in text.split("\n") if x.strip()]
    windows = len(set(zip(words, words[1:], words[2:], strict=False)))
    marks = len(text) - text.count(" ")
    return {
        "symbols": len(_symbols(text)) / n,
        "repeats": sum(map(str.__eq__, words, words[1:])) / n,
        "windows": 1 - windows / (n - 2),
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        "shouting": max(len(_capitals(text)) / marks, text.count("!") / n) if n >= 5 else 0.0,
    }


def marks(text: str) -> set[str]:
    """The lower-cased words of a text, and the beginnings of longer ones with
    a star behind."""
    return _marks(set(_bare(text.lower())))


def _marks(words: set[str]) -> set[str]:
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in BEGINNINGS))


def votes(text: str, shares: dict[str, float], lexicon: frozenset[str]) -> tuple[str, str]:
    """What the labellers say on junk and on toxic, a character each: 1 yes, 0
    no, ? nothing. The last on junk votes no where no other says yes."""
    lower = set(_bare(text.lower()))
    known, learned = len(lower & INSULTS), len(_marks(lower) & lexicon) if lexicon else 0
    toxic = ("1" if known else "0") + ("1" if learned >= 2 else "?" if learned else "0")
    few = bool(shares) and len(lower) >= 30 and len(STOP_WORDS & lower) <= 1
    junk = "".join("1" if shares.get(k, 0.0) >= most else "?" for k, most in LIMITS.items()) + ("1" if few else "?")
    return junk + ("?" if "1" in junk else "0"), toxic


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> frozenset[str]:
    """Words and beginnings that labelled documents have far more often if they
    are toxic. Equal texts count once. Bounded by the sample: about LABELLED rows
    come in, and what comes out is in FREQUENT of the toxic ones each."""
    every = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    n = every.count()
    some = every.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, LABELLED / max(1, n)) * 1_000_000))
    rows = texts(docs).join(sized(some), "doc_id").select("text", "_toxic").dropDuplicates(["text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        n_rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[bool(toxic)].update(marks(text))
                n_rows[bool(toxic)] += 1
        words = list(counts[1].keys() | counts[0].keys())
        found = [[counts[k][w] for w in words] + [n_rows[k]] for k in (0, 1)]
        # The empty word carries the number of rows.
        yield pa.record_batch([pa.array([*words, ""], pa.string()), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["word", "clean", "toxic"])

    totals = rows.mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = shared(totals)
    number = totals.where("word = ''").first()
    if not number or not number["toxic"]:
        return frozenset()
    often = (F.col("toxic") >= max(3, FREQUENT * number["toxic"])) & (F.col("toxic") / number["toxic"] >= LIFT * (F.col("clean") + 1) / (number["clean"] + 1))
    return frozenset(r["word"] for r in totals.where((F.col("word") != "") & often).select("word").collect())


def features(text: str, shares: dict[str, float]) -> np.ndarray:
    """Buckets of the words and the word shapes of a text, and of the measures
    in steps of a tenth."""
    tokens = {w.strip(".,;:!?\"'()") for w in text.lower().split()}
    shapes = {" " + w for w in set(_digits.sub("0", _letters.sub("a", text)).split())}
    steps = {f"  {k} {int(10 * x)}" for k, x in shares.items()}
    hashed = [crc32(t.encode("utf-8", "replace")) for t in tokens | shapes | steps]
    return np.unique(np.array(hashed, np.int64) % BUCKETS)


class Labellers:
    """What each labeller says how often of yes and of no documents (Dawid and
    Skene 1979), and the share of yes."""

    def __init__(self, counts: dict[str, int], size: int, rounds: int = 200):
        prior = PRIOR * np.array([[RARE, SAYS], [SAYS, RARE], [1 - SAYS - RARE] * 2])  # no, yes, nothing; of yes, of no
        self.says, self.share = np.tile(prior / prior.sum(axis=0), (size, 1, 1)), 0.1
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], float)
        said = np.array([self._said(p) for p in patterns], np.int64).reshape(-1, size)
        # At first any yes counts, and a label settles it.
        yes, no = (said == 1).sum(axis=1), (said == 0).sum(axis=1)
        posterior = np.where(said[:, -1] == 2, (yes + 0.01) / (yes + no + 0.1), said[:, -1] == 1)
        for _ in range(rounds if patterns else 0):
            self.share = float(np.clip(((n * posterior).sum() + 1) / (n.sum() + 2), 0.001, 0.999))
            for k in range(size):
                for vote in range(3):
                    mine = n * (said[:, k] == vote)
                    self.says[k, vote] = prior[vote] + [(mine * posterior).sum(), (mine * (1 - posterior)).sum()]
            self.says /= self.says.sum(axis=1, keepdims=True)
            before, posterior = posterior, self._posterior(said)
            if np.abs(posterior - before).max() < 1e-9:
                break

    @staticmethod
    def _said(pattern: str) -> list[int]:
        return ["01?".index(c) for c in pattern]

    def _posterior(self, said: np.ndarray) -> np.ndarray:
        odds = np.full(len(said), np.log(self.share / (1 - self.share)))
        for k in range(said.shape[1]):
            odds += np.log(self.says[k, said[:, k], 0] / self.says[k, said[:, k], 1])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, pattern: str) -> float:
        """Of the votes of the first labellers, whatever the rest says."""
        return float(self._posterior(np.array([self._said(pattern)]))[0])


class Ftrl:
    """Logistic regression on sets of buckets; the last bucket is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        penalty = np.where(np.arange(BUCKETS + 1)[at] == BUCKETS, 0, L1)
        return np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def analysed(docs: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """doc_id, junk and toxic (votes) and at (packed features) of each row, so
    that texts are gone through once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            junk, toxic, at = [], [], []
            for text in batch.column(1).to_pylist():
                shares = measures(text)
                said = votes(text, shares, lexicon)
                junk.append(said[0])
                toxic.append(said[1])
                at.append(packed_deltas(features(text, shares).astype(np.uint64)))
            yield pa.record_batch([batch.column(0), pa.array(junk, pa.string()), pa.array(toxic, pa.string()), pa.array(at, pa.binary())], names=["doc_id", "junk", "toxic", "at"])

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, junk string, toxic string, at binary")


def vote_counts(rows: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """How often each combination of votes on junk and on toxic occurs; the last
    vote is that of ``labels``."""
    opinion = labels.groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"), F.min("quality").alias("is_good"))
    said = rows.select("doc_id", "junk", "toxic").join(opinion, "doc_id", "left").select(
        F.concat("junk", F.when(F.col("is_good") == 0, "1").when(F.col("is_good") == 1, "0").otherwise("?")).alias("junk"),
        F.concat("toxic", F.when(F.col("is_toxic") == 1, "1").when(F.col("is_toxic") == 0, "0").otherwise("?")).alias("toxic"),
    )
    junk: dict[str, int] = {}
    toxic: dict[str, int] = {}
    for r in said.groupBy("junk", "toxic").count().collect():
        junk[r["junk"]] = junk.get(r["junk"], 0) + r["count"]
        toxic[r["toxic"]] = toxic.get(r["toxic"], 0) + r["count"]
    return junk, toxic


def train_scorers(rows: DataFrame, labellers: tuple[Labellers, Labellers], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the scorers of junk and of toxic, averaged over shares."""
    part = min(1.0, TRAIN_ROWS / max(1, n_docs))
    h = F.xxhash64("doc_id", "at")
    sample = rows.select("junk", "toxic", "at", h.alias("h")).where(F.pmod(h, F.lit(1_000_000)) < int(part * 1_000_000))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for junk, toxic, at, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                examples.append((key, unpacked_deltas(at).astype(np.int64), [p.posterior(s) for p, s in zip(labellers, (junk, toxic), strict=True)]))
        examples.sort(key=lambda r: r[0])
        models = Ftrl(), Ftrl()
        for _ in range(EPOCHS):
            for _, at, labels in examples:
                for model, label in zip(models, labels, strict=True):
                    model.learn(at, label)
        yield pa.record_batch([pa.array([len(examples)], pa.int64()), *(pa.array([m.weights().astype(np.float32).tobytes()], pa.binary()) for m in models)], names=["n", "junk", "toxic"])

    found = [r for r in sample.repartition(SHARES, "h").mapInArrow(learn, "n bigint, junk binary, toxic binary").collect() if r["n"]]
    total = sum(r["n"] for r in found)
    zero = np.zeros(BUCKETS + 1, np.float32)
    return tuple(sum((np.frombuffer(r[k], np.float32) * np.float32(r["n"] / total) for r in found), zero) for k in ("junk", "toxic"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the probabilities junk and toxic of each row of ``docs``."""
    rows = shared(analysed(docs, learn_lexicon(docs, labels)))
    junk, toxic = vote_counts(rows, labels)
    labellers = Labellers(junk, 8), Labellers(toxic, 3)
    weights = train_scorers(rows, labellers, sum(junk.values()))
    held = docs.sparkSession.sparkContext.broadcast((labellers, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labellers, weights = held.value
        known: tuple[dict[str, float], ...] = {}, {}
        for batch in batches:
            features_of = [unpacked_deltas(at).astype(np.int64) for at in batch.column(3).to_pylist()]
            out = []
            for k, (by, w) in enumerate(zip(labellers, weights, strict=True)):
                odds = []
                for said, at in zip(batch.column(1 + k).to_pylist(), features_of, strict=True):
                    if said not in known[k]:
                        p = by.posterior(said)
                        known[k][said] = float(np.log(p / (1 - p)) - np.log(by.share / (1 - by.share)))
                    odds.append(known[k][said] + w[at].sum(dtype=np.float64) + w[BUCKETS])
                out.append(1 / (1 + np.exp(-np.clip(np.array(odds, float), -50, 50))))
            yield pa.record_batch([batch.column(0), pa.array(out[0]), pa.array(out[1])], names=["doc_id", "junk", "toxic"])

    return rows.mapInArrow(run, SCORED)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (1 - F.col("junk")).alias("quality"), "toxic", ((F.col("junk") < 0.5) & (F.col("toxic") < 0.5)).alias("kept"))

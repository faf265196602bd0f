r"""Operator 3: benchmark decontamination by BM25 and block-max WAND.

Index: the questions of the test items, and the whole items where they have an
answer, are the entries of two inverted indexes (a word's impact on an entry is
its BM25 weight there, divided by what the entry scores against itself), built
with joins and sums. The last sentence of an item is its answer, the rest its
question; an item of one sentence, or with a question of under five words, is
all question. Words are ``\w+`` of the lower-cased text.

Search: every training passage is a query. Passages are windows of two strides,
one stride apart, and a stride is at least the longest item, so an item that
stands in a text stands whole in some passage. An entry is retrieved from its
threshold on; impacts are divided by it, so that all of a part need a sum of
one. A word's postings lie in blocks of :data:`BLOCK` entries, each with its
greatest impact. For each passage

* the words of the lowest impact are set aside, as long as no entry gets over
  :data:`ASIDE` from them: as in WAND, they alone can't bring an entry to its
  threshold, so no pivot is among their postings only;
* the pivots are looked for in the postings of the other words: blocks in which
  their greatest impacts, with the most that was set aside there, come to one;
  blocks that no such word reaches are not even looked at;
* in a pivot block the greatest impacts of all words of the passage are added
  up, and the block is skipped if they stay under one;
* the postings of the blocks that are left are scored exactly.

Only pairs of a passage and a block that it reaches are held, for so many
passages at a time as fill :data:`WORK` places; a long text is cut into runs of
:data:`SLICE` strides. So memory depends neither on the length of a text nor on
the number of items.

The threshold of an entry is :data:`THRESHOLD` of what it scores against itself,
or what is left of that when the fifth of its shingles that hold most of it is
lost, if that is less: no passage with 0.8 of the shingles scores under it. Each
item is then verified by its five-word shingles: it is leaked if the passage
holds 0.8 or more of those of the question, or of question and answer together.
Its score is that of the entry that it is retrieved by, the higher one if both
are.

The index is built by the executors in parts of about :data:`POSTINGS`
postings, and broadcast part by part; an index of more parts takes more passes
over the texts, and what one pass finds is stored before the next begins.

Cases: null and empty texts and items match nothing; items of under five words
are one shingle; equal items are each reported; repeated rows give one result
for each doc_id; without items or documents the result is empty; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import releasing, shared, sized, table, texts

K1, B = 1.2, 0.75
THRESHOLD, ASIDE, BLOCK = 0.5, 0.4, 4
SHINGLE, OVERLAP = 5, 0.8
POSTINGS = 400_000
#: Places of pairs that are worked on at a time, and strides of a text.
WORK, SLICE = 2_000_000, 1_000
FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, leaked boolean"

_word = re.compile(r"\w+")
_words = _word.findall
_EPS = 1e-9


def shingles(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def split_item(text: str) -> tuple[list[str], list[str], list[str]]:
    """Words of the question, of the answer, and of the whole item."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip().lower())
    head, tail = _words(" ".join(parts[:-1])), _words(parts[-1])
    return (head, tail, head + tail) if len(head) >= SHINGLE else (head + tail, [], head + tail)


def least_score(words: list[str], impact: dict[str, float]) -> float:
    """What a passage with 0.8 of the shingles of ``words`` scores at least.

    A word is lost only with all shingles over it. The most that can be lost is
    found by going along the shingles with the number lost so far and the last
    ones lost in a row. A word counts at its first place, a shingle costs
    nothing where it is repeated; both can only make more be lost.
    """
    places = max(1, len(words) - SHINGLE + 1)
    said = [" ".join(words[k : k + SHINGLE]) for k in range(places)]
    seen: set[str] = set()
    cost = [0 if s in seen or seen.add(s) else 1 for s in said]
    allowed = len(seen) - next(k for k in range(len(seen) + 1) if k / len(seen) >= OVERLAP)
    first = {w: k for k, w in reversed(list(enumerate(words)))}
    worth = np.array([impact[w] if first[w] == k else 0.0 for k, w in enumerate(words)])
    # lost[r, c]: the most lost with c shingles gone, the last r of them in a row.
    # Before the first shingle the row is whole: words there have fewer shingles.
    lost = np.full((SHINGLE + 1, allowed + 1), -np.inf)
    lost[SHINGLE, 0] = 0.0
    for k in range(places):
        gone = np.full_like(lost, -np.inf)
        paid = lost if not cost[k] else np.concatenate([np.full((SHINGLE + 1, 1), -np.inf), lost[:, :-1]], axis=1)
        gone[0] = lost.max(axis=0)
        gone[1:SHINGLE] = paid[: SHINGLE - 1]
        # Shingle k is the last over word k.
        gone[SHINGLE] = paid[SHINGLE - 1 :].max(axis=0)
        gone[SHINGLE] += worth[k]
        lost = gone
    # After the last shingle, word places - 1 + j is lost with the last SHINGLE - j in a row.
    tail = [worth[places + max(0, SHINGLE - 1 - r) :].sum() for r in range(SHINGLE + 1)]
    return 1.0 - float(max(lost[r].max() + tail[r] for r in range(SHINGLE + 1)))


def item_words(items: DataFrame, whole: bool = False) -> DataFrame:
    """key, word, tf, n_words (of the question, or of the whole item if that
    has an answer) and longest (of the item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                question, answer, every = split_item(text)
                words = (every if answer else []) if whole else question
                rows += [(key, w, words.count(w), len(words), len(every)) for w in set(words)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["key", "word", "tf", "n_words", "longest"])

    return items.select("key", "text").mapInArrow(run, "key bigint, word string, tf bigint, n_words bigint, longest bigint")


def impacts(words: DataFrame) -> DataFrame:
    """key, word, impact; the impacts of an item add up to one."""
    sizes = words.groupBy("key").agg(F.first("n_words").alias("n"))
    total = sizes.agg(F.count("*").alias("items"), F.avg("n").alias("mean"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    weighed = words.join(df, "word").crossJoin(F.broadcast(total)).select("key", "word", (idf * saturated).alias("weight"))
    own = weighed.groupBy("key").agg(F.sum("weight").alias("own"))
    return weighed.join(own, "key").select("key", "word", (F.col("weight") / F.col("own")).alias("impact"))


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of the runs, joined."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _shares(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose sizes come to about WORK; a larger row is alone."""
    done = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + WORK, side="right")))
        yield slice(start, end)
        start = end


class Index:
    """Some of the items, ready to be broadcast. ``thresholds`` are by item."""

    def __init__(self, items: list[tuple[int, int, str]], postings: list[tuple[int, str, float]], stride: int, thresholds: list[float] | None = None):
        self.stride = stride
        self.thresholds = np.full(len(items), THRESHOLD) if thresholds is None else np.array(thresholds)
        self.item_ids = [item_id for _, item_id, _ in items]
        self.sets = [tuple(map(shingles, split_item(text))) for _, _, text in items]
        row = {key: k for k, (key, _, _) in enumerate(items)}
        self.items: list[dict[int, float]] = [{} for _ in items]
        self.words = {w: k for k, w in enumerate(sorted({w for _, w, _ in postings}))}
        for key, word, impact in postings:
            self.items[row[key]][self.words[word]] = impact
        item = np.array([row[key] for key, _, _ in postings], np.int64)
        word = np.array([self.words[w] for _, w, _ in postings], np.int64)
        impact = np.array([x for _, _, x in postings]) / self.thresholds[item]
        order = np.lexsort((item, word))
        self.item, self.impact, word = item[order], impact[order], word[order]
        self.blocks = -(-len(items) // BLOCK)
        # A cell is a word's block: where its postings begin, and their greatest impact.
        self.cell, at = np.unique(word * self.blocks + self.item // BLOCK, return_index=True)
        self.cell_ends = np.r_[at, len(word)]
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.cuts = np.searchsorted(self.cell // max(1, self.blocks), np.arange(len(self.words) + 1))
        # Words are set aside in order of their greatest impact, until an item would get too much from them.
        posting_cuts = np.searchsorted(word, np.arange(len(self.words) + 1))
        greatest = np.maximum.reduceat(self.impact, posting_cuts[:-1]) if len(word) else np.zeros(0)
        aside = np.zeros(len(items))
        self.counts = np.ones(len(self.words), bool)
        for w in np.argsort(greatest, kind="stable").tolist():
            mine = slice(posting_cuts[w], posting_cuts[w + 1])
            if (aside[self.item[mine]] + self.impact[mine] > ASIDE).any():
                break
            aside[self.item[mine]] += self.impact[mine]
            self.counts[w] = False
        self.aside = np.zeros(self.blocks)
        np.maximum.at(self.aside, np.arange(len(items)) // BLOCK, aside)
        #: Blocks that passages reached, that were pivots, that were scored, since the index was made.
        self.reached = self.pivots = self.scored = 0

    def passages(self, words: list[list[str]]) -> list[tuple[int, int, int]]:
        """Text, first word and item of all that reach the threshold."""
        lengths = np.array([len(w) for w in words], np.int64)
        strides = np.maximum(1, -(-lengths // self.stride))
        base = np.cumsum(strides) - strides
        text = np.repeat(np.arange(len(words)), strides)
        get = self.words.get
        ids = np.array([x for ws in words for x in map(get, ws, repeat(-1))], np.int64)
        starts = np.cumsum(lengths) - lengths
        stride = np.repeat(base, lengths) + (np.arange(len(ids)) - np.repeat(starts, lengths)) // self.stride
        # A word counts once a passage: a stride and the next one of the same text.
        n = len(self.words)
        cell = np.unique((stride * n + ids)[ids >= 0])
        before = cell[cell // max(1, n) > base[text[cell // max(1, n)]]] - n
        cell = np.union1d(cell, before)
        passage, word = cell // max(1, n), cell % max(1, n)
        out = []
        for p, item in self._retrieved(passage, word):
            out.append((int(text[p]), int(p - base[text[p]]) * self.stride, item))
        return out

    def _retrieved(self, passage: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
        """Passages and items that reach the threshold, from the distinct words
        of each passage, in order."""
        out: list[tuple[int, int]] = []
        row_cuts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1], True]) if len(passage) else np.zeros(1, np.int64)
        looked = np.where(self.counts[word], self.cuts[word + 1] - self.cuts[word], 0)
        sizes = np.add.reduceat(looked, row_cuts[:-1]) if len(passage) else looked
        for part in _shares(sizes):
            at = slice(row_cuts[part.start], row_cuts[part.stop])
            # Postings of the words that count, block by block.
            n = looked[at]
            cells = _runs(self.cuts[word[at]], n)
            key, of = np.unique(np.repeat(passage[at], n) * self.blocks + self.cell[cells] % self.blocks, return_inverse=True)
            bound = np.bincount(of, self.most[cells], len(key)) if len(key) else np.zeros(0)
            self.reached += len(key)
            pivot = key[bound + self.aside[key % self.blocks] >= 1 - _EPS]
            self.pivots += len(pivot)
            if len(pivot):
                out += self._scored(pivot // self.blocks, pivot % self.blocks, passage, word, row_cuts)
        return out

    def _scored(self, asked: np.ndarray, block: np.ndarray, passage: np.ndarray, word: np.ndarray, row_cuts: np.ndarray) -> list[tuple[int, int]]:
        """Items of a block of each passage ``asked`` that reach the threshold."""
        out: list[tuple[int, int]] = []
        row = np.searchsorted(passage[row_cuts[:-1]], asked)
        sizes = row_cuts[row + 1] - row_cuts[row]
        for part in _shares(sizes):
            n = sizes[part]
            pair = np.repeat(np.arange(len(n)), n)
            want = word[_runs(row_cuts[row[part]], n)] * self.blocks + block[part][pair]
            cells = np.minimum(np.searchsorted(self.cell, want), len(self.cell) - 1)
            held = self.cell[cells] == want
            pair, cells = pair[held], cells[held]
            # The greatest impacts of all words: blocks that stay under one are skipped.
            bound = np.bincount(pair, self.most[cells], len(n))
            self.scored += int((bound >= 1 - _EPS).sum())
            held = bound[pair] >= 1 - _EPS
            pair, cells = pair[held], cells[held]
            m = self.cell_ends[cells + 1] - self.cell_ends[cells]
            posting = _runs(self.cell_ends[cells], m)
            score = np.bincount(np.repeat(pair, m) * BLOCK + self.item[posting] % BLOCK, self.impact[posting], len(n) * BLOCK)
            for k in np.flatnonzero(score >= 1 - _EPS).tolist():
                out.append((int(asked[part][k // BLOCK]), int(block[part][k // BLOCK]) * BLOCK + k % BLOCK))
        return out

    def verify(self, words: list[str], first: int, item: int) -> tuple[float, float, float, bool]:
        passage = words[first : first + 2 * self.stride]
        held = set(passage)
        score = sum(self.items[item].get(self.words[w], 0.0) for w in held if w in self.words)
        mine = shingles(passage)
        for size in {len(s.split(" ")) for part in self.sets[item] for s in part} - {SHINGLE}:  # a part of fewer words
            mine |= {" ".join(passage[k : k + size]) for k in range(len(passage) - size + 1)}
        question, answer, whole = (len(s & mine) / len(s) if s else 0.0 for s in self.sets[item])
        return min(1.0, score), question, answer, question >= OVERLAP or whole >= OVERLAP


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, leaked: every
    item that BM25 retrieves for a passage of a document, best passage first."""
    spark = docs.sparkSession
    items = shared(benchmark.where("text is not null").select("item_id", "text").distinct().withColumn("key", 2 * F.monotonically_increasing_id()))
    parts, built = _indexes(items)
    found = spark.createDataFrame([], FOUND)
    for part in range(parts):
        # Bounded: one part, of about POSTINGS postings and their items.
        row = built.where(F.col("part") == part).first()
        if row is None:
            continue
        index = spark.sparkContext.broadcast(pickle.loads(row["index"]))
        mine = _search(docs, index)
        if parts > 1:
            mine = shared(mine)
            index.unpersist()
        found = found.union(mine)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap"), F.struct("question_overlap", "answer_overlap", "score")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.max("leaked").alias("leaked")).select("doc_id", "item_id", "best.*", "leaked")


def _indexes(items: DataFrame) -> tuple[int, DataFrame]:
    """Number of parts; and part and index (pickled), built where the postings
    of the part are. Questions have the even ``key`` of their item, whole items
    the next number."""
    questions = shared(item_words(items))
    wholes = shared(item_words(items, whole=True))
    sizes = questions.union(wholes).agg(F.count("*").alias("postings"), F.max("longest").alias("longest")).first()
    postings = impacts(questions).union(impacts(wholes).withColumn("key", F.col("key") + 1))
    parts = max(1, -(-sizes["postings"] // POSTINGS))
    stride = max(64, sizes["longest"] or 0)
    part = F.pmod(F.xxhash64(F.floor(F.col("key") / 2)), F.lit(parts)).alias("part")

    def build(held: pa.Table, known: pa.Table) -> pa.Table:
        rows = list(zip(*(held.column(c).to_pylist() for c in ("key", "word", "impact")), strict=True))
        impact: dict[int, dict[str, float]] = {}
        for key, word, x in rows:
            impact.setdefault(key, {})[word] = x
        entries, thresholds = [], []
        for key, item_id, text in sorted(zip(*(known.column(c).to_pylist() for c in ("key", "item_id", "text")), strict=True)):
            question, answer, whole = split_item(text)
            for of, words in ((key, question), (key + 1, whole if answer else [])):
                if words:
                    # A passage with a shingle has one word at least.
                    least = max(least_score(words, impact[of]) - 1e-6, min(impact[of].values()) * (1 - 1e-6))
                    entries.append((of, item_id, text))
                    thresholds.append(min(THRESHOLD, least))
        found = [(held if held.num_rows else known).column("part")[0].as_py()] if entries else []
        made = [pickle.dumps(Index(entries, rows, stride, thresholds))] if entries else []
        return pa.table([pa.array(found, pa.int64()), pa.array(made, pa.binary())], names=["part", "index"])

    by_part = postings.select("key", "word", "impact", part).groupBy("part")
    texts_of = items.select("key", "item_id", "text", part).toDF("key", "item_id", "text", "part").groupBy("part")
    return parts, shared(by_part.cogroup(texts_of).applyInArrow(build, "part bigint, index binary"))


def pieces(text: str, stride: int) -> Iterator[list[str]]:
    """The words of a text in runs of at most SLICE strides and the stride that
    follows, so that every passage is whole in one of them."""
    text = text.lower()
    if len(text) <= SLICE * stride:
        yield _words(text)
        return
    words = (m.group() for m in _word.finditer(text))
    held = list(islice(words, (SLICE + 1) * stride))
    while held:
        yield held
        more = list(islice(words, SLICE * stride))
        held = held[SLICE * stride :] + more if more else []


def _search(docs: DataFrame, index) -> DataFrame:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())

    def found(held: Index, ids: list, words: list[list[str]]) -> pa.RecordBatch:
        rows = [(ids[k], held.item_ids[item], *held.verify(words[k], first, item)) for k, first, item in held.passages(words)]
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        ids, words, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces(text, held.stride):
                    ids.append(doc_id)
                    words.append(piece)
                    n += len(piece)
                    if n >= SLICE * 64:
                        yield found(held, ids, words)
                        ids, words, n = [], [], 0
        if ids:
            yield found(held, ids, words)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(releasing(run), FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the documents that hold an item of the benchmark."""
    bad = sized(leaks(docs, benchmark).where("leaked").select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("leaked").drop("leaked")

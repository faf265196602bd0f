"""Operator 10: language identification by partial matching (PPM).

For every learned language a context tree over bytes, of contexts of up to three
bytes, is counted once and then frozen. A byte's probability in a context of
length k is its count there, or, if the context has not had it, the context's
escape probability times the probability in the context one byte shorter; below
the empty context all 256 bytes are equal (method C: of a context with n bytes,
d of them different, a byte seen c times has c / (n + d), and the escape d / (n
+ d)). A text's code length in a language is the sum over its bytes of minus
the logarithm of these, exact for the frozen counts, and the language of the
shortest code is predicted; ties go to the language that sorts first.

The code lengths of all four-byte strings that some language has counted, of
all shorter ones for what it has not, and the escapes to them are worked out
once, so a text is coded by table look-ups over its bytes.

Training: documents with text and language whose crc32 of the doc_id, as text,
modulo 5 is not 0. Of each language about :data:`SAMPLE` documents are counted,
those of a low hash of the id (a documented bound of rows; a language with fewer
is counted whole), each of them whole. Only the text of what is predicted is
looked at, and all of it.

Cases: a null text, and one without a letter, is ``und`` with score 0; a null
language teaches nothing; without training rows everything is ``und``; repeated
rows give repeated results; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import sized, small_batches, table

SAMPLE = 1500
#: Bytes that are counted at a time.
PIECE = 1 << 22
#: Steps in which the share of a language that is sampled is told.
PARTS = 1 << 24
ORDER = 3
FOLDS = 5
UNKNOWN = "und"
PREDICTED = "doc_id bigint, lang_pred string, score double"



def _letter(text: str) -> bool:
    """Numerals such as a superscript two are word characters, but no letters."""
    return any(map(str.isalpha, text))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Each k consecutive bytes as one number, first byte highest."""
    out = np.zeros(max(0, len(codes) - k + 1), np.int64)
    for i in range(k):
        out = out << 8 | codes[i : len(codes) - k + 1 + i]
    return out


def _parts(found: list[tuple[bytes, int]]) -> Iterator[list[tuple[bytes, int]]]:
    """Runs of texts of about PIECE bytes together."""
    part, n = [], 0
    for t, over in found:
        part.append((t, over))
        n += len(t)
        if n >= PIECE:
            yield part
            part, n = [], 0
    if part:
        yield part


def count_grams(train: DataFrame) -> DataFrame:
    """lang, k, gram, n: strings of k = 1 to ORDER + 1 bytes in the texts.
    Counted a batch at a time and added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                # Pieces overlap by a context, so that each string is counted once.
                by.setdefault(lang, []).extend((raw[max(0, at - ORDER) : at + PIECE], min(at, ORDER)) for at in range(0, len(raw), PIECE))
            for lang, found in by.items():
                for part, k in [(p, k) for p in _parts(found) for k in range(1, ORDER + 2)]:
                    gram, n = np.unique(np.concatenate([grams(np.frombuffer(t, np.uint8), k)[max(0, over - k + 1) :] for t, over in part]), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array([k] * len(gram), pa.int32()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])

    return train.select("lang", "text").mapInArrow(run, "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths, in bits, of all languages side by side."""

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.languages = sorted(counts)
        number = len(self.languages)
        #: For strings of 0, 1, ... bytes: the known ones (ascending), and their last byte's code length behind the rest.
        known, bits = [np.zeros(1, np.int64)], [np.full((1, number), 8.0)]
        self.escapes = []
        for k in range(1, ORDER + 2):
            every = np.unique(np.concatenate([counts[x][k][0] for x in self.languages] or [np.zeros(0, np.int64)]))
            context = np.unique(every >> 8)
            # What a byte costs that is known here to some language only.
            shorter = self._shorter(known, bits, every, k)
            escape = np.zeros((len(context), number))
            mine = np.empty((len(every), number))
            for x, lang in enumerate(self.languages):
                gram, n = counts[lang][k]
                of = np.searchsorted(context, gram >> 8)
                total = np.bincount(of, n, len(context))
                different = np.bincount(of, minlength=len(context))
                seen = total > 0
                escape[seen, x] = np.log2((total + different)[seen] / different[seen])
                at = np.searchsorted(context, every >> 8)
                mine[:, x] = shorter[:, x] + escape[at, x]
                mine[np.searchsorted(every, gram), x] = np.log2((total + different)[of] / n)
            known.append(every)
            bits.append(mine)
            self.escapes.append((context, escape))
        self.known, self.bits = known, [b.astype(np.float32) for b in bits]
        self._tables()

    def _shorter(self, known: list, bits: list, every: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last bytes of ``every`` behind k - 2 bytes."""
        if k == 1:
            return np.broadcast_to(bits[0], (len(every), bits[0].shape[1]))
        short = every & ((1 << 8 * (k - 1)) - 1)
        return bits[k - 1][np.searchsorted(known[k - 1], short)]

    def _tables(self) -> None:
        """Each byte gets a class, 0 if no language has it; three bytes find
        their number in one table, and with a fourth the row of costs."""
        singles = self.known[1]
        self.byte_class = np.zeros(256, np.int64)
        self.byte_class[singles] = np.arange(1, len(singles) + 1)
        self.classes = c = len(singles) + 1
        by = lambda g, k: sum(self.byte_class[g >> 8 * i & 255] * c**i for i in range(k))
        three = np.union1d(self.known[3], self.known[4] >> 8)
        self.three = np.full(c**3, -1, np.int32)
        self.three[by(three, 3)] = np.arange(len(three))
        rows = np.searchsorted(three, self.known[4] >> 8) * c + self.byte_class[self.known[4] & 255]
        self.four = np.full(len(three) * c + 1, -1, np.int32)
        self.four[rows] = np.arange(len(rows))

    def _known_row(self, k: int, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known[k], gram), max(0, len(self.known[k]) - 1))
        return np.where(self.known[k][at] == gram, at, -1) if len(self.known[k]) else np.full(len(gram), -1)

    def _slow(self, k: int, gram: np.ndarray) -> np.ndarray:
        """Costs of any strings of k bytes, by falling back where unknown."""
        if k == 0:
            return np.full((len(gram), len(self.languages)), 8.0, np.float32)
        row = self._known_row(k, gram)
        out = self.bits[k][row] if len(self.bits[k]) else np.zeros((len(gram), len(self.languages)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            context, escape = self.escapes[k - 1]
            cost = self._slow(k - 1, gram[new] & ((1 << 8 * (k - 1)) - 1))
            if len(context):
                at = np.minimum(np.searchsorted(context, gram[new] >> 8), len(context) - 1)
                cost = cost + np.where((context[at] == gram[new] >> 8)[:, None], escape[at], 0).astype(np.float32)
            out = out.copy()
            out[new] = cost
        return out

    def code_lengths(self, found: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        sizes = np.array([len(t) for t in found], np.int64)
        out = np.zeros((len(found), len(self.languages)))
        data = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum(sizes)
        code = self.byte_class[data].astype(np.int32)
        c = self.classes
        three = self.three[(code[:-2] * c + code[1:-1]) * c + code[2:]] if len(data) > 3 else np.zeros(0, np.int32)
        row = np.where(three[:-1] >= 0, self.four[three[:-1] * np.int32(c) + code[3:]], -1) if len(data) > 3 else three
        # Bytes without three before them in their text have shorter contexts.
        inside = np.ones(len(row), bool)
        for back in (1, 2, 3):
            cut = ends[:-1] - back
            inside[cut[(cut >= 0) & (cut < len(row))]] = False
        text = np.repeat(np.arange(len(found)), sizes)
        quick = np.flatnonzero(inside & (row >= 0))
        of = text[quick]
        for x in range(len(self.languages)):
            out[:, x] = np.bincount(of, self.bits[4][row[quick], x], len(found))
        slow = np.flatnonzero(inside & (row < 0))
        if len(slow):
            gram = (data[slow].astype(np.int64) << 24) | (data[slow + 1].astype(np.int64) << 16) | (data[slow + 2].astype(np.int64) << 8) | data[slow + 3]
            np.add.at(out, text[slow], self._slow(4, gram))
        for k, t in enumerate(found):
            for n in range(1, min(ORDER, len(t)) + 1):
                out[k] += self._start(t[:n])
        return out

    def _start(self, head: bytes) -> np.ndarray:
        if head not in self.starts:
            if len(self.starts) > 50_000:
                self.starts.clear()
            self.starts[head] = self._slow(len(head), np.array([int.from_bytes(head, "big")]))[0]
        return self.starts[head]

    @property
    def starts(self) -> dict[bytes, np.ndarray]:
        return self.__dict__.setdefault("_starts", {})


def training_rows(docs: DataFrame) -> DataFrame:
    """lang, text of about SAMPLE rows of each language that has as many."""
    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A share of each language's ids, by hash; nothing is sorted or gathered.
    shares = sized(rows.groupBy("lang").agg((F.lit(SAMPLE * PARTS) / F.count("*")).alias("_share")))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    return rows.select("lang", "doc_id", "text").join(shares, "lang").where(h < F.col("_share")).select("lang", "text")


def learn(train: DataFrame) -> Model:
    """The counts of a bounded sample come to the driver: at most one for each
    four bytes of it, in practice a few hundred thousand (1.7 million rows before
    they are added up over the batches of the largest check table)."""
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    found = count_grams(train).toArrow().to_pandas()
    for (lang, k), part in found.groupby(["lang", "k"]):
        part = part.sort_values("gram")
        counts.setdefault(lang, {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(1, ORDER + 2)})[int(k)] = (part["gram"].to_numpy(), part["n"].to_numpy())
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the winner's share against the runner-up, by
    mean code length a byte) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared_model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                found = batch.column(1).slice(start, 200).to_pylist()
                raw = [t.encode("utf-8", "replace") if t is not None and _letter(t) else b"" for t in found]
                bits = held.code_lengths(raw)
                langs, scores = [], []
                for t, mine in zip(raw, bits, strict=True):
                    if not t or not held.languages:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(mine.argmin())
                    rest = np.delete(mine, best)
                    langs.append(held.languages[best])
                    scores.append(float(1 / (1 + 2 ** -min(60.0, (rest.min() - mine[best]) / len(t) * 8))) if len(rest) else 1.0)
                yield pa.record_batch([batch.column(0).slice(start, 200), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PREDICTED)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(training_rows(docs)))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

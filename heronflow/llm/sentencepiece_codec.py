"""Operator 1: SentencePiece encoding and decoding.

Merge-type vocabularies are encoded with an agenda: every adjacent pair of
symbols that forms a piece waits in a heap by (score, position); the best pair
is merged, and the pairs it makes with its neighbours join the agenda.

No piece of such a vocabulary has a word mark after another character, so a
merge never crosses the start of a word; nor does one cross a line break, which
no longer piece contains. (Both are tested when a vocabulary is loaded; texts
of vocabularies that break the rule are encoded in one go.) Words are therefore
encoded on their own and remembered, in a table of bounded size. In each Arrow
batch all words that the agenda has met for the first time are encoded by the
sentencepiece library too, and a difference raises an error.

Cases: a null or empty text has no ids but begin and end; repeated rows give
repeated results; a text without blanks is one word, whose merging takes
O(n log n); extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronflow.llm.common import releasing, small_batches, table, texts, without

MARK = "▁"
#: A Python worker remembers up to twice as many words, about 70 MB, none of
#: more than so many characters: longer ones are encoded where they stand.
WORDS_KEPT, LONGEST_KEPT = 200_000, 200
#: Up to this length words are merged side by side, one merge each a round.
SHORT = 32
ENCODED = "n_tokens bigint, ids binary, decoded string"


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Merge adjacent symbols, best score first, then leftmost."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in score:
            agenda.append((-score[pair], i, pair))
    heapify(agenda)
    while agenda:
        _, i, pair = heappop(agenda)
        j = after[i]
        # Either side may have been merged since the pair joined the agenda.
        if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = pair, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            wider = pair + symbols[k]
            if wider in score:
                heappush(agenda, (-score[wider], i, wider))
        h = before[i]
        if h >= 0:
            wider = symbols[h] + pair
            if wider in score:
                heappush(agenda, (-score[wider], h, wider))
    return [s for s in symbols if s]


class Codec:
    """A merge-type vocabulary, read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        self.id = {p: i for i, p in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        raw = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        if len(raw) < 256:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        self.raw = [raw[b] for b in range(256)]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.by_line = not any("\n" in p for p in self.id)
        self.line_end = self._bytes(self._ids("\n"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._pairs()

    def _pairs(self) -> None:
        """Arrays for merging side by side: which pairs form which piece."""
        pairs = {(self.id[p[:k]], self.id[p[k:]]): i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        key = np.array([a << 32 | b for a, b in pairs] + [2**62], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_piece = key[order], np.array([*pairs.values(), 0], np.int32)[order]
        # Rank 0 is the best score; pieces of one score share a rank.
        scores = sorted(set(self.score.values()), reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.none = len(scores)
        self.rank = np.full(max(self.id.values()) + 1, self.none, np.int32)
        self.rank[list(self.id.values())] = [rank[self.score[p]] for p in self.id]
        self.char = np.full(0x110000, -1, np.int32)
        single = [(ord(p), i) for p, i in self.id.items() if len(p) == 1]
        self.char[[c for c, _ in single]] = [i for _, i in single]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank ``none`` if it forms no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_key, key)
        piece = self.pair_piece[at]
        return piece, np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.rank[piece], self.none)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in merged(list(chunk), self.score):
            if piece in self.id:
                out.append(self.id[piece])
            else:
                out += [self.raw[b] for b in piece.encode("utf-8", "replace")]
        return out

    def _side_by_side(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to ``width`` characters, -1 where none is; and
        which words hold a character that is no piece."""
        n = len(words)
        points = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), "<u4").reshape(n, width)
        symbol = np.full((n, width + 2), -1, np.int32)  # a column of none on either side
        symbol[:, 1:-1] = np.where(points > 0, self.char[points], -1)
        odd = ((symbol[:, 1:-1] < 0) & (points > 0)).any(axis=1)
        column = np.arange(width + 2, dtype=np.int32)
        after = np.tile(np.minimum(column + 1, width + 1), (n, 1))
        before = np.tile(np.maximum(column - 1, 0), (n, 1))
        piece, agenda = self._pair(symbol[:, :-1], symbol[:, 1:])
        piece, agenda = piece.copy(), agenda.astype(np.int32)
        row = np.arange(n)
        while len(row):
            i = agenda[row].argmin(axis=1)
            best = agenda[row, i]
            row, i = row[best < self.none], i[best < self.none]
            if not len(row):
                break
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            new = piece[row, i]
            symbol[row, i], symbol[row, j] = new, -1
            after[row, i] = k
            before[row, k] = i
            agenda[row, np.minimum(j, width)] = self.none
            piece[row, i], agenda[row, i] = self._pair(new, symbol[row, k])
            piece[row, h], agenda[row, h] = self._pair(symbol[row, h], new)
        return symbol, odd

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, and compare with the library."""
        words.sort(key=len)
        start = 0
        while start < len(words) and len(words[start]) <= SHORT:
            width = (len(words[start]) + 3) // 4 * 4
            end = bisect_right(words, width, lo=start, hi=min(len(words), start + 20_000), key=len)
            part = words[start:end]
            symbol, odd = self._side_by_side(part, width)
            kept = symbol >= 0
            flat, at = symbol[kept].astype("<u4").tobytes(), 0
            for word, stop in zip(part, (np.cumsum(kept.sum(axis=1)) * 4).tolist(), strict=True):
                self.known[word] = flat[at:stop]
                at = stop
            # A NUL looks like padding there.
            for word in {part[k] for k in np.flatnonzero(odd).tolist()} | ({w for w in part if "\0" in w} if "\0" in "".join(part) else set()):
                self.known[word] = self._bytes(self._ids(word))
            start = end
        for word in words[start:]:
            self.known[word] = self._bytes(self._ids(word))
        self.check(words)

    def check(self, words: list[str]) -> None:
        """Compare with the ids that the library gives. Behind a line break it
        adds no word mark of its own, so one text holds many words."""
        if self.by_line:
            asked = "".join(["\n" + w.replace(MARK, " ") for w in words])
            ours = b"".join([self.line_end + self.known[w] for w in words])
            if self._bytes(self.library.encode(asked)[1:]) == ours:
                return
        for word in words:
            self._alone(word)

    def _alone(self, word: str) -> None:
        theirs = self.library.encode(word[1:].replace(MARK, " ")) if word[:1] == MARK and word != MARK else self.library.encode("\n" + word)[2:]
        if self._bytes(theirs) != self.known[word]:
            raise ValueError(f"the agenda and the library differ on {word[:80]!r}")

    def words(self, text: str) -> list[list[str]]:
        """The lines of a text, each as words with their word marks."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not (self.by_word and self.by_line):
            return [[marked]]
        return [re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line) for line in marked.split("\n")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        new: set[str] = set()
        for lines in split:
            new.update(*lines)
        new.difference_update(self.known)
        if len(self.known) > WORDS_KEPT:
            # Start anew; words that are met again are taken from the old table.
            self.older, self.known = self.known, {}
            new = {w for lines in split for line in lines for w in line}
        for word in new & self.older.keys():
            self.known[word] = self.older[word]
            new.remove(word)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        out = [self.line_end.join([b"".join(map(get, line)) for line in lines]) for lines in split]
        for word in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.known[word]
        return out

    def forget(self) -> None:
        """Give the words' memory back; the worker may go on with other work."""
        self.known, self.older = {}, {}

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit, with begin
    and end), decoded (the text that the ids stand for); with ``carry`` behind
    all columns of ``docs`` as they are. Narrow: no shuffle."""
    small_batches(docs.sparkSession)
    rows = without(docs, "n_tokens", "ids", "decoded") if carry else texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kept = len(rows.columns) if carry else 1
    at = rows.columns.index("text")
    schema = StructType([*rows.schema.fields[:kept], *StructType.fromDDL(ENCODED).fields])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        begin, end = (x.to_bytes(4, "little") for x in (model.begin, model.end))
        for batch in batches:
            # A few documents at a time: their ids are larger than their text.
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [begin + x + end for x in model.encode([t or "" for t in part.column(at).to_pylist()])]
                found = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())]
                yield pa.record_batch([*part.columns[:kept], *found], names=schema.names)
        model.forget()

    return rows.mapInArrow(releasing(encoded), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids and decoded text."""
    import public_tokenizers

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

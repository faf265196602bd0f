"""Operator 7: substring dedup with a count-min prefilter.

A window is 35 consecutive words of one document; a word goes if a window that
covers it has a word sequence that starts anywhere else, in the same document
too. Judged on the input.

First pass: each block of documents makes its part of a count-min sketch of
:data:`ROWS` rows, over the minimizers of its windows
(:mod:`heronflow.llm.blocks`), which occur at least as often as any window they
stand for. The sketch's width is fixed before by the size of the corpus, some
four cells a minimizer and row. The parts, of which only the cells that are not
zero travel, are added cell by cell, and a window whose cells all come to two or
more may be repeated: the estimate is never too low, so none is lost. Second
pass: only these windows are grouped, by 128 bits, and those in groups of two or
more are repeated. Each word has two independent 64-bit hashes (the halves of
XXH3-128), and each half of a window's 128 bits is a polynomial over one of
them, so words that collide in one half do not in the other. Cells and hashes
are spread over shards whose number grows with the corpus; of a window that many
documents share a shard gets 16 bytes a block that has it.

Cases: null or empty texts, and those of under 35 words, lose nothing; repeated
rows repeat each other's windows; rows without an id take part like others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm import blocks as B
from heronflow.llm.common import table

WINDOW, GRAM, ROWS = 35, 18, 2
#: Bits of a cell beyond those that number the minimizers.
SPARE_BITS = 2
#: Multipliers of the two halves of a window's hash (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
EXACT = "block bigint, step int, shard bigint, low binary, high binary"
EXACT_ARROW = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


class Block:
    """The words of a block's documents and the runs of windows among them."""

    def __init__(self, rows: pa.Table):
        from xxhash import xxh3_128_digest

        self.number, self.ids, found, _ = B.rows_of(rows)
        self.words = [t.split() for t in found]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        halves = np.frombuffer(b"".join([xxh3_128_digest(w) for ws in self.words for w in ws]), ">u8").reshape(-1, 2)
        self.hashes, self.others = halves[:, 0].astype(np.uint64), halves[:, 1].astype(np.uint64)
        self.first, self.count, self.place, self.key = B.minimizers(self.hashes, GRAM, WINDOW, B.window_starts(self.lengths, WINDOW))

    def cells(self, sizes: B.Sizes, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of a sketch row, which occur twice, and each run's."""
        mine = sizes.cells(self.key, row)
        distinct, of = np.unique(mine, return_inverse=True)
        # A minimizer that several runs share is one occurrence.
        once = of[np.r_[True, self.place[1:] != self.place[:-1]]] if len(of) else of
        return distinct, np.bincount(once, minlength=len(distinct)) > 1, of

    def maybe(self, sizes: B.Sizes, flags: pa.Table) -> np.ndarray:
        """Starts of the windows that the sketch estimates repeated."""
        hot = np.ones(len(self.key), bool)
        for row in range(ROWS):
            distinct, _, of = self.cells(sizes, row)
            hot &= B.cell_bits(sizes, distinct, B.answers(flags, row))[of]
        return B.ranges(self.first[hot], self.count[hot])

    def exact(self, starts: np.ndarray, sizes: B.Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes, in order of shards; shard and number of
        windows of each; and which each window has."""
        low, high = (B.gram_hashes(h, WINDOW, base)[starts] if len(starts) else np.zeros(0, np.uint64) for h, base in zip((self.hashes, self.others), BASES, strict=True))
        shard = low % np.uint64(sizes.exact_shards)
        order = np.lexsort((high, low, shard))
        pairs = np.stack([low, high, shard])[:, order]
        new = np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)] if len(starts) else np.zeros(0, bool)
        of = np.empty(len(starts), np.int64)
        of[order] = np.cumsum(new) - 1
        return pairs[:, new], np.bincount(of, minlength=int(new.sum())), of, shard


def repeated_windows(mine: dict[str, list]) -> list[bytes]:
    low = [np.frombuffer(x, np.uint64) for x in mine["low"]]
    sizes = [len(x) for x in low]
    joined, high = np.concatenate(low), np.concatenate([np.frombuffer(x, np.uint64) for x in mine["high"]])
    order = np.lexsort((high, joined))
    same = (joined[order][1:] == joined[order][:-1]) & (high[order][1:] == high[order][:-1])
    hot = np.zeros(len(joined), bool)
    hot[1:] |= same
    hot[:-1] |= same
    out = np.zeros(len(joined), bool)
    out[order] = hot
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def drop_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one
    blank) of every row of ``docs``."""
    sizes = B.sized(docs, 0.02, 4 << 20, SPARE_BITS)
    dealt = B.in_blocks(docs, sizes)

    def sketch(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        out = []
        for row in range(ROWS):
            cells, many, _ = block.cells(sizes, row)
            out += B.cell_rows(block.number, sizes, row, cells, many)
        return B.table_of(out, B.CELLS_ARROW)

    def candidates(rows: pa.Table, flags: pa.Table) -> pa.Table:
        block = Block(rows)
        pairs, _, _, _ = block.exact(block.maybe(sizes, flags), sizes)
        shards, at = np.unique(pairs[2], return_index=True)
        ends = np.r_[at[1:], pairs.shape[1]]
        out = [(block.number, ROWS, int(s), pairs[0, a:b].tobytes(), pairs[1, a:b].tobytes()) for s, a, b in zip(shards, at, ends, strict=False)]
        return B.table_of(out, EXACT_ARROW)

    def result(rows: pa.Table, flags: pa.Table) -> pa.Table:
        block = Block(rows)
        starts = block.maybe(sizes, flags)
        pairs, count, of, _ = block.exact(starts, sizes)
        shards, at = np.unique(pairs[2], return_index=True)
        ends = np.r_[at[1:], pairs.shape[1]]
        found = B.answers(flags, ROWS)
        bits = [np.unpackbits(np.frombuffer(found[int(s)], np.uint8), count=int(b - a)) for s, a, b in zip(shards, at, ends, strict=False)]
        hot = (np.concatenate(bits).astype(bool) | (count > 1))[of] if bits else np.zeros(0, bool)
        removed = covered(starts[hot], WINDOW, len(block.hashes))
        n_removed, kept, start = [], [], 0
        for words in block.words:
            gone = removed[start : start + len(words)]
            start += len(words)
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if n_removed[-1] else words).decode("utf-8", "replace"))
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(block.lengths), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    estimated = B.answered(dealt.groupBy("block").applyInArrow(sketch, B.CELLS), sizes.shards * ROWS, B.merged_sketch(sizes))
    sent = dealt.groupBy("block").cogroup(estimated.groupBy("block")).applyInArrow(candidates, EXACT)
    grouped = B.answered(sent, sizes.exact_shards, repeated_windows)
    return dealt.groupBy("block").cogroup(estimated.union(grouped).groupBy("block")).applyInArrow(result, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that begins at ``starts``."""
    seen = np.zeros(n, np.int32)
    seen[starts] = 1
    np.cumsum(seen, out=seen)
    before = seen[: max(0, n - window)].copy()
    seen[window:] -= before
    return seen > 0


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

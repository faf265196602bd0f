"""Operator 4: suffix-array dedup of 50-byte strings.

Documents are their UTF-8 bytes. A byte goes if it is covered by a 50-byte
string that also starts in a document with a smaller ``doc_id``; matches never
cross documents and are judged on the input.

1. Each block of documents sends the cells of its windows' minimizers to shards
   (:mod:`heronflow.llm.blocks`), which answer which of them are in two
   documents or more. Windows of other minimizers are in one document only.
2. The rest of the windows come in runs about one minimizer, the anchor. The
   bytes of a run go to the shard of its anchor's gram, once for each block that
   has them, with the least doc_id there. A shard sorts the suffixes that start
   at the anchors of one gram, and the reversed prefixes that end there, by
   mergesort: two suffixes are compared by their longest common extension, found
   by binary search over prefix polynomial hashes. All merges of a level are
   done at once. Neighbours in both orders with common extensions of r bytes to
   the right and 50 - r to the left hold the same string; the least doc_id among
   them says who keeps it. What the hashes call equal is compared byte by byte,
   and a collision makes the shard sort the bytes themselves.
3. A bit for each window goes back to the block, which cuts the bytes out.

A run that thousands of documents share arrives once a block, and shards see
distinct runs only, so groups of copies do not grow the sort. A gram that more
than :data:`HOT_BLOCKS` blocks have is hot: it may stand in as many different
surroundings, too many for one shard. Its windows are sent one by one, to the
shard of their whole string; equal ones still meet, and only they.

Cases: null and empty texts and those of under 50 bytes lose nothing; rows of
one doc_id never take bytes from each other; rows without an id are left as
they are and take nothing; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from heronflow.llm import blocks as B
from heronflow.llm.common import fresh, released, table
from heronflow.llm.substring_dedup import covered

WINDOW, GRAM = 50, 24
#: One gram in 4096 meets another by chance.
SPARE_BITS = 12
HOT_BLOCKS = 1_000
#: Bytes of runs that are sorted together, unless they share a gram.
PART_BYTES = 1 << 20
RUNS = "block bigint, step int, shard bigint, docs binary, anchors binary, lengths binary, data binary"
RUNS_ARROW = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), *((n, pa.binary()) for n in ("docs", "anchors", "lengths", "data"))])
#: A random number for each byte, so that texts of few letters hash well.
_BYTE = B.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POLY = 0x5851F42D4C957F2D


class Prefixes:
    """Prefix polynomial hashes of a buffer, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.power = np.full(n + 1, _POLY, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.take(_BYTE, data, out=self.sums[1:], mode="clip")
        self.sums[1:] *= self.power[:n]
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the n bytes from start, whatever start is."""
        return (self.sums[start + n] - self.sums[start]) * self.power[len(self.data) - start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from a and b, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.of(a[open_], middle) == self.of(b[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1


def suffix_order(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, verified: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Order of data[start : start + length] within each group, groups
    ascending, and the common extension of each with the one before it (-1 at
    the first of a group)."""
    hashes = Prefixes(data)

    def before(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """If suffix a sorts before b; ``equal``: the answer if they are equal."""
        common = hashes.common(start[a], start[b], np.minimum(length[a], length[b]))
        ends_a, ends_b = common == length[a], common == length[b]
        # One past the end is never read: ties are settled first.
        x = data[np.minimum(start[a] + common, len(data) - 1)]
        y = data[np.minimum(start[b] + common, len(data) - 1)]
        return np.where(ends_a & ends_b, equal, ends_a | ~ends_b & (x < y))

    order = np.argsort(group, kind="stable")
    ordered = group[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(order)])
    first, own = np.repeat(head, size), np.repeat(size, size)
    place = np.arange(len(order)) - first
    run = 1
    while run < int(size.max(initial=0)):
        # Each element moves by as many of the other run as sort before it.
        at = np.flatnonzero(own > run)
        pair = place[at] // (2 * run) * (2 * run)
        left = place[at] - pair < run
        other = first[at] + pair + np.where(left, run, 0)
        end = first[at] + np.minimum(own[at], pair + np.where(left, 2 * run, run))
        low, high = other.copy(), np.maximum(other, end)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            # Of equal ones those of the left run come first.
            less = before(order[middle], order[at[open_]], ~left[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        within = place[at] - pair - np.where(left, 0, run)
        target = first[at] + pair + within + low - other
        order[target] = order[at].copy()
        run *= 2
    common = np.full(len(order), -1, np.int64)
    mates = np.flatnonzero(place > 0)
    a, b = order[mates - 1], order[mates]
    common[mates] = hashes.common(start[a], start[b], np.minimum(length[a], length[b]))
    if verified:
        for part in np.array_split(mates, 1 + len(mates) // 20_000):
            n = common[part]
            x, y = B.ranges(start[order[part - 1]], n), B.ranges(start[order[part]], n)
            if (data[x] != data[y]).any():
                return _order_of_bytes(data, start, length, group)
    return order, common


def _order_of_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes, for data in which hashes collide."""
    raw = data.tobytes()
    suffix = [raw[s : s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    order = np.array(sorted(range(len(suffix)), key=lambda k: (group[k], suffix[k])), np.int64)
    common = np.full(len(order), -1, np.int64)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            common[k] = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return order, common


def least_documents(runs: list[bytes], anchor: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For each run of bytes with an anchor, and each of its windows: the least
    of ``doc`` that has the window's string."""
    number: dict[tuple, int] = {}
    of = np.array([number.setdefault(k, len(number)) for k in zip(runs, anchor.tolist(), strict=True)], np.int64)
    distinct = list(number)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    size = np.array([len(r) for r, _ in distinct], np.int64)
    at = np.array([a for _, a in distinct], np.int64)
    windows = size - WINDOW + 1
    begin = np.cumsum(windows) - windows
    best = np.repeat(least, windows)

    grams: dict[bytes, int] = {}
    group = np.array([grams.setdefault(r[a : a + GRAM], len(grams)) for r, a in distinct], np.int64)
    some = np.flatnonzero(np.bincount(group, minlength=len(grams))[group] > 1)
    if len(some):
        data = np.frombuffer(b"".join([distinct[k][0] for k in some]), np.uint8)
        n, a, doc_of = size[some], at[some], least[some]
        base = np.cumsum(n) - n
        right, right_common = suffix_order(data, base + a, n - a, group[some])
        left, left_common = suffix_order(data[::-1].copy(), len(data) - base - a, a, group[some])
        for back in range(int(a.max()) + 1):
            ahead = WINDOW - back
            right_class, left_class = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
            right_class[right] = np.cumsum(right_common < ahead)
            left_class[left] = np.cumsum(left_common < back)
            held = np.flatnonzero((back <= a) & (ahead <= n - a))
            if not len(held):
                continue
            key = right_class[held] * (len(some) + 1) + left_class[held]
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            low = np.minimum.reduceat(doc_of[held[order]], start)
            best[begin[some[held[order]]] + a[held[order]] - back] = np.repeat(low, np.diff(np.r_[start, len(order)]))
    parts = np.split(best, np.cumsum(windows)[:-1]) if len(windows) else []
    return [parts[k] for k in of.tolist()]


def by_parts(runs: list[bytes], anchor: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """:func:`least_documents`, over runs of about :data:`PART_BYTES` at a time;
    those that have one gram at their anchors are in one part."""
    parts = 1 + sum(map(len, runs)) // PART_BYTES
    if parts == 1:
        return least_documents(runs, anchor, doc)
    part = np.array([hash(r[a : a + GRAM]) % parts for r, a in zip(runs, anchor.tolist(), strict=True)], np.int64)
    out: list[np.ndarray] = [doc] * len(runs)
    for p in range(parts):
        at = np.flatnonzero(part == p)
        for k, found in zip(at.tolist(), least_documents([runs[k] for k in at], anchor[at], doc[at]), strict=True):
            out[k] = found
    return out


def taken_windows(mine: dict[str, list]) -> list[bytes]:
    """A bit for each window of each run: a document before its own has it."""
    docs = [np.frombuffer(x, "<i8") for x in mine["docs"]]
    anchors = [np.frombuffer(x, np.uint8) for x in mine["anchors"]]
    runs: list[bytes] = []
    for lengths, data in zip(mine["lengths"], mine["data"], strict=True):
        at = 0
        for n in np.frombuffer(lengths, "<u4").tolist():
            runs.append(data[at : at + n])
            at += n
    least = by_parts(runs, np.concatenate(anchors), np.concatenate(docs))
    out, k = [], 0
    for d in docs:
        out.append(np.packbits(np.concatenate([least[k + i] < x for i, x in enumerate(d)])).tobytes())
        k += len(d)
    return out


def repeated_and_hot(most: int) -> Callable[[dict[str, list]], list[bytes]]:
    """The bits of :func:`B.repeated_cells`, and behind them a bit for each
    cell that more than ``most`` blocks have."""

    def answer(mine: dict[str, list]) -> list[bytes]:
        return [a + b for a, b in zip(*B.repeated_cells(mine, most), strict=True)]

    return answer


class Block:
    """The bytes of a block's documents and the runs of windows among them."""

    def __init__(self, rows: pa.Table):
        self.number, self.ids, self.texts, self.rows = B.rows_of(rows)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        ok = B.window_starts(self.lengths, WINDOW)
        # Rows without an id come last.
        ok[sum(n for n, k in zip(self.lengths.tolist(), self.ids, strict=True) if k is not None) :] = False
        self.first, self.count, self.place, self.key = B.minimizers(self.data, GRAM, WINDOW, ok, by=_BYTE)
        row = np.searchsorted(np.cumsum(self.lengths), self.first, side="right")
        self.doc = np.array([k or 0 for k in self.ids], np.int64)[row] if len(self.ids) else row

    def cells(self, sizes: B.Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells, which are in two documents, and each run's."""
        distinct, of = np.unique(sizes.cells(self.key), return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, of, self.doc)
        np.maximum.at(high, of, self.doc)
        return distinct, low != high, of

    def candidates(self, sizes: B.Sizes, flags: pa.Table) -> None:
        """Runs whose anchor is in two documents; equal ones are one, with the
        least doc_id, which comes first: documents are in order."""
        from xxhash import xxh3_64_intdigest

        distinct, _, of = self.cells(sizes)
        found = B.answers(flags, 0)
        half = {s: len(bits) // 2 for s, bits in found.items()}
        kept = B.cell_bits(sizes, distinct, {s: bits[: half[s]] for s, bits in found.items()})[of]
        hot = B.cell_bits(sizes, distinct, {s: bits[half[s] :] for s, bits in found.items()})[of]
        # The windows of a hot gram are runs of their own.
        alone = np.flatnonzero(kept & hot)
        self._split(np.flatnonzero(kept & ~hot), alone)
        first, size = self.run_first, self.run_count + WINDOW - 1
        raw = self.data.tobytes()
        anchor = self.run_place - first
        number: dict[tuple, int] = {}
        self.of = np.array([number.setdefault((raw[s : s + n], a), len(number)) for s, n, a in zip(first.tolist(), size.tolist(), anchor.tolist(), strict=True)], np.int64)
        self.runs = list(number)
        # Where each distinct run occurs first.
        seen = np.unique(self.of, return_index=True)[1] if len(self.of) else self.of
        self.least = self.run_doc[seen]
        spread = B.mixed(self.run_key[seen])
        for k in np.flatnonzero(self.run_alone[seen]).tolist():
            spread[k] = xxh3_64_intdigest(self.runs[k][0])
        shard = (spread % np.uint64(sizes.exact_shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.shards, self.at = np.unique(shard[self.order], return_index=True)
        self.ends = np.r_[self.at[1:], len(self.order)]

    def _split(self, whole: np.ndarray, alone: np.ndarray) -> None:
        """Runs as they are, and each window of others, in order of place."""
        n = self.count[alone]
        first = np.r_[self.first[whole], B.ranges(self.first[alone], n)]
        order = np.argsort(first, kind="stable")
        join = lambda x: np.r_[x[whole], np.repeat(x[alone], n)][order]
        self.run_first, self.run_place, self.run_key, self.run_doc = first[order], join(self.place), join(self.key), join(self.doc)
        self.run_count = np.r_[self.count[whole], np.ones(int(n.sum()), np.int64)][order]
        self.run_alone = np.r_[np.zeros(len(whole), bool), np.ones(int(n.sum()), bool)][order]

    def run_rows(self) -> list[tuple]:
        out = []
        for s, a, b in zip(self.shards.tolist(), self.at.tolist(), self.ends.tolist(), strict=False):
            mine = self.order[a:b]
            runs = [self.runs[k] for k in mine.tolist()]
            lengths = np.array([len(r) for r, _ in runs], "<u4").tobytes()
            out.append((self.number, 1, s, self.least[mine].astype("<i8").tobytes(), bytes([x for _, x in runs]), lengths, b"".join([r for r, _ in runs])))
        return out

    def removed(self, flags: pa.Table) -> np.ndarray:
        """Which bytes go."""
        windows = np.array([len(r) - WINDOW + 1 for r, _ in self.runs], np.int64)
        begin = np.cumsum(windows) - windows
        taken = np.zeros(int(windows.sum()), bool)
        found = B.answers(flags, 1)
        for s, a, b in zip(self.shards.tolist(), self.at.tolist(), self.ends.tolist(), strict=False):
            mine = self.order[a:b]
            taken[B.ranges(begin[mine], windows[mine])] = np.unpackbits(np.frombuffer(found[s], np.uint8), count=int(windows[mine].sum()))
        if not len(self.of):
            return np.zeros(len(self.data), bool)
        count = self.run_count
        gone = taken[B.ranges(begin[self.of], count)] | np.repeat(self.least[self.of] < self.run_doc, count)
        return covered(B.ranges(self.run_first, count)[gone], WINDOW, len(self.data))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def drop_repeated(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the
    bytes that stay) of every row of ``docs``. With the columns ``carry`` instead
    of kept: rest, a struct of these, and kept_text, in which a character that
    loses some of its bytes stays whole."""
    sizes = B.sized(docs, 0.08, 4 << 20, SPARE_BITS)
    dealt = B.in_blocks(docs, sizes, carry)
    schema = StructType.fromDDL(RESULT)
    if carry is not None:
        schema = StructType([*schema.fields[:-1], *dealt.select("rest").schema.fields, StructField("kept_text", StringType())])

    def send_cells(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        cells, many, _ = block.cells(sizes)
        return B.table_of(B.cell_rows(block.number, sizes, 0, cells, many), B.CELLS_ARROW)

    def send_runs(rows: pa.Table, flags: pa.Table) -> pa.Table:
        block = Block(rows)
        block.candidates(sizes, flags)
        return B.table_of(block.run_rows(), RUNS_ARROW)

    def result(rows: pa.Table, flags: pa.Table) -> pa.Table:
        block = Block(rows)
        block.candidates(sizes, flags)
        gone = block.removed(flags)
        removed, spans, kept = [], [], []
        start = 0
        for text in block.texts:
            mine = gone[start : start + len(text)]
            start += len(text)
            n = int(mine.sum())
            removed.append(n)
            spans.append(int((mine[1:] & ~mine[:-1]).sum()) + int(mine[:1].sum()))
            raw = np.frombuffer(text, np.uint8)
            kept.append(_whole(raw, mine) if carry is not None else raw[~mine].tobytes() if n else text)
        found = [pa.array(block.ids, pa.int64()), pa.array(block.lengths), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        if carry is not None:
            found.append(rows.column("rest").take(pa.array(block.rows, pa.int64())))
        return pa.table([*found, pa.array(kept, pa.binary() if carry is None else pa.string())], names=schema.names)

    repeated = B.answered(dealt.groupBy("block").applyInArrow(lambda rows: released(send_cells(rows)), B.CELLS), sizes.shards, repeated_and_hot(HOT_BLOCKS))
    runs = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda rows, flags: released(send_runs(rows, flags)), RUNS)
    taken = B.answered(runs, sizes.exact_shards, taken_windows)
    return dealt.groupBy("block").cogroup(repeated.union(taken).groupBy("block")).applyInArrow(lambda rows, flags: released(result(rows, flags)), schema)


def _whole(raw: np.ndarray, gone: np.ndarray) -> str:
    """The text that stays if a character goes only with all of its bytes."""
    if not gone.any():
        return raw.tobytes().decode("utf-8", "replace")
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, head)
    return raw[~np.repeat(whole, np.diff(np.r_[head, len(raw)]))].tobytes().decode("utf-8", "replace")


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with text less what is repeated, whole characters only, and
    n_chars to match. Documents that lose all their text are left out; rows
    without an id, and those that lose nothing, stay as they are."""
    others = [c for c in docs.columns if c.lower() != "text"]
    null = fresh(docs, "_null")
    cut = drop_repeated(docs.withColumn(null, F.col("text").isNull()), [*others, null]).where("n_removed = 0 or trim(kept_text) <> ''")
    columns = {c: F.col(f"rest.`{c}`") for c in others} | {"text": F.when(~F.col(f"rest.`{null}`"), F.col("kept_text"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(columns["n_chars"])
    return cut.select(*(columns.get(c, columns["text"]).alias(c) for c in docs.columns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

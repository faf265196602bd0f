"""Two-way exchange between blocks of documents and shards of hashes.

Operators 4 and 7 look for strings that occur elsewhere in the corpus. Their
documents are dealt to blocks of about :data:`BLOCK_BYTES`: by the place of the
row in its file, so that equal rows are spread like any others, or, for tables
that do not come from files, by a hash of id and text. A block sends what may
repeat to shards, packed in one row for each shard it has something for; a shard
brings together what all blocks sent it and answers each row with one bit for
each thing that was sent. Only hashes, candidates and bits travel; the documents
are shuffled once, and that shuffle is read again by each later step.

Blocks and shards are many to a partition, of which there are
:data:`MAX_PARTITIONS` at most; they come in order, so a task holds one of them
at a time. A row is sent only if it has a hash, so there are never more rows than
hashes, whose number is in proportion to the corpus.

Which strings may repeat is told by minimizers: of the hashes of the parts
(grams) of a window the least one, leftmost if several are least. Equal windows
have equal minimizers at equal places, so no repeat is lost, and consecutive
windows mostly share theirs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronflow.llm.common import releasing, small_batches, utf8_bytes

BLOCK_BYTES = 4 << 20
#: Positions that are looked at together.
CHUNK = 1 << 19
#: Partitions of blocks or of shards at most.
MAX_PARTITIONS = 20_000
ANSWER = "block bigint, step int, shard bigint, bits binary"

U64 = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(32))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def gram_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; wraps modulo 2**64."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out, done, power, width = None, 0, base, 1
    while True:
        if k & width:
            part = h[done : done + n]
            out = part.copy() if out is None else out * U64(power) + part
            done += width
        width *= 2
        if width > k:
            return mixed(out)
        h = h[: -width // 2 or None] * U64(power) + h[width // 2 :]
        power = power * power % 2**64


def minimizers(h: np.ndarray, k: int, window: int, ok: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that share a minimizer.

    ``h``: a hash for each position, or, with ``by``, its place in that table;
    ``ok``: which positions start a window that lies in one document. Returns
    first window, number of windows, position of the minimizer and its hash, for
    each run.
    """
    out = []
    total = len(h) - window + 1
    for start in range(0, max(0, total), CHUNK):
        end = min(total, start + CHUNK)
        if not ok[start:end].any():
            continue
        part = h[start : end + window - 1]
        g = gram_hashes(part if by is None else by[part], k)
        least = (g & ~U64(0x3FFFFF)) | np.arange(len(g), dtype=U64)
        width, want = 1, window - k + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & U64(0x3FFFFF)).astype(np.int64)
        valid = ok[start:end]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]))
        first = np.flatnonzero(new)
        number = np.cumsum(new)[valid]
        count = np.bincount(number - 1, minlength=len(first))
        out.append((first + start, count, place[first] + start, g[place[first]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Which positions of the joined documents start a window inside one."""
    ok = np.ones(int(lengths.sum()), bool)
    end = 0
    for n in lengths.tolist():
        end += n
        ok[max(end - n, end - window + 1) : end] = False
    return ok


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the ranges, joined."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def packed_deltas(cells: np.ndarray) -> bytes:
    """Ascending numbers as differences of as few bytes as the largest takes."""
    deltas = np.diff(cells, prepend=U64(0)).astype("<u8")
    width = max(1, (int(deltas.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + deltas.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_deltas(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=U64)


class Sizes:
    """How many blocks, shards and cells a corpus of so many bytes gets. All
    grow with it, so a block's and a shard's memory does not."""

    def __init__(self, n_bytes: int, hashes_a_byte: float, candidates_a_shard: int, spare_bits: int):
        """``spare_bits``: bits of a cell beyond those that number the hashes."""
        hashes = max(1, int(n_bytes * hashes_a_byte))
        self.blocks = max(1, -(-n_bytes // BLOCK_BYTES))
        self.shard_bits = (hashes >> 21).bit_length()
        self.cell_bits = min(64, max(self.shard_bits, hashes.bit_length() + spare_bits))
        self.shards = 1 << self.shard_bits
        self.exact_shards = max(1, -(-n_bytes // candidates_a_shard))

    def cells(self, h: np.ndarray, row: int = 0) -> np.ndarray:
        """Mixed again: minimizers are small hashes, most of which would fall to
        the first shard."""
        return mixed(h + U64((row + 1) * 0x632BE59BD9B4E019 % 2**64)) >> U64(64 - self.cell_bits)

    def cuts(self, cells: np.ndarray) -> np.ndarray:
        """Where the shards of ascending cells begin, and the end."""
        edges = np.arange(self.shards, dtype=U64) << U64(self.cell_bits - self.shard_bits)
        return np.r_[np.searchsorted(cells, edges), len(cells)]


def in_blocks(docs: DataFrame, sizes: Sizes, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text (as bytes) and block, and ``rest`` if columns are carried."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry is not None else []
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if _from_files(docs) else [doc_id, text]
    block = F.pmod(F.xxhash64(*place), F.lit(sizes.blocks))
    dealt = docs.select(doc_id.alias("doc_id"), text.cast("binary").alias("text"), *rest, block.alias("block"))
    return dealt.repartition(min(sizes.blocks, MAX_PARTITIONS), "block")


def _from_files(docs: DataFrame) -> bool:
    """If each row can tell where in which file it stands."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018 - analyses the columns
    except AnalysisException:
        return False
    return True


def sized(docs: DataFrame, hashes_a_byte: float, candidates_a_shard: int, spare_bits: int) -> Sizes:
    return Sizes(utf8_bytes(docs), hashes_a_byte, candidates_a_shard, spare_bits)


def rows_of(block: pa.Table) -> tuple[int, list, list[bytes], list[int]]:
    """Number of the block, its ids (nulls last) and texts in a fixed order, and
    which row of the table each is."""
    ids, found = block.column("doc_id").to_pylist(), block.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, found[k]))
    number = block.column("block")[0].as_py() if len(ids) else 0
    return number, [ids[k] for k in order], [found[k] for k in order], order


def cell_rows(number: int, sizes: Sizes, step: int, cells: np.ndarray, many: np.ndarray) -> list[tuple]:
    """What a block sends: its distinct cells, and which of them already repeat
    within the block."""
    cuts = sizes.cuts(cells)
    return [(number, step, s, packed_deltas(cells[a:b]), np.packbits(many[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]


CELLS = "block bigint, step int, shard bigint, cells binary, many binary"


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


CELLS_ARROW = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), ("cells", pa.binary()), ("many", pa.binary())])
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())])


def answered(rows: DataFrame, shards: int, answer: Callable[[dict[str, list]], list[bytes]]) -> DataFrame:
    """Bring the rows of each shard together and answer each with bits. Rows
    come in order of their shard, so one shard is held at a time."""
    names = rows.columns

    def replies(at: tuple, mine: dict[str, list]) -> pa.RecordBatch:
        bits = answer(mine)
        n = len(bits)
        return pa.record_batch([pa.array(mine["block"], pa.int64()), pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int64()), pa.array(bits, pa.binary())], schema=ANSWER_ARROW)

    def run(batches):
        now, held = None, {n: [] for n in names}
        for batch in batches:
            columns = {n: batch.column(k).to_pylist() for k, n in enumerate(names)}
            for k, at in enumerate(zip(columns["step"], columns["shard"], strict=True)):
                if at != now:
                    if now is not None:
                        yield replies(now, held)
                    now, held = at, {n: [] for n in names}
                for n in names:
                    held[n].append(columns[n][k])
        if now is not None:
            yield replies(now, held)

    return rows.repartition(min(shards, MAX_PARTITIONS), "step", "shard").sortWithinPartitions("step", "shard").mapInArrow(releasing(run), ANSWER)


def repeated_cells(mine: dict[str, list], most: int) -> tuple[list[bytes], list[bytes]]:
    """A bit for each cell: it repeats within a block or is in two blocks; and
    one that more than ``most`` blocks have it. Cells of a block are distinct."""
    cells = [unpacked_deltas(x) for x in mine["cells"]]
    ends = np.cumsum([len(c) for c in cells])[:-1]
    joined = np.concatenate(cells)
    order = np.argsort(joined, kind="stable").astype(np.int32)
    joined = joined[order]
    start = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1]]).astype(np.int32)
    del joined, cells
    blocks = np.diff(np.r_[start, len(order)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(mine["many"], np.diff(np.r_[0, ends, len(order)]).tolist(), strict=True)])
    # What one block has twice is repeated for the others too.
    twice = np.maximum.reduceat(many[order], start).astype(bool)
    out = []
    for found in ((blocks > 1) | twice, blocks > most):
        bits = np.empty(len(order), bool)
        bits[order] = np.repeat(found, blocks)
        out.append([np.packbits(x).tobytes() for x in np.split(bits, ends)])
    return tuple(out)


def merged_sketch(sizes: Sizes) -> Callable[[dict[str, list]], list[bytes]]:
    """Adds the blocks' parts of a count-min sketch cell by cell, over the cells
    of one shard, and answers which of a block's cells come to two or more.
    Counts stop at 255; ``cells`` and ``many`` give those of a block, up to two."""
    width = 1 << sizes.cell_bits - sizes.shard_bits

    def answer(mine: dict[str, list]) -> list[bytes]:
        start = U64(mine["shard"][0] * width)
        sketch = np.zeros(width, np.uint8)
        cells = []
        for packed, many in zip(mine["cells"], mine["many"], strict=True):
            at = (unpacked_deltas(packed) - start).astype(np.int64)
            # A block has each cell once.
            added = sketch[at].astype(np.uint16) + 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(at))
            sketch[at] = np.minimum(added, 255)
            cells.append(at)
        return [np.packbits(sketch[at] > 1).tobytes() for at in cells]

    return answer


def answers(flags: pa.Table, step: int) -> dict[int, bytes]:
    found = zip(flags.column("step").to_pylist(), flags.column("shard").to_pylist(), flags.column("bits").to_pylist(), strict=True)
    return {shard: bits for s, shard, bits in found if s == step}


def cell_bits(sizes: Sizes, cells: np.ndarray, found: dict[int, bytes]) -> np.ndarray:
    """The answers to :func:`cell_rows`, one bit for each of the cells."""
    cuts = sizes.cuts(cells).tolist()
    out = [np.unpackbits(np.frombuffer(found[s], np.uint8), count=b - a) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)

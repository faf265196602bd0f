"""Operator 13: token ids in binary files, found by key through a minimal perfect
hash.

A store is a folder on storage that all executors share:

* ``shard-*.ids``: ids of whole documents, an end id behind each, nothing else:
  little-endian unsigned integers of 16 bits, or 32 if the vocabulary needs them.
  Shards follow each other in ascending order of doc_id (null first, repeated ids
  by the hash of the text).
* ``index-*.mph``: keys are (doc_id, k), k counting repeated ids from 0; a hash
  deals them to parts of some :data:`PART_KEYS`. A part is a bitmap of levels: a
  key sets a bit of the first level where no other key that is left has the same
  place; its slot is the number of bits set before. Slots have no gaps; each has
  a fingerprint of 64 bits, shard, offset and count. A lookup takes about 1.6
  probes on average, whatever the number of keys.
* ``shards`` and ``parts``: tables of the files, with the ids before each shard.

Files are named afresh by each attempt of a task. What Spark commits, the table
of entries, names those that count, so a lost executor or a repeated task does no
harm. Tasks stream: a shard is written a batch at a time, and a range of
(doc_id, hash, place of the row) deals the rows, so repeated ids are spread too.

Texts are cut where the tokenizer always cuts, before a blank that follows other
than white space and around white space; each distinct piece goes through the
library once and up to :data:`PIECES` of them are remembered. Texts with other
white space or the tokenizer's own marks go through the library whole.

Cases: a null text is empty and has the end id alone; a null doc_id is a key; an
empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from heronflow.llm.common import shared_folder, spread_join, stored, table, texts

END, PIECES, PART_KEYS = 2, 500_000, 1 << 16
UNITS, ODD = re.compile(r" ?\S+|\s+(?!\S)|\s+"), re.compile(r"[^\S \t\n\r]")
#: RE2: two white characters in a row, or any other than blank and line feed, or the mark of cuts.
UNEVEN = r"[ \n]{2}|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: How byte-level vocabularies write a blank; what ends a piece; pieces of a call.
BLANK, WHITE, TOGETHER = "\u0120", " \t\n\r", 1000
MAGIC = 0x31485044494B4F54
ENTRY = np.dtype([("mark", "<u8"), ("at", "<u8"), ("shard", "<u4"), ("n", "<u4")])


def id_type(path: str, end: int) -> str:
    """The narrowest numbers that hold all ids."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size() - 1, end) < 1 << 16 else "<u4"


class Encoder:
    """Ids as the library gives them, as bytes of numbers of ``kind``."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.kind = Tokenizer.from_file(path), kind
        self.known: dict[str, bytes] = {}
        marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD.pattern, *map(re.escape, marks)]))
        self.uneven = "|".join([UNEVEN, *map(re.escape, marks)])

        size = self.library.get_vocab_size()
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith(BLANK) for i in range(size)])

    def of_units(self, units: list[str]) -> dict[str, bytes]:
        """Pieces that begin with a blank are encoded side by side: the library
        cuts before each blank, and only their first ids begin with one."""
        spaced = [u for u in units if u[0] == " " and len(u) > 1 and u[1] not in WHITE]
        out: dict[str, bytes] = {}
        for k in range(0, len(spaced), TOGETHER):
            some = spaced[k : k + TOGETHER]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, self.kind)
            edges = [*(np.flatnonzero(self.opens[ids]) * ids.itemsize).tolist(), ids.nbytes]
            data = ids.tobytes()
            out.update(zip(some, [data[a:b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))
        others = [u for u in units if u not in out]
        out.update(zip(others, self.by_library(others), strict=True))
        return out

    def by_library(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def of_distinct(self, units: list[str]) -> list[bytes]:
        """Ids of pieces that differ from each other; new ones are remembered as
        long as there is room."""
        new = [u for u in units if u and u not in self.known]
        found = self.of_units(new)
        get, known = found.get, self.known.get
        out = [known(u) or get(u, b"") for u in units]
        self.known.update(islice(found.items(), max(0, PIECES - len(self.known))))
        return out

    def of_even(self, texts: pa.Array) -> list[bytes]:
        """Texts whose white characters are single blanks and line feeds: cut,
        and joined from the distinct pieces' ids, for all texts at once."""
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        units = cut.flatten().dictionary_encode()
        codes = self.of_distinct(units.dictionary.to_pylist())
        ids, size = np.frombuffer(b"".join(codes), self.kind), np.fromiter(map(len, codes), np.int64, len(codes)) // np.dtype(self.kind).itemsize
        at, which = np.cumsum(size) - size, units.indices.to_numpy()
        count = size[which]
        end = np.cumsum(count)
        data = ids[np.repeat(at[which] - end + count, count) + np.arange(int(count.sum()))].tobytes()
        edges = np.r_[0, end][cut.offsets.to_numpy() - cut.offsets[0].as_py()] * np.dtype(self.kind).itemsize
        return [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(self, batch: list[str]) -> list[bytes]:
        texts = pa.array(batch, pa.large_string())
        uneven = pc.match_substring_regex(texts, self.uneven)
        out = iter(self.of_even(texts.filter(pc.invert(uneven))))
        others = iter(self.of_uneven([t for t, x in zip(batch, uneven.to_pylist(), strict=True) if x]))
        return [next(others if x else out) for x in uneven.to_pylist()]

    def of_uneven(self, batch: list[str]) -> list[bytes]:
        cut = [[] if self.odd.search(t) else UNITS.findall(t) for t in batch]
        units = list(set().union(*cut))
        get = dict(zip(units, self.of_distinct(units), strict=True)).__getitem__
        return [b"".join(map(get, c)) if c or not t else self.by_library([t])[0] for c, t in zip(cut, batch, strict=True)]


@lru_cache(1)
def encoder(path: str, kind: str) -> Encoder:
    """One a worker: what it remembers serves the tasks to come."""
    return Encoder(path, kind)


# --- minimal perfect hash ------------------------------------------------------


def hashed(ids: np.ndarray, ks: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of every key; another seed, another function."""
    x = ids.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for add, shift, times in ((ks, 30, 0xBF58476D1CE4E5B9), (0, 27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x += np.asarray(add).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


FINGERPRINT = 1 << 20  #: the seed that no level has


class Index:
    """Slots of the keys of a part. ``sizes``: bits of the levels; ``words``:
    the bitmap; ``before``: bits set before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, entries: np.ndarray) -> None:
        self.sizes, self.words, self.entries = sizes, words, entries
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, ks: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> Index:
        left, bits, sizes = np.arange(len(ids)), [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            place = (hashed(ids[left], ks[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size)
            bits.append(alone == 1)
            sizes.append(size)
            left = left[alone[place] != 1]
        words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        out = cls(np.array(sizes, np.int64), words, np.zeros(len(ids), ENTRY))
        slots, _ = out._slots(ids, ks)
        for name, values in (("mark", hashed(ids, ks, FINGERPRINT)), ("at", at), ("shard", shard), ("n", n)):
            out.entries[name][slots] = values
        return out

    def _slots(self, ids: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots, left, start = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = (hashed(ids[left], ks[left], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[left[hit]] = (self.before[place >> 6] + below)[hit]
            left, start = left[~hit], start + size
        return slots, left

    def find(self, ids: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries, and which of the keys are in the index at all."""
        slots, absent = self._slots(ids, ks)
        if not len(self.entries):
            return np.zeros(len(ids), ENTRY), np.zeros(len(ids), bool)
        found = self.entries[slots]
        there = found["mark"] == hashed(ids, ks, FINGERPRINT)
        there[absent] = False
        return found, there

    def to_bytes(self) -> bytes:
        head = np.array([MAGIC, len(self.entries), len(self.sizes), len(self.words)], "<i8")
        return head.tobytes() + self.sizes.astype("<i8").tobytes() + self.words.tobytes() + self.entries.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        magic, n, levels, words = np.frombuffer(data, "<i8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not an index of token ids")
        at = 32 + 8 * levels
        return cls(np.frombuffer(data, "<i8", levels, 32), np.frombuffer(data, "<u8", words, at), np.frombuffer(data, ENTRY, n, at + 8 * words))


def _keys(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ks; a null id has keys of its own, with the top bit of k."""
    ids = batch.column("doc_id")
    k = batch.column("k").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("k").to_numpy()
    null = np.asarray(ids.is_null())
    return np.asarray(ids.fill_null(0)).astype(np.int64), np.where(null, k | np.int64(-(2**63)), k)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "k"), F.lit(parts))


# --- writing -------------------------------------------------------------------


@dataclass
class Store:
    """``entries`` has a row for each document: doc_id, k. ``shards``: shard,
    path, n_docs, start. ``parts``: part, path."""

    folder: str
    entries: DataFrame
    shards: DataFrame
    parts: DataFrame
    n_parts: int
    kind: str


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _shards(docs: DataFrame, folder: str, path: str, end: int, kind: str) -> DataFrame:
    """Writes shards; shard, path, doc_id, k (within the shard), at, n."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text").asc(), F.col("_row").asc()]
    rows = texts(docs).withColumns({"_text": F.xxhash64("text"), "_row": F.xxhash64(F.monotonically_increasing_id())})
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    last_id = np.array([end], kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, out, at, last, k = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}.ids", None, 0, None, -1
        codes = encoder(path, kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                where, top = _opened(folder)
                out = where.open_output_stream(f"{top}/{name}")
                last = (None,)  # no doc_id, not even null, is equal to it
            ids, ks, starts, counts = batch.column(0).to_pylist(), [], [], []
            for doc_id, data in zip(ids, codes.encode(batch.column(1).to_pylist()), strict=True):
                out.write(data + last_id)
                last, k = doc_id, k + 1 if doc_id == last else 0
                ks.append(k)
                starts.append(at)
                counts.append(len(data) // len(last_id) + 1)
                at += counts[-1]
            n = len(ids)
            columns = [pa.array([shard] * n), pa.array([name] * n), batch.column(0), pa.array(ks), pa.array(starts), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "doc_id", "k", "at", "n"])
        if out is not None:
            out.close()

    return stored(placed.mapInArrow(write, "shard bigint, path string, doc_id bigint, k bigint, at bigint, n bigint"))


def write_store(docs: DataFrame, path: str, end: int = END) -> Store:
    """Encodes ``docs`` (doc_id, text) with the tokenizer in the file ``path``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    where, top = _opened(folder)
    where.create_dir(top, recursive=True)
    kind = id_type(path, end)
    rows = _shards(docs, folder, path, end, kind)

    # An id that goes on from shard to shard: its rows in earlier shards all end their shards.
    shards = rows.groupBy("shard", "path").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"), F.min_by("doc_id", "at").alias("first"), F.max_by("doc_id", "at").alias("last"), (F.max_by("k", "at") + 1).alias("n_last")
    )
    asks = shards.select(F.col("first").alias("id"), "shard", F.lit(0).cast("bigint").alias("c"), F.lit(True).alias("asks"))
    gives = shards.select(F.col("last").alias("id"), "shard", F.col("n_last").alias("c"), F.lit(False).alias("asks"))
    earlier = Window.partitionBy("id").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    seen = asks.union(gives).withColumn("seen", F.coalesce(F.sum("c").over(earlier), F.lit(0))).where("asks").select("shard", "seen")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    shards = stored(shards.join(seen, "shard").select("shard", "path", "n_docs", "first", "seen", start))
    again = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("seen")).otherwise(0)
    located = spread_join(rows.drop("path"), shards.select("shard", "n_docs", "first", "seen"), "shard", "n_docs")
    entries = located.select("doc_id", (F.col("k") + again).alias("k"), "shard", "at", "n")

    n_parts = max(1, -(-rows.count() // PART_KEYS))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        ids, ks = _keys(group)
        index = Index.build(ids, ks, *(group.column(c).to_numpy() for c in ("shard", "at", "n")))
        name = f"index-{uuid.uuid4().hex}.mph"
        where, top = _opened(folder)
        with where.open_output_stream(f"{top}/{name}") as out:
            out.write(index.to_bytes())
        return pa.table({"part": [key[0].as_py()], "path": [name]})

    parts = stored(entries.withColumn("part", _part(n_parts)).groupBy("part").applyInArrow(build, "part bigint, path string"))
    return Store(folder, entries.select("doc_id", "k"), shards.select("shard", "path", "n_docs", "start"), parts, n_parts, kind)


# --- reading -------------------------------------------------------------------


def looked_up(store: Store, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (doc_id, k) with shard, at and n from the index; null
    where it has no such key. Keys are sorted by part, so a task opens few."""
    asked = keys.select("doc_id", "k").withColumns({"part": _part(store.n_parts), "_row": F.monotonically_increasing_id()})
    per = asked.groupBy("part").agg(F.count("*").alias("_n")).join(F.broadcast(store.parts) if store.n_parts <= 200_000 else store.parts, "part", "left")
    rows = spread_join(asked, stored(per), "part", "_n").repartitionByRange("part", "_row").sortWithinPartitions("part")
    folder = store.folder

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _opened(folder)
        opened, index = None, None
        for batch in batches:
            paths = batch.column("path").to_pylist()
            edges = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if opened != paths[a] or index is None:
                    opened = paths[a]
                    if opened is None:
                        index = Index.build(*[np.zeros(0, np.int64)] * 5)
                    else:
                        with where.open_input_file(f"{top}/{opened}") as f:
                            index = Index.from_bytes(f.read())
                some = batch.slice(a, b - a)
                found, there = index.find(*_keys(some))
                columns = [pa.array(found[c].astype(np.int64), mask=~there) for c in ("shard", "at", "n")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("k"), *columns], ["doc_id", "k", "shard", "at", "n"])

    return rows.select("doc_id", "k", "path").mapInArrow(find, "doc_id bigint, k bigint, shard bigint, at bigint, n bigint")


def fetched(store: Store, keys: DataFrame, check: bool = False) -> DataFrame:
    """doc_id, k, start (ids of the store before the document), n and ids of the
    keys that the store has; with ``check`` in place of the ids their crc32, as
    little-endian unsigned 32-bit integers."""
    rows = spread_join(looked_up(store, keys).where("shard is not null"), store.shards, "shard", "n_docs")
    placed = rows.select("doc_id", "k", "shard", "path", "start", "at", "n").repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
    folder, kind = store.folder, np.dtype(store.kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _opened(folder)
        opened, file = None, None

        def one(path: str, at: int, n: int) -> np.ndarray:
            nonlocal opened, file
            if path != opened:
                opened, file = path, where.open_input_file(f"{top}/{path}")
            file.seek(kind.itemsize * at)
            return np.frombuffer(file.read(kind.itemsize * n), kind).astype("<u4")

        for batch in batches:
            found = (one(*where_) for where_ in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n")), strict=True))
            last = pa.array([zlib.crc32(ids) for ids in found], pa.int64()) if check else pa.array(list(found), pa.list_(pa.int64()))
            start = pa.array(batch.column("start").to_numpy() + batch.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), start, batch.column("n"), last], ["doc_id", "k", "start", "n", name])

    name = "crc32" if check else "ids"
    return placed.mapInArrow(read, f"doc_id bigint, k bigint, start bigint, n bigint, {name} {'bigint' if check else 'array<bigint>'}")


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = fetched(store, store.entries, check=True)
    return rows.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))

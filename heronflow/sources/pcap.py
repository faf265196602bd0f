"""Capture files (OP-210, OP-211): pcap to packets and back, at any size.

Reading: files are cut into ranges of bytes. A task walks the headers of its
range from the first place from which a chain of :data:`CHAIN` valid headers goes
on, and says where it began and where the first packet behind the range begins.
If a range's end is the next one's beginning, its packets are right, since a
walk that starts at a packet can't go astray; a range for which that does not hold
(payloads may hold captures themselves) is walked again from the right place.
Only then are packets read, range by range and a block at a time.

Writing: each task writes files of its own under a name of its attempt; when all
are done the driver puts those of the successful ones in place. Packets that
don't fit the format are skipped.

A file that ends within a packet gives the packets before; files of another kind
give none.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Magic numbers, by byte order and unit of the fraction of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
HEAD, PACKET, LONGEST = 24, 16, 262_144
RANGE_BYTES, BLOCK, CHAIN, ROWS = 64 << 20, 1 << 20, 8, 1000


FILE_HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, 1)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def packet_bytes(t: int, data: bytes) -> bytes:
    return struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(data), len(data)) + data


def to_pcap(rows: list[tuple[int, bytes]]) -> bytes:
    """A few packets (microseconds, bytes) as the content of a file."""
    return FILE_HEAD + b"".join(packet_bytes(t, d) for t, d in rows)


class Capture:
    """A file read in blocks."""

    def __init__(self, path: str) -> None:
        where, name = opened(path)
        self.file = where.open_input_file(name)
        self.size = self.file.size()
        self.order, self.unit = MAGIC.get(self.file.read_at(4, 0) if self.size >= HEAD else b"", ("", 1))
        self.at, self.block = 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(min(max(n, BLOCK), self.size - at), at)
        return self.block[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple[int, int] | None:
        """Time in microseconds and length of the packet at a place; None where
        no packet can begin or the file ends within it."""
        if at + PACKET > self.size:
            return None
        seconds, part, n, whole = struct.unpack(f"{self.order}IIII", self.bytes_at(at, PACKET))
        if n > LONGEST or n > whole or part >= 1_000_000 * self.unit or at + PACKET + n > self.size:
            return None
        return seconds * 1_000_000 + part // self.unit, n

    def begins(self, at: int) -> bool:
        """If packets follow each other from here, as far as :data:`CHAIN`."""
        for _ in range(CHAIN):
            found = self.header(at)
            if found is None:
                return at == self.size
            at += PACKET + found[1]
        return True

    def first(self, start: int, end: int) -> int:
        """The first likely packet from ``start`` on, or ``end``."""
        if start <= HEAD:
            return HEAD
        return next((at for at in range(start, min(end, self.size)) if self.header(at) and self.begins(at)), end)

    def walk(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """Place, time and length of the packets that begin before ``end``."""
        while at < end and (found := self.header(at)):
            yield at, *found
            at += PACKET + found[1]


def _files(path: str) -> list[tuple[str, int]]:
    where, name = opened(path)
    info = where.get_file_info(name)
    scheme = path[: path.index(name)] if name in path else ""
    found = where.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in f.path[len(name) :].split("/")))


_WALKED = "path string, start bigint, stop bigint, began bigint, ended bigint"


def _dealt(ranges: DataFrame, n_bytes: int, n: int) -> DataFrame:
    """Neighbouring ranges go to one task, :data:`RANGE_BYTES` in all or more, so
    that small ranges do not make as many tasks."""
    tasks = min(n, max(ranges.sparkSession.sparkContext.defaultParallelism, n_bytes // RANGE_BYTES))
    return ranges.repartitionByRange(max(1, tasks), "path", "start").sortWithinPartitions("path", "start")


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Capture]]:
    """Ranges with their files; one that the next range needs stays open, with
    what was read of it."""
    file, path = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if file is None or r["path"] != path:
                file, path = Capture(r["path"]), r["path"]
            yield r, file


def _walked(ranges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, file in _captures(batches):
            began = ended = r["stop"]
            if file.order:
                began = ended = file.first(r["start"], r["stop"]) if r["began"] is None else r["began"]
                for at, _, n in file.walk(began, r["stop"]):
                    ended = at + PACKET + n
            yield pa.RecordBatch.from_pylist([{**r, "began": began, "ended": ended}])

    return ranges.mapInArrow(run, _WALKED)


def ranges_of(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges with the places where their packets begin and end; one row for
    each range comes to the driver."""
    cut = [(name, start, min(start + range_bytes, size), None, None) for name, size in _files(path) for start in range(0, size, range_bytes)]
    asked = spark.createDataFrame(cut, _WALKED)
    known = {(r.path, r.start): r for r in _walked(_dealt(asked, sum(r[2] - r[1] for r in cut), len(cut))).collect()}
    while True:
        wrong = {}
        for (name, start), r in sorted(known.items()):
            if name in wrong:  # what follows in this file depends on it
                continue
            before = known.get((name, start - range_bytes))
            # What a long packet goes beyond has no packet of its own.
            if before and (want := max(before.ended, start)) != r.began and (before.ended > start or r.began < r.stop):
                wrong[name] = (name, start, r.stop, want if before.ended >= start else r.stop, None)
        if not wrong:
            break
        known |= {(r.path, r.start): r for r in _walked(spark.createDataFrame(list(wrong.values()), _WALKED)).collect()}
    return spark.createDataFrame([tuple(known[k]) for k in sorted(known)], _WALKED)


def _packets(ranges: DataFrame) -> DataFrame:
    """Of ranges with path, began and stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, file in _captures(batches):
            found = ((t, file.bytes_at(at + PACKET, n)) for at, t, n in file.walk(r["began"], r["stop"])) if file.order else iter(())
            while some := list(islice(found, ROWS)):
                times, data = zip(*some, strict=True)
                yield pa.record_batch([pa.array(times, pa.int64()), pa.array(data, pa.binary()), pa.array([r["path"]] * len(some), pa.string())], names=["ts_us", "data", "file"])

    rows = ranges.select("path", "began", "stop").mapInArrow(run, "ts_us bigint, data binary, file string")
    return rows.select(F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "data", F.regexp_extract("file", "([^/]+)$", 1).alias("interface"))


def read_pcap(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """ts, data, interface (the file's name) of every packet of a file or of
    all files below a folder."""
    ranges = ranges_of(spark, path, range_bytes).where("began < stop")
    n, n_bytes = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    return _packets(_dealt(ranges, n_bytes, n))


def stream_pcap(spark: SparkSession, folder: str) -> DataFrame:
    """The same for files as they come, a task for each; rate by
    maxFilesPerTrigger. Files are read in blocks here too."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 16).load(folder)
    return _packets(files.select("path", F.lit(HEAD).cast("bigint").alias("began"), F.col("length").alias("stop")))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    packets: int
    skipped: int


class PcapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, top = opened(self.path)
        name, out, written, skipped = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pcap", None, 0, 0
        for batch in iterator:
            for t, data in zip(batch.column("ts_us").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if t is None or data is None or len(data) > LONGEST or not 0 <= t < 2**32 * 1_000_000:
                    skipped += 1
                    continue
                if out is None:
                    where.create_dir(f"{top}/_temporary-{self.job}", recursive=True)
                    out = where.open_output_stream(f"{top}/_temporary-{self.job}/{name}")
                    out.write(FILE_HEAD)
                out.write(packet_bytes(t, data))
                written += 1
        if out is not None:
            out.close()
        return Written(name if out is not None else None, written, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        where, top = opened(self.path)
        where.create_dir(top, recursive=True)
        if self.overwrite:
            for name, _ in _files(self.path):
                where.delete_file(opened(name)[1])
        for m in messages:
            if m and m.name:
                where.move(f"{top}/_temporary-{self.job}/{m.name}", f"{top}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, top = opened(self.path)
        if where.get_file_info(f"{top}/_temporary-{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{top}/_temporary-{self.job}")


class PcapSink(DataSource):
    """``df.write.format("pcap").save(folder)`` of ts_us and data."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def writer(self, schema, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options["path"], overwrite)


def write_pcap(packets: DataFrame, path: str, mode: str = "append") -> None:
    """OP-211: packets (ts, data) as capture files, one a task."""
    packets.sparkSession.dataSource.register(PcapSink)
    rows = packets.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("data").cast("binary").alias("data"))
    rows.write.format("pcap").mode(mode).save(path)

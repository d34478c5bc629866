"""The record-framed binary log and its sparse index, for exchange with programs that use them.

Log: header, then records of length, CRC-32 and payload. Index: header, then time, sequence and byte offset of
every stride-th record. Integers are little-endian. Parquet (store.py) is what queries should run on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tickloom.errors import ChecksumError, StorageError
from tickloom.operators.selection import INDEX_STRIDE, read_events
from tickloom.schema import BOOK_FIELDS, COLUMNS, QUOTE, TRADE, TRADE_FIELDS
from tickloom.sources.store import VERSION, schema_hash

#: The first bytes of the two files.
LOG_MAGIC, INDEX_MAGIC = b"MDELOG01", b"MDEIDX01"
#: Numbers of the kinds in a payload.
KIND_NUMBERS = {TRADE: 0, QUOTE: 1}
_FIELDS = {TRADE: TRADE_FIELDS, QUOTE: BOOK_FIELDS}


@dataclass(frozen=True)
class Header:
    version: int
    schema_hash: int
    symbols: tuple[str, ...]
    data_offset: int


def pack_event(event: dict) -> bytes:
    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    kind, number = event["kind"], KIND_NUMBERS[event["kind"]]
    values = [event[f] for f in _FIELDS[kind]]
    return struct.pack("<QQ", event["timestamp_ns"], event["sequence"]) + text(event["venue"]) + text(event["symbol"]) + struct.pack(f"<II{len(values)}q", number, number, *values)


def unpack_event(payload: bytes) -> dict:
    try:
        ts, sequence = struct.unpack_from("<QQ", payload)
        at, texts = 16, []
        for _ in range(2):
            (size,) = struct.unpack_from("<Q", payload, at)
            texts.append(payload[at + 8 : at + 8 + size].decode())
            at += 8 + size
        number, same = struct.unpack_from("<II", payload, at)
        kind = {v: k for k, v in KIND_NUMBERS.items()}[number]
        if same != number:
            raise StorageError("kind and payload differ")
        values = struct.unpack_from(f"<{len(_FIELDS[kind])}q", payload, at + 8)
    except (struct.error, KeyError, UnicodeDecodeError) as e:
        raise StorageError(f"malformed record: {e}") from e
    return dict.fromkeys(COLUMNS) | {"timestamp_ns": ts, "sequence": sequence, "venue": texts[0], "symbol": texts[1], "kind": kind} | dict(zip(_FIELDS[kind], values))


def pack_header(symbols: Iterable[str]) -> bytes:
    names = [s.encode() for s in symbols]
    if long := next((n for n in names if len(n) > 255), None):
        raise StorageError(f"symbol too long: {long.decode()}")
    return LOG_MAGIC + struct.pack("<HQI", VERSION, schema_hash(), len(names)) + b"".join(bytes([len(n)]) + n for n in names)


def read_header(content: bytes) -> Header:
    if content[:8] != LOG_MAGIC:
        raise StorageError("bad magic")
    try:
        version, digest, count = struct.unpack_from("<HQI", content, 8)
        if version != VERSION:
            raise StorageError(f"unsupported version {version}")
        if digest != schema_hash():
            raise StorageError("another schema")
        at, symbols = 22, []
        for _ in range(count):
            size = content[at]
            symbols.append(content[at + 1 : at + 1 + size].decode())
            at += 1 + size
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise StorageError(f"malformed header: {e}") from e
    return Header(version, digest, tuple(symbols), at)


def records(content: bytes, offset: int | None = None) -> Iterator[tuple[int, dict]]:
    """(byte offset, event) from a record's offset on. A cut length is the end; anything else cut is an error."""
    at = read_header(content).data_offset if offset is None else offset
    while at + 4 <= len(content):
        if at + 8 > len(content):
            raise StorageError(f"truncated record at offset {at}")
        size, check = struct.unpack_from("<II", content, at)
        payload = content[at + 8 : at + 8 + size]
        if len(payload) < size:
            raise StorageError(f"truncated record at offset {at}")
        if crc32(payload) != check:
            raise ChecksumError(at)
        yield at, unpack_event(payload)
        at += 8 + size


@dataclass(frozen=True)
class Index:
    stride: int
    entries: tuple[tuple[int, int, int], ...]

    def seek(self, from_ns: int) -> int | None:
        """Offset of the last entry at or before from_ns, or of the first. A range read uses seek(from_ns - 1), which ties can't cheat."""
        passed = [o for ts, _, o in self.entries if ts <= from_ns]
        return passed[-1] if passed else self.entries[0][2] if self.entries else None


def pack_index(stride: int, entries: Iterable[tuple[int, int, int]]) -> bytes:
    if stride <= 0:
        raise StorageError("index stride must be > 0")
    return INDEX_MAGIC + struct.pack("<HI", VERSION, stride) + b"".join(struct.pack("<QQQ", *e) for e in entries)


def read_index(content: bytes) -> Index:
    if content[:8] != INDEX_MAGIC:
        raise StorageError("bad index magic")
    version, stride = struct.unpack_from("<HI", content, 8)
    if version != VERSION:
        raise StorageError(f"unsupported index version {version}")
    body = content[14:]
    rest = len(body) % 24
    if rest >= 8:  # a time without the rest of its entry; a cut time is the end
        raise StorageError("truncated index entry")
    return Index(stride, tuple(struct.iter_unpack("<QQQ", body[: len(body) - rest])))


def index_path(log: str) -> str:
    return f"{log}.idx"


def write_binary_log(events: DataFrame, path: str, stride: int = INDEX_STRIDE) -> int:
    """One log file and its index; rows reach the driver one partition at a time. Returns the number of events."""
    if stride <= 0:
        raise StorageError("index stride must be > 0")
    symbols = [r[0] for r in events.select("symbol").distinct().orderBy("symbol").collect()]  # the file's own dictionary
    entries, count = [], 0
    with Path(path).open("wb") as log:
        at = log.write(pack_header(symbols))
        for row in events.select(*COLUMNS).orderBy("sequence").toLocalIterator(prefetchPartitions=True):
            if count % stride == 0:
                entries.append((row["timestamp_ns"], row["sequence"], at))
            payload = pack_event(row.asDict())
            at += log.write(struct.pack("<II", len(payload), crc32(payload)) + payload)
            count += 1
    Path(index_path(path)).write_bytes(pack_index(stride, entries))
    return count


LOGGED = "byte_offset long, sequence long, timestamp_ns long, venue string, symbol string, kind string, price_ticks long, size long, bid_px long, bid_sz long, ask_px long, ask_sz long"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _events(content: bytes, start: int | None = None) -> Iterator[pa.RecordBatch]:
    """Events of a whole log, or of a part of it without the header that begins at byte `start`."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6]
    names = ["byte_offset", *COLUMNS]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for offset, event in records(content, None if start is None else 0):
        rows.append((offset + (start or 0), *(event[c] for c in COLUMNS)))
        if len(rows) == 20_000:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield from _events(content.as_py())


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            system, inside = _filesystem(path)
            with system.open_input_file(inside) as log:
                yield from _events(log.read_at(end - start, start), start)


def read_binary_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of one or more log files with their byte offsets, a task for each file; for large logs with an index see read_indexed()."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, LOGGED)


def read_indexed(spark: SparkSession, path: str, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Events of one log of any size with their byte offsets, by way of its index: tasks seek to the strides that the range touches and read no others.

    The log's times ascend, as its writer orders it. A log without entries has no events.
    """
    system, inside = _filesystem(path)
    with system.open_input_file(index_path(inside)) as f:
        entries = read_index(f.read()).entries
    size = system.get_file_info(inside).size
    ends = [*((ts, at) for ts, _, at in entries[1:]), (None, size)]
    wanted = [(path, at, end) for (ts, _, at), (after, end) in zip(entries, ends) if (to_ns is None or ts <= to_ns) and (from_ns is None or after is None or after >= from_ns)]
    ranges = spark.createDataFrame(wanted, "path string, start long, end long").repartition(max(1, min(len(wanted), 4 * spark.sparkContext.defaultParallelism)))
    return read_events(ranges.mapInArrow(_read_ranges, LOGGED), from_ns, to_ns)

"""Packet captures: file scan, Ethernet/IPv4/UDP decapsulation and the binary order feed, decoded in the JVM.

Only the split of a file into packets needs Python. Decoding is column expressions that never raise: a bad packet
carries the offset and the reason of its first fault, and goes to the issues.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.errors import IngestError
from tickloom.operators.features import top_of_book
from tickloom.operators.sequencing import assign_sequences
from tickloom.schema import BOOK_FIELDS, QUOTE, TRADE, pending

#: File header of a capture, by byte order and resolution of time.
_ORDERS = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
_HEADER, _RECORD = 24, 16
#: Message types and lengths of the order feed.
ADD_ORDER, TRADE_MESSAGE = 1, 2
ADD_LENGTH, TRADE_LENGTH = 37, 36
PACKETS = "path string, packet_index long, ts_ns long, data binary"


def packets_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(packet_index from 1, time in ns, data) of a capture file."""
    if content[:4] not in _ORDERS or len(content) < _HEADER:
        raise IngestError("not a capture file")
    order, unit = _ORDERS[content[:4]]
    at, index = _HEADER, 0
    while at < len(content):
        if at + _RECORD > len(content):
            raise IngestError(f"truncated packet header at offset {at}")
        seconds, part, size, _ = struct.unpack_from(f"{order}IIII", content, at)
        at += _RECORD
        if at + size > len(content):
            raise IngestError(f"truncated packet at offset {at}")
        index += 1
        yield index, seconds * 1_000_000_000 + part * unit, content[at : at + size]
        at += size


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows: list[tuple] = []
            for packet in packets_of(content.as_py()):
                rows.append((path, *packet))
                if len(rows) == 10_000:
                    yield _packet_batch(rows)
                    rows = []
            if rows:
                yield _packet_batch(rows)


def _packet_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "packet_index", "ts_ns", "data"])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of one or more capture files, a task for each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, PACKETS)


def unsigned(data: Column, at: Column | int, size: int) -> Column:
    """Big-endian, from a 0-based offset, as text of a decimal number; null beyond the end."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10)


def small(data: Column, at: Column | int, size: int) -> Column:
    return unsigned(data, at, size).cast("long")


def signed(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 8)), 16, -10).cast("long")


def _first_fault(checks: list[tuple[Column, Column | int, Column | str]]) -> Column:
    """struct<offset, detail> of the first check that holds; null if none does."""
    fault = None
    for holds, offset, detail in checks:
        made = F.struct((F.lit(offset) if isinstance(offset, int) else offset).cast("long").alias("offset"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
        fault = F.when(holds, made) if fault is None else fault.when(holds, made)
    return fault


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that no filter is pushed through: substituted into each other, the decoders' expressions would grow without bound."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def udp_payload(df: DataFrame, data: str = "data") -> DataFrame:
    """df with payload (null for bad frames) and frame_fault struct<offset, detail> (null for good ones)."""
    d, size = F.col(data), F.length(data)
    byte = lambda at: F.coalesce(small(d, at, 1), F.lit(0))
    ethertype = F.coalesce(small(d, 12, 2), F.lit(0))
    version, header = F.shiftright(byte(14), 4), byte(14).bitwiseAND(F.lit(15)) * 4
    udp = (header + 14).cast("int")
    length = F.coalesce(small(d, udp + 4, 2), F.lit(0))
    fault = _first_fault([
        (size < 14, 0, "short ethernet header"),
        (ethertype != 0x0800, 12, F.concat(F.lit("unsupported ethertype 0x"), F.lower(F.lpad(F.hex(ethertype), 4, "0")))),
        (size < 34, 14, "short ipv4 header"),
        (version != 4, 14, F.concat(F.lit("unsupported ip version "), version.cast("string"))),
        (header < 20, 14, "invalid ipv4 ihl"),
        (size < header + 14, 14, "truncated ipv4 header"),
        (byte(23) != 17, 23, F.concat(F.lit("non-udp protocol "), byte(23).cast("string"))),
        (size < udp + 8, udp, "short udp header"),
        (length < 8, udp + 4, "invalid udp length"),
        (size < udp + length, udp + 4, "truncated udp payload"),
    ])
    df = _bound(df, "frame_fault", fault)
    return _bound(df, "payload", F.when(F.col("frame_fault").isNull(), F.substring(d, udp + 9, (length - 8).cast("int"))))


def order_message(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with message struct<timestamp_ns, symbol, side, price, size> (side null for trades) and message_fault."""
    p, size = F.col(payload), F.length(payload)
    kind = F.coalesce(small(p, 8, 4), F.lit(0))
    side = F.coalesce(small(p, 20, 1), F.lit(0))
    add, trade = kind == ADD_ORDER, kind == TRADE_MESSAGE
    name = F.substring(p, 13, 8)
    # The 8 bytes are unsigned; our times are signed, so the upper half of the range is a fault.
    time = F.try_to_number(F.coalesce(unsigned(p, 0, 8), F.lit("0")), F.lit("9" * 20)).cast("decimal(20,0)")
    short = lambda have, at, need: (size < have, at, f"short packet need {need} bytes")
    fault = _first_fault([
        short(8, 0, 8),
        short(12, 8, 4),
        (~(add | trade), 8, F.concat(F.lit("unknown message type "), kind.cast("string"))),
        short(20, 12, 8),
        (F.hex(name).rlike("^([0-9A-F]{2})*[89A-F]"), 12, "symbol is not valid ASCII"),
        (add & (size < 21), 20, "short packet need 1 bytes"),
        (add & (side > 1), 20, F.concat(F.lit("invalid side "), side.cast("string"))),
        (add & (size < 29), 21, "short packet need 8 bytes"),
        (add & (size < 37), 29, "short packet need 8 bytes"),
        (add & (size > 37), 37, "trailing bytes"),
        (trade & (size < 28), 20, "short packet need 8 bytes"),
        (trade & (size < 36), 28, "short packet need 8 bytes"),
        (trade & (size > 36), 36, "trailing bytes"),
        (time > F.lit(str((1 << 63) - 1)).cast("decimal(20,0)"), 0, "timestamp out of range"),
    ])
    df = _bound(df, "message_fault", F.when(p.isNotNull(), fault))
    good = p.isNotNull() & F.col("message_fault").isNull()
    message = F.struct(
        time.cast("long").alias("timestamp_ns"),
        F.regexp_replace(F.decode(name, "US-ASCII"), r"[ \x00]+$", "").alias("symbol"),
        F.when(add & (side == 0), "bid").when(add, "ask").alias("side"),
        F.when(add, signed(p, 21)).otherwise(signed(p, 20)).alias("price"),
        F.when(add, signed(p, 29)).otherwise(signed(p, 28)).alias("size"),
    )
    return _bound(df, "message", F.when(good, message))


def decoded(packets: DataFrame) -> DataFrame:
    """packets (packet_index, data) with message and fault, one of them null."""
    df = order_message(udp_payload(packets))
    return df.withColumn("fault", F.coalesce("frame_fault", "message_fault"))


def issues(df: DataFrame) -> DataFrame:
    """The dead letters: packet_index, offset, detail."""
    return df.where(F.col("fault").isNotNull()).select("packet_index", "fault.offset", "fault.detail")


def pending_events(df: DataFrame, venue: str) -> DataFrame:
    """Good packets as pending events; orders become snapshots of their symbol's book in order of arrival."""
    rows = df.where(F.col("message").isNotNull()).select(F.col("packet_index").alias("ingest_order"), "message.*")
    book = top_of_book(rows)
    trade = F.col("side").isNull()
    return pending(book.select(
        "ingest_order", "timestamp_ns", F.lit(venue).alias("venue"), "symbol", F.when(trade, TRADE).otherwise(QUOTE).alias("kind"),
        F.when(trade, F.col("price")).alias("price_ticks"), F.when(trade, F.col("size")).alias("size"), *(F.when(~trade, F.col(c)).alias(c) for c in BOOK_FIELDS),
    ))


def ingest(spark: SparkSession, path: str, venue: str) -> tuple[DataFrame, DataFrame]:
    """Canonical events and issues of a capture file."""
    df = decoded(read_packets(spark, path))
    return assign_sequences(pending_events(df, venue)), issues(df)

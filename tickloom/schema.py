"""The canonical event: one row per trade or quote, in a total order, prices in integer ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADE, QUOTE = "trade", "quote"
KEYS = ("sequence", "timestamp_ns", "venue", "symbol", "kind")
TRADE_FIELDS = ("price_ticks", "size")
BOOK_FIELDS = ("bid_px", "bid_sz", "ask_px", "ask_sz")
PAYLOAD = (*TRADE_FIELDS, *BOOK_FIELDS)
COLUMNS = (*KEYS, *PAYLOAD)

_TEXT = {"venue", "symbol", "kind"}
EVENT = T.StructType([T.StructField(c, T.StringType() if c in _TEXT else T.LongType(), c not in KEYS) for c in COLUMNS])
#: Before the total order is known: ingest_order in place of sequence.
PENDING_COLUMNS = ("ingest_order", *COLUMNS[1:])


def pending(df: DataFrame) -> DataFrame:
    """df in the staging schema; payload columns that its source lacks are null."""
    missing = {c: F.lit(None).cast("long") for c in PENDING_COLUMNS if c not in df.columns}
    return df.withColumns(missing).select(*(F.col(c).cast("string" if c in _TEXT else "long").alias(c) for c in PENDING_COLUMNS))


def violates() -> Column:
    """True for rows whose payload does not fit their kind."""
    filled = lambda fields: F.forall(F.array(*fields), lambda x: x.isNotNull())
    empty = lambda fields: F.forall(F.array(*fields), lambda x: x.isNull())
    trade = (F.col("kind") == TRADE) & filled(TRADE_FIELDS) & empty(BOOK_FIELDS)
    quote = (F.col("kind") == QUOTE) & filled(BOOK_FIELDS) & empty(TRADE_FIELDS)
    return ~F.coalesce(trade | quote, F.lit(False))


def trade_row(sequence: int, timestamp_ns: int, venue: str, symbol: str, price_ticks: int, size: int) -> tuple:
    return (sequence, timestamp_ns, venue, symbol, TRADE, price_ticks, size, None, None, None, None)


def quote_row(sequence: int, timestamp_ns: int, venue: str, symbol: str, bid_px: int, bid_sz: int, ask_px: int, ask_sz: int) -> tuple:
    return (sequence, timestamp_ns, venue, symbol, QUOTE, None, None, bid_px, bid_sz, ask_px, ask_sz)

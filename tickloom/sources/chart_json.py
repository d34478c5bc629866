"""Chart JSON (bars of time, close, low, high, volume) to pending events; each bar makes a trade, a quote, both or neither."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.errors import IngestError
from tickloom.functions.ticks import TickTable, double_to_ticks
from tickloom.operators.sequencing import assign_sequences
from tickloom.schema import QUOTE, TRADE, pending

#: The layout of a response.
CHART = """chart struct<
  result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<
    close: array<double>, high: array<double>, low: array<double>, volume: array<bigint>>>>>>,
  error: struct<description: string>>"""
_LATEST_SECOND = (1 << 63) // 1_000_000_000 - 1


def parse_symbols(text: str) -> list[str]:
    """Comma-separated, blanks dropped."""
    found = [s for s in (x.strip() for x in text.split(",")) if s]
    if not found:
        raise IngestError("symbols list is empty")
    return found


def fetch(base_url: str, symbols: list[str], interval: str = "1m", range_: str = "1d", get: Callable[[str], str] | None = None) -> list[tuple[int, str, str]]:
    """(symbol_pos, symbol, raw) of each symbol's chart, one request after the other; get replaces HTTP in tests."""
    if not symbols:
        raise IngestError("symbols list is empty")
    query = urlencode({"interval": interval, "range": range_, "includePrePost": "false", "events": "history"})

    def over_http(url: str) -> str:
        with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as response:
            return response.read().decode()

    read = get or over_http
    return [(k, s, read(f"{base_url.rstrip('/')}/{quote(s)}?{query}")) for k, s in enumerate(symbols)]


def charts(spark: SparkSession, raw: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(raw, "symbol_pos int, symbol string, raw string")


def _fail(condition: Column, text: Column, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.concat_ws(": ", "symbol", text))).otherwise(value)


def events(df: DataFrame, venue: str, ticks: TickTable) -> DataFrame:
    """Pending events of (symbol_pos, symbol, raw), in order of symbol, time and trade before quote."""
    parsed = df.withColumn("chart", F.from_json("raw", CHART, {"mode": "FAILFAST"})["chart"])
    result, bars = F.get(F.col("chart.result"), F.lit(0)), F.get(F.col("chart.result"), F.lit(0))["indicators"]["quote"]
    failed = F.col("chart.error").isNotNull()
    checked = _fail(failed, F.coalesce("chart.error.description", F.lit("upstream error")), result)
    checked = _fail(~failed & result.isNull(), F.lit("missing chart result"), checked)
    checked = _fail(~failed & result.isNotNull() & F.get(bars, F.lit(0)).isNull(), F.lit("missing quote payload"), checked)
    one = parsed.select("symbol_pos", "symbol", checked.alias("r")).select("symbol_pos", "symbol", F.col("r.timestamp").alias("times"), F.get(F.col("r.indicators.quote"), F.lit(0)).alias("q"))
    bar = one.select("symbol_pos", "symbol", "q", F.posexplode("times").alias("ts_pos", "second"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    at = lambda name: F.get(F.col(f"q.{name}"), F.col("ts_pos"))
    bar = bar.where(F.col("second").between(0, _LATEST_SECOND)).select(
        "symbol_pos", "symbol", "ts_pos", (F.col("second") * F.lit(1_000_000_000).cast("long")).alias("timestamp_ns"),
        *(finite(at(c)).alias(c) for c in ("close", "low", "high")), F.greatest(F.coalesce(at("volume"), F.lit(1)), F.lit(1)).alias("volume"),
    )
    bar = ticks.tick_of(bar)
    price = lambda c: double_to_ticks(c, F.col("tick"))
    none = F.lit(None).cast("long")

    def payload(rank: int, kind: str, price_ticks, size, bid, ask, book_size):
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), price_ticks.alias("price_ticks"), size.alias("size"), bid.alias("bid_px"), book_size.alias("bid_sz"), ask.alias("ask_px"), book_size.alias("ask_sz"))

    low, high = F.least("low", "high"), F.greatest("low", "high")
    trade = F.when(F.col("close").isNotNull(), payload(0, TRADE, price(F.col("close")), F.col("volume"), none, none, none))
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    quote_ = F.when(both, payload(1, QUOTE, none, none, price(low), price(high), F.col("volume")))
    flat = bar.select("symbol_pos", "symbol", "ts_pos", "timestamp_ns", F.explode(F.filter(F.array(trade, quote_), lambda x: x.isNotNull())).alias("p"))
    # A long that sorts as (symbol_pos, ts_pos, rank): only the order of ingest_order matters.
    order = F.shiftleft(F.col("symbol_pos").cast("long"), 40) + F.col("ts_pos") * 2 + F.col("p.rank")
    return pending(flat.select(order.alias("ingest_order"), "timestamp_ns", F.lit(venue).alias("venue"), "symbol", "p.*"))


def ingest(df: DataFrame, venue: str, ticks: TickTable | None = None) -> DataFrame:
    """Canonical events of charts; none at all is an error, as it is for the feed."""
    found = events(df, venue, ticks or TickTable.uniform())
    if found.isEmpty():
        raise IngestError("no events in charts")
    return assign_sequences(found)

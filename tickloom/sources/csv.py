"""Three CSV layouts to pending events. Columns bind by header name; the first bad row fails the job.

Values are read as text and typed here, so that what a reader would turn into null raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.errors import IngestError
from tickloom.functions.ticks import TickTable, text_to_ticks
from tickloom.functions.times import millis_to_ns, mixed_to_ns, rfc3339_to_ns
from tickloom.operators.sequencing import assign_sequences
from tickloom.schema import QUOTE, TRADE, pending

QUOTE_COLUMNS = ("timestamp", "symbol", "bid_px", "bid_sz", "ask_px", "ask_sz")
TRADE_COLUMNS = ("timestamp_ms", "symbol", "price", "size")
MIXED_COLUMNS = ("timestamp", "symbol", "type", "price", "size", "bid_px", "bid_sz", "ask_px", "ask_sz")
#: Columns of the mixed layout that a file may lack.
_OPTIONAL = frozenset(MIXED_COLUMNS[3:])


def read_text_columns(spark: SparkSession, path: str, columns: tuple[str, ...], optional: frozenset[str] = frozenset()) -> DataFrame:
    """The named columns as text, and ingest_order: the place of a row in its file, from 0.

    multiLine keeps a file in one task, so quoted line feeds work and the ids count its rows in order.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, mode="FAILFAST", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    lacking = [c for c in columns if c not in rows.columns and c not in optional]
    if lacking:
        raise IngestError(f"{path}: no column {', '.join(lacking)}")
    chosen = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    return rows.select(*chosen, F.monotonically_increasing_id().alias("ingest_order"))


def integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.cast("long")).otherwise(F.raise_error(F.concat(F.lit("invalid integer: "), text)))


def integer_or_zero(text: Column) -> Column:
    return F.when(text == "", F.lit(0).cast("long")).otherwise(integer(text))


def _row(what: str) -> Column:
    return F.concat(F.lit(f"{what} at row "), (F.col("ingest_order") + 1).cast("string"))


def quotes(spark: SparkSession, path: str, venue: str, ticks: TickTable) -> DataFrame:
    """Layout A: quotes at RFC 3339 times."""
    df = ticks.tick_of(read_text_columns(spark, path, QUOTE_COLUMNS))
    return pending(df.select(
        "ingest_order", rfc3339_to_ns(F.col("timestamp")).alias("timestamp_ns"), F.lit(venue).alias("venue"), "symbol", F.lit(QUOTE).alias("kind"),
        *(text_to_ticks(F.col(c), F.col("tick")).alias(c) for c in ("bid_px", "ask_px")), *(integer(F.col(c)).alias(c) for c in ("bid_sz", "ask_sz")),
    ))


def trades(spark: SparkSession, path: str, venue: str, ticks: TickTable) -> DataFrame:
    """Layout B: trades at milliseconds."""
    df = ticks.tick_of(read_text_columns(spark, path, TRADE_COLUMNS))
    return pending(df.select(
        "ingest_order", millis_to_ns(F.col("timestamp_ms")).alias("timestamp_ns"), F.lit(venue).alias("venue"), "symbol", F.lit(TRADE).alias("kind"),
        text_to_ticks(F.col("price"), F.col("tick")).alias("price_ticks"), integer(F.col("size")).alias("size"),
    ))


def mixed(spark: SparkSession, path: str, venue: str, ticks: TickTable) -> DataFrame:
    """Layout C: trades and quotes, at either kind of time; blank sizes are 0."""
    df = ticks.tick_of(read_text_columns(spark, path, MIXED_COLUMNS, _OPTIONAL))
    kind = (
        F.when(F.col("type").isin("trade", "Trade", "TRADE"), TRADE)
        .when(F.col("type").isin("quote", "Quote", "QUOTE"), QUOTE)
        .otherwise(F.raise_error(F.concat(F.lit("unknown row type '"), F.col("type"), _row("'"))))
    )
    df = df.withColumn("kind", kind)
    of = lambda k, value, c: F.when(F.col("kind") == k, value).alias(c)
    price = lambda c: text_to_ticks(F.col(c), F.col("tick"))
    return pending(df.select(
        "ingest_order", mixed_to_ns(F.col("timestamp")).alias("timestamp_ns"), F.lit(venue).alias("venue"), "symbol", "kind",
        of(TRADE, price("price"), "price_ticks"), of(TRADE, integer_or_zero(F.col("size")), "size"),
        *(of(QUOTE, price(c), c) for c in ("bid_px", "ask_px")), *(of(QUOTE, integer_or_zero(F.col(c)), c) for c in ("bid_sz", "ask_sz")),
    ))


LAYOUTS = {"a": quotes, "b": trades, "c": mixed}


def ingest(spark: SparkSession, layout: str, path: str, venue: str, ticks: TickTable | None = None) -> DataFrame:
    """Canonical events of a file in layout a, b or c."""
    return assign_sequences(LAYOUTS[layout](spark, path, venue, ticks or TickTable.uniform()))

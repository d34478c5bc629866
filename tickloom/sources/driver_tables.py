"""A market-event view of the plain `events` table, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.ticks import to_ticks
from tickloom.schema import QUOTE, TRADE, pending


def pending_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    px = F.lit(10_000).cast("long") + to_ticks(F.col("value").cast("decimal(20,10)"), F.lit("0.01")) % 1000
    df = raw.select(
        F.col("event_id").alias("ingest_order"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.lit("X").alias("venue"),
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
        F.when(F.col("event_type").isin("purchase", "click"), TRADE).otherwise(QUOTE).alias("kind"),
        k.alias("k"), px.alias("px"),
    )
    trade = F.col("kind") == TRADE
    return pending(df.select(
        "ingest_order", "timestamp_ns", "venue", "symbol", "kind",
        F.when(trade, F.col("px")).alias("price_ticks"), F.when(trade, F.col("k") + 1).alias("size"),
        F.when(~trade, F.when(F.col("k") % 17 == 0, 0).otherwise(F.col("px"))).alias("bid_px"), F.when(~trade, F.col("k") + 1).alias("bid_sz"),
        F.when(~trade, F.col("px") + 1 + F.col("k") % 40).alias("ask_px"), F.when(~trade, 100 - F.col("k")).alias("ask_sz"),
    ))

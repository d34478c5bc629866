"""Summaries of an event log, and comparisons of two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.render import event_line
from tickloom.operators.features import FeatureConfig, feature_lines
from tickloom.operators.sequencing import BUCKET_NS  # noqa: F401
from tickloom.schema import COLUMNS, PAYLOAD, QUOTE, TRADE

#: Numbered in blocks of so many sequences, each sorted by one task.
BLOCK = 1_000_000


def symbols(events: DataFrame) -> DataFrame:
    return events.select("symbol").distinct().orderBy("symbol")


def meta(events: DataFrame) -> DataFrame:
    """One row: events, trades, quotes, first and last time and sequence (0 if none), and the symbols, sorted."""
    def zero(c):
        return F.coalesce(c, F.lit(0)).cast("long")

    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("kind") == TRADE).alias("trades"),
        F.count_if(F.col("kind") == QUOTE).alias("quotes"),
        zero(F.min_by("timestamp_ns", "sequence")).alias("first_timestamp_ns"),
        zero(F.max_by("timestamp_ns", "sequence")).alias("last_timestamp_ns"),
        zero(F.min("sequence")).alias("first_sequence"),
        zero(F.max("sequence")).alias("last_sequence"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
    )


def positioned(df: DataFrame, order: str = "sequence") -> DataFrame:
    """df with pos, 1 for the least `order`; numbered block by block, so that no task holds all rows."""
    blocked = df.withColumn("__block", F.expr(f"`{order}` div {BLOCK}L"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("__block").agg(F.count("*").alias("__n")).select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(order))
    return blocked.withColumn("__within", within).join(starts, "__block").withColumn("pos", (F.col("__start") + F.col("__within")).cast("long")).drop("__block", "__within", "__start")


def parser_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: are two event lists equal position by position, and how does the first other position differ?"""
    def side(df, name):
        return positioned(df.select(*COLUMNS)).select("pos", F.struct(*COLUMNS).alias(name), event_line().alias(f"{name}_line"))

    both = side(left, "l").join(side(right, "r"), "pos", "full_outer")
    same = lambda *fields: F.forall(F.array(*(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in fields)), lambda x: x)
    reason = (
        F.when(F.col("l").isNull(), "left missing event")
        .when(F.col("r").isNull(), "right missing event")
        .when(~same("sequence"), "sequence mismatch")
        .when(~same("timestamp_ns"), "timestamp mismatch")
        .when(~same("symbol"), "symbol mismatch")
        .when(~same("venue"), "venue mismatch")
        .when(~same("kind", *PAYLOAD), "payload mismatch")
    )
    found = F.struct("pos", F.col("l.sequence").alias("left_sequence"), F.col("r.sequence").alias("right_sequence"), reason.alias("reason"), F.col("l_line").alias("left_line"), F.col("r_line").alias("right_line"))
    one = both.agg(
        F.count("l").alias("left_events"), F.count("r").alias("right_events"),
        F.min(F.when(reason.isNotNull(), found)).alias("m"), F.coalesce(F.max("pos"), F.lit(0)).alias("n"),
    )
    return one.select(
        F.col("m").isNull().alias("ok"), "left_events", "right_events", F.coalesce(F.col("m.pos") - 1, F.col("n")).cast("long").alias("matched_prefix"),
        F.col("m.pos").alias("mismatch_index"), *(F.col(f"m.{c}").alias(c) for c in ("left_sequence", "right_sequence", "reason", "left_line", "right_line")),
    )


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """ok, lines, first_mismatch_line (1-based) of two lists of (sequence, line)."""
    l, r = positioned(left).select("pos", F.col("line").alias("l")), positioned(right).select("pos", F.col("line").alias("r"))
    both = l.join(r, "pos", "full_outer")
    first = F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("pos")))
    return both.agg(first.alias("first_mismatch_line"), F.count("l").alias("lines")).select(F.col("first_mismatch_line").isNull().alias("ok"), "lines", "first_mismatch_line")


def determinism_report(events: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Features computed twice, the second time from rows that are dealt out differently, and compared line by line."""
    again = events.repartition(7, "timestamp_ns")
    return line_diff(feature_lines(events, config), feature_lines(again, config))

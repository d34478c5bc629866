"""The total order: sequence numbers without gaps, by (timestamp_ns, ingest_order, symbol, venue)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import COLUMNS

ORDER = ("timestamp_ns", "ingest_order", "symbol", "venue")
#: Width of a time bucket: the rows of one are sorted by one task.
BUCKET_NS = 3_600_000_000_000


def assign_sequences(pending: DataFrame, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Canonical events, numbered from 1.

    No task sees all rows: rows are numbered within time buckets, and a bucket starts where the counts of the
    earlier ones end. The running sum goes over one row per bucket. Choose bucket_ns so that a bucket fits a task.
    """
    placed = pending.withColumn("__bucket", F.expr(f"timestamp_ns div {bucket_ns}L"))
    sums = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__bucket").agg(F.count("*").alias("__n")).select("__bucket", F.coalesce(F.sum("__n").over(sums), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*ORDER)).cast("long")
    numbered = placed.withColumn("__place", within).join(starts, "__bucket")
    return numbered.withColumn("sequence", F.col("__start") + F.col("__place")).select(*COLUMNS)

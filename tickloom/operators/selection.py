"""Ranges, pages, strides and as-of positions of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the query API returns unless told otherwise, and the most it returns.
DEFAULT_LIMITS = {"events": 500, "series": 3000, "diff": 10_000}
MOST_ROWS = 100_000
INDEX_STRIDE = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def time_range(events: DataFrame, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Events of an inclusive range of time; the bounds reach the scan."""
    if from_ns is not None:
        events = events.where(F.col("timestamp_ns") >= from_ns)
    return events if to_ns is None else events.where(F.col("timestamp_ns") <= to_ns)


def read_events(events: DataFrame, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """A replay's input: the range in the order of the log."""
    return time_range(events, from_ns, to_ns).orderBy("sequence")


def clamp_limit(limit: int | None, default: int) -> int:
    return max(1, min(MOST_ROWS, default if limit is None else limit))


def select_events(events: DataFrame, from_seq: int | None = None, to_seq: int | None = None, symbol: str | None = None, limit: int | None = None, default: int = DEFAULT_LIMITS["events"]) -> DataFrame:
    """The first rows of a range of sequences and, ASCII case aside, a symbol."""
    if from_seq is not None:
        events = events.where(F.col("sequence") >= from_seq)
    if to_seq is not None:
        events = events.where(F.col("sequence") <= to_seq)
    if symbol is not None:
        events = events.where(F.translate("symbol", _UPPER, _LOWER) == symbol.translate(str.maketrans(_UPPER, _LOWER)))
    return events.orderBy("sequence").limit(clamp_limit(limit, default))


def tail(events: DataFrame, up_to: int, rows: int = 20) -> DataFrame:
    """The last rows up to a sequence, newest first; 20 to 1000."""
    return events.where(F.col("sequence") <= up_to).orderBy(F.desc("sequence")).limit(max(20, min(1000, rows)))


def stride_index(events: DataFrame, stride: int = INDEX_STRIDE) -> DataFrame:
    """Every stride-th event of the log, the first included; sequences have no gaps, so no window is needed."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    return events.where((F.col("sequence") - 1) % stride == 0).select("timestamp_ns", "sequence")


def index_seek(index: DataFrame, from_ns: int) -> DataFrame:
    """The last entry before from_ns, or the first: where a scan for from_ns may start.

    Entries at from_ns itself are passed over: events of that time may stand before them in the log.
    """
    before = F.max(F.when(F.col("timestamp_ns") < from_ns, F.col("sequence")))
    return index.agg(F.coalesce(before, F.min("sequence")).alias("sequence"))


def replay_schedule(events: DataFrame, speed: float = 1.0) -> DataFrame:
    """sequence, timestamp_ns, due_ns: when a paced replay that starts at 0 is due to send each event."""
    pace = speed if speed > 0 else 1.0
    first = events.agg(F.min_by("timestamp_ns", "sequence").alias("__first"))  # one row
    elapsed = F.greatest(F.col("timestamp_ns") - F.col("__first"), F.lit(0))
    return events.crossJoin(F.broadcast(first)).select("sequence", "timestamp_ns", (elapsed.cast("double") / F.lit(float(pace))).cast("long").alias("due_ns"))


def due_by(schedule: DataFrame, elapsed_ns: int) -> DataFrame:
    """What a player has shown after so much time."""
    return schedule.where(F.col("due_ns") <= elapsed_ns)


#: Buckets of a step of nearest_rank; so many counts reach the driver.
RANK_BUCKETS = 1024


def nearest_rank(df: DataFrame, value: str, share: float = 0.99) -> DataFrame:
    """The long `value` at the 0-based rank floor(n * share), n - 1 at most; 0 for no rows. Null values do not count.

    A search by histogram: counts of equal buckets from the least to the greatest value, then of the one bucket that holds the rank, until it
    is one value wide. No task sees more than its partition, and seven steps are enough for any long. df is read at each step, so its values
    must not change.
    """
    spark, v = df.sparkSession, F.col(value)
    low, high, total = df.agg(F.min(v), F.max(v), F.count(v)).first()
    rank = min(int(total * share), total - 1)
    while total and low < high:
        width = (high - low) // RANK_BUCKETS + 1
        counts = df.where(v.between(low, high)).groupBy(F.expr(f"cast((cast(`{value}` AS decimal(20,0)) - {low}BD) div {width}BD AS int)").alias("b")).agg(F.count("*").alias("n"))
        for bucket, n in sorted(counts.collect()):
            if rank < n:
                break
            rank -= n
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
    return spark.createDataFrame([(low or 0,)], "value long")


def throughput(count: int, seconds: float) -> float:
    return count / seconds if seconds > 0 else 0.0

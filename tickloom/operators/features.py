"""Per-symbol microstructure features as window expressions.

All windows share one exchange on symbol and one order, by sequence. State belongs to a symbol, whatever the venue.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.render import feature_line
from tickloom.schema import BOOK_FIELDS, TRADE

SERIES = ("sequence", "timestamp_ns", "symbol", "mid", "spread", "imbalance", "vol", "signal")


@dataclass(frozen=True)
class FeatureConfig:
    mid_window: int = 8
    ewma_alpha: float = 0.2
    spread_threshold: int = 25
    imbalance_threshold: float = 0.7
    vol_threshold: float = 0.03

    @classmethod
    def seeded(cls, seed: int) -> FeatureConfig:
        """A configuration drawn from the ranges that verification uses; the same for the same seed."""
        draw = random.Random(seed)
        return cls(8, draw.uniform(0.1, 0.35), draw.randrange(20, 30), draw.uniform(0.6, 0.8), draw.uniform(0.02, 0.04))


def _along(*keys: str) -> Window:
    return Window.partitionBy("symbol", *keys).orderBy("sequence")


def with_book(events: DataFrame) -> DataFrame:
    """Each row with its symbol's latest quote in book_*; zeros before the first."""
    until = _along().rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({f"book_{c}": F.coalesce(F.last(c, ignorenulls=True).over(until), F.lit(0)).cast("long") for c in BOOK_FIELDS})


def _two_sided() -> Column:
    return (F.col("book_bid_px") > 0) & (F.col("book_ask_px") > 0)


def with_quote_features(book: DataFrame) -> DataFrame:
    """raw_mid, spread and imbalance of a book."""
    own = F.when(F.col("kind") == TRADE, F.col("price_ticks").cast("double")).otherwise(0.0)
    total = F.col("book_bid_sz") + F.col("book_ask_sz")
    return book.withColumns({
        "raw_mid": F.when(_two_sided(), (F.col("book_bid_px").cast("double") + F.col("book_ask_px").cast("double")) * 0.5).otherwise(own),
        "spread": F.when(_two_sided(), F.col("book_ask_px") - F.col("book_bid_px")).otherwise(0).cast("long"),
        "imbalance": F.when(total == 0, 0.0).otherwise((F.col("book_bid_sz") - F.col("book_ask_sz")).cast("double") / F.nullif(total, F.lit(0)).cast("double")),
    })


def with_rolling_mid(df: DataFrame, window: int) -> DataFrame:
    """mid: the mean of the last positive mids, the row's own included; the raw one before any."""
    until = _along().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("positive_mid", F.when(F.col("raw_mid") > 0, F.col("raw_mid")))
    df = df.withColumn("n_mids", F.count("positive_mid").over(until))
    # A frame over the counter of positive mids: rows without one neither count nor take a place.
    latest = Window.partitionBy("symbol").orderBy("n_mids").rangeBetween(1 - max(window, 1), 0)
    return df.withColumn("mid", F.coalesce(F.avg("positive_mid").over(latest), F.col("raw_mid")))


def with_volatility(df: DataFrame, alpha: float) -> DataFrame:
    """vol: the root of the exponentially weighted mean of squared log returns.

    v_i = sum_j alpha (1-alpha)^(u_i - u_j) r_j^2 over updates u. Updates go in blocks as long as the memory of a
    double: what is older than the block before has weights under 2^-53. Within a block the terms are scaled by
    (1-alpha)^-position, at most 2^53, so a running sum serves all rows: linear time, no truncation that shows.
    """
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    until = _along().rowsBetween(Window.unboundedPreceding, 0)
    keep = 1 - alpha
    block = max(1, math.ceil(53 * math.log(2) / -math.log(keep))) if 0 < keep < 1 else 1
    previous = F.last("positive_mid", ignorenulls=True).over(before)
    df = df.withColumn("r2", F.pow(F.log(F.col("positive_mid") / previous), 2))
    df = df.withColumn("n_updates", F.count("r2").over(until))
    df = df.withColumns({"ewma_block": F.expr(f"n_updates div {block}"), "ewma_place": F.col("n_updates") % block})
    scaled = F.coalesce(F.lit(alpha) * F.col("r2") * F.pow(F.lit(keep), -F.col("ewma_place")), F.lit(0.0)) if 0 < keep < 1 else F.coalesce("r2", F.lit(0.0))
    df = df.withColumn("ewma_term", scaled)
    # n_updates never falls along a symbol, so ordering by block keeps the order of sequences.
    last_block = Window.partitionBy("symbol").orderBy("ewma_block").rangeBetween(-1, -1)
    same = F.sum("ewma_term").over(_along("ewma_block").rowsBetween(Window.unboundedPreceding, 0))
    if not 0 < keep < 1:
        latest = F.coalesce(F.last("r2", ignorenulls=True).over(until), F.lit(0.0))
        return df.withColumn("vol", F.sqrt(latest) if keep <= 0 else F.lit(0.0))
    older = F.coalesce(F.sum("ewma_term").over(last_block), F.lit(0.0))
    variance = F.pow(F.lit(keep), F.col("ewma_place")) * (same + F.lit(keep**block) * older)
    return df.withColumn("vol", F.sqrt(variance))


def with_signal(df: DataFrame, config: FeatureConfig) -> DataFrame:
    """signal: the thresholds that are passed, joined by |; null for none."""
    tags = F.concat_ws(
        "|",
        F.when(F.col("spread") > config.spread_threshold, "spread"),
        F.when(F.abs("imbalance") > config.imbalance_threshold, "imb"),
        F.when(F.col("vol") > config.vol_threshold, "vol"),
    )
    return df.withColumn("signal", F.nullif(tags, F.lit("")))


def series(events: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """A point for each event. Features start cold at the first row of `events`: select the slice first."""
    df = with_quote_features(with_book(events))
    df = with_volatility(with_rolling_mid(df, config.mid_window), config.ewma_alpha)
    return with_signal(df, config).select(*SERIES)


def signals(events: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The points that carry a signal."""
    return series(events, config).where(F.col("signal").isNotNull())


def feature_lines(events: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """sequence, line of the points that carry a signal."""
    return signals(events, config).select("sequence", feature_line().alias("line"))


def top_of_book(adds: DataFrame, order: str = "ingest_order") -> DataFrame:
    """One-sided orders (symbol, side, price, size) to four-sided snapshots, in order of arrival.

    side is `bid`, `ask`, or null for rows such as trades that leave the book as it is.
    """
    until = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side, c: F.coalesce(F.last(F.when(F.col("side") == side, F.col(c)), ignorenulls=True).over(until), F.lit(0)).cast("long")
    return adds.withColumns({"bid_px": last("bid", "price"), "bid_sz": last("bid", "size"), "ask_px": last("ask", "price"), "ask_sz": last("ask", "size")})

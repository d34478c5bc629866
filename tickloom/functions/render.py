"""Events and features as lines of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.schema import BOOK_FIELDS, KEYS, TRADE, TRADE_FIELDS


def event_line() -> Column:
    """`seq ts venue symbol trade px=.. sz=..` or `.. quote bid=..x.. ask=..x..`; integers only, so JVM formatting is exact."""
    head = [F.col(c) for c in KEYS]
    trade = F.format_string("%d %d %s %s %s px=%d sz=%d", *head, *TRADE_FIELDS)
    quote = F.format_string("%d %d %s %s %s bid=%dx%d ask=%dx%d", *head, *BOOK_FIELDS)
    return F.when(F.col("kind") == TRADE, trade).otherwise(quote)


@F.pandas_udf(StringType())
def six_places(x: pd.Series) -> pd.Series:
    """Exact binary value to six places, half to even; the JVM's formatter rounds the shortest decimal instead."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.6f}")


def feature_line() -> Column:
    number = lambda c: six_places(F.col(c))
    return F.concat_ws(
        " ", "sequence", "timestamp_ns", "symbol", F.concat(F.lit("mid="), number("mid")), F.concat(F.lit("spread="), "spread"),
        F.concat(F.lit("imb="), number("imbalance")), F.concat(F.lit("vol="), number("vol")), F.concat(F.lit("signal="), "signal"),
    )

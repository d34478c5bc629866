"""Features of a stream: the batch definitions, with each symbol's state carried from one micro-batch to the next.

Within a micro-batch a symbol's rows are sorted by sequence, and rows at or before the last sequence seen are dropped: the log has
no late rows. State is bounded: a book, the last mids of the window, the last positive mid and the variance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.features import FeatureConfig
from tickloom.schema import BOOK_FIELDS, COLUMNS, TRADE

POINT = "sequence long, timestamp_ns long, symbol string, mid double, spread long, imbalance double, vol double, signal string"
STATE = "sequence long, bid_px long, bid_sz long, ask_px long, ask_sz long, mids array<double>, last_mid double, variance double"


def step(state: tuple, row, config: FeatureConfig) -> tuple[tuple, tuple]:
    """One event after a state: the next state, and (mid, spread, imbalance, vol, signal)."""
    _, bid_px, bid_sz, ask_px, ask_sz, mids, last_mid, variance = state
    if row.kind != TRADE:
        bid_px, bid_sz, ask_px, ask_sz = (int(getattr(row, c)) for c in BOOK_FIELDS)
    two_sided = bid_px > 0 and ask_px > 0
    raw = (bid_px + ask_px) * 0.5 if two_sided else float(row.price_ticks) if row.kind == TRADE else 0.0
    if raw > 0:
        mids = [*mids, raw][-max(config.mid_window, 1) :]
        if last_mid:
            variance = config.ewma_alpha * math.log(raw / last_mid) ** 2 + (1 - config.ewma_alpha) * variance
        last_mid = raw
    spread = ask_px - bid_px if two_sided else 0
    total = bid_sz + ask_sz
    imbalance = (bid_sz - ask_sz) / total if total else 0.0
    vol = math.sqrt(variance)
    mid = sum(mids) / len(mids) if mids else raw
    passed = (("spread", spread > config.spread_threshold), ("imb", abs(imbalance) > config.imbalance_threshold), ("vol", vol > config.vol_threshold))
    signal = "|".join(name for name, over in passed if over) or None
    return (int(row.sequence), bid_px, bid_sz, ask_px, ask_sz, mids, last_mid, variance), (mid, spread, imbalance, vol, signal)


START = (0, 0, 0, 0, 0, [], None, 0.0)


def stateful_series(events: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Series points of a streaming DataFrame of canonical events."""

    def of_symbol(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        now = (*now[:5], list(now[5]), *now[6:])
        rows = pd.concat(parts).sort_values("sequence", kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if row.sequence <= now[0]:
                continue
            now, point = step(now, row, config)
            out.append((row.sequence, row.timestamp_ns, key[0], *point))
        state.update(now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in POINT.split(", ")])

    return events.select(*COLUMNS).groupBy("symbol").applyInPandasWithState(of_symbol, POINT, STATE, "append", GroupStateTimeout.NoTimeout)

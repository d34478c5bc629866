"""Prices to integer ticks: decimals, rounded half away from zero, per-symbol tick sizes."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.errors import TickError

#: Operands of this scale divide with 18 digits after the point; wider ones would lose digits in the quotient.
MONEY = "decimal(20,10)"
DEFAULT_TICK = "0.01"
_PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"


def positive(text: str) -> Decimal:
    try:
        value = Decimal(text)
    except InvalidOperation as e:
        raise TickError(f"not a decimal: {text}") from e
    if not value > 0:
        raise TickError(f"tick must be positive: {text}")
    return value


@dataclass(frozen=True)
class TickTable:
    """Tick sizes by symbol, and that of all others."""

    default: Decimal
    symbols: dict[str, Decimal] = field(default_factory=dict)

    @classmethod
    def uniform(cls, tick: str = DEFAULT_TICK) -> TickTable:
        return cls(positive(tick))

    @classmethod
    def from_toml(cls, text: str) -> TickTable:
        config = tomllib.loads(text)
        if "default_tick" not in config:
            raise TickError("default_tick is missing")
        return cls(positive(config["default_tick"]), {k: positive(v) for k, v in config.get("symbols", {}).items()})

    @classmethod
    def load(cls, path: str | None) -> TickTable:
        return cls.from_toml(Path(path).read_text()) if path else cls.uniform()

    def tick_of(self, df: DataFrame, symbol: str = "symbol", tick: str = "tick") -> DataFrame:
        """df with each symbol's tick. The table comes from a configuration file, so it may be broadcast."""
        if not self.symbols:
            return df.withColumn(tick, F.lit(str(self.default)).cast(MONEY))
        rows = [(s, str(t)) for s, t in self.symbols.items()]
        sizes = df.sparkSession.createDataFrame(rows, f"`{symbol}` string, __tick string")
        joined = df.join(F.broadcast(sizes), symbol, "left")
        return joined.withColumn(tick, F.coalesce("__tick", F.lit(str(self.default))).cast(MONEY)).drop("__tick")


def to_ticks(price: Column, tick: Column) -> Column:
    """Decimal price -> ticks. Quotients beyond a long raise."""
    return F.round(price.cast(MONEY) / tick.cast(MONEY), 0).cast("long")


def text_to_ticks(text: Column, tick: Column) -> Column:
    """Plain decimal text -> ticks; anything else, blanks too, raises."""
    price = F.when(text.rlike(_PLAIN), text).otherwise(F.raise_error(F.concat(F.lit("invalid decimal: "), F.coalesce(text, F.lit("null")))))
    return to_ticks(price, tick)


def double_to_ticks(price: Column, tick: Column) -> Column:
    """A double counts as its ten-digit decimal."""
    return to_ticks(price.cast(MONEY), tick)


def to_price(ticks: Column, tick: Column) -> Column:
    return ticks.cast("decimal(20,0)") * tick.cast(MONEY)

"""Every operator as a query over the driver's tables: (spark, sf_dir) -> DataFrame. Their SQL is in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.ticks import TickTable, to_price, to_ticks
from tickloom.harness import lines
from tickloom.operators import features, selection, summary
from tickloom.operators.sequencing import assign_sequences
from tickloom.schema import BOOK_FIELDS, QUOTE, TRADE
from tickloom.scratch import scratch_path
from tickloom.sources import capture, chart_json, csv, store
from tickloom.sources.driver_tables import pending_from_events
from tickloom.streaming.features import stateful_series
from tickloom.streaming.replay import replay_stream

#: A range that holds part of the events at every scale.
FROM_NS, TO_NS = 1_704_100_000_000_000_000, 1_705_000_000_000_000_000


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_sequences(pending_from_events(spark, sf_dir))


def tick_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' and line items' prices in ticks of their priority or flag: some configured, the rest by default."""
    ticks = TickTable.from_toml('default_tick = "0.01"\n[symbols]\n"1-URGENT" = "0.05"\nR = "0.25"\n')
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("part"), F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("price"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("part"), F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("price"))
    sized = ticks.tick_of(orders.unionByName(items)).withColumn("ticks", to_ticks(F.col("price"), F.col("tick")))
    return sized.select("id", "part", "symbol", "ticks", to_price(F.col("ticks"), F.col("tick")).cast("decimal(20,2)").cast("double").alias("tick_price"))


def replay_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.read_events(canonical_events(spark, sf_dir), FROM_NS, TO_NS)


def replay_range_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.read_events(canonical_events(spark, sf_dir))


def events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_events(canonical_events(spark, sf_dir), 100, 5000, "s3", 250)


def events_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.tail(canonical_events(spark, sf_dir), 900, 50)


def meta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.meta(canonical_events(spark, sf_dir)).withColumn("symbols", F.array_join("symbols", ","))


def symbol_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.symbols(canonical_events(spark, sf_dir))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(canonical_events(spark, sf_dir))


def book_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_book(canonical_events(spark, sf_dir)).select("sequence", "symbol", *(F.col(f"book_{c}").alias(c) for c in BOOK_FIELDS))


def mid_spread_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_quote_features(features.with_book(canonical_events(spark, sf_dir)))
    return df.select("sequence", "symbol", "raw_mid", "spread", F.round("imbalance", 6).alias("imbalance"))


def rolling_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_rolling_mid(features.with_quote_features(features.with_book(canonical_events(spark, sf_dir))), 8)
    return df.select("sequence", "symbol", F.round("mid", 6).alias("mid"))


def rounded(points: DataFrame) -> DataFrame:
    """Doubles to six places, as the SQL has them."""
    return points.select(*(F.round(c, 6).alias(c) if c in ("mid", "imbalance", "vol") else F.col(c) for c in points.columns))


def ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.series(canonical_events(spark, sf_dir)).select("sequence", "symbol", "vol"))


def series_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.series(canonical_events(spark, sf_dir)))


def series_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a page start cold, so the page comes first."""
    return rounded(features.series(selection.select_events(canonical_events(spark, sf_dir), from_seq=200, limit=500)))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.signals(canonical_events(spark, sf_dir)))


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_lines(canonical_events(spark, sf_dir))


def stride_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stride_index(canonical_events(spark, sf_dir), 64)


def index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries found for each of a few times: before all, inside, after all."""
    index = stride_index(spark, sf_dir)
    found = [selection.index_seek(index, t).withColumn("from_ns", F.lit(t).cast("long")) for t in (0, FROM_NS, TO_NS, 2 * TO_NS)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def replay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.replay_schedule(canonical_events(spark, sf_dir), 2.0)


def replay_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.due_by(selection.replay_schedule(canonical_events(spark, sf_dir), 4.0), 86_400_000_000_000)


def parser_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log against one whose 500th trade or later has another price."""
    events = canonical_events(spark, sf_dir)
    changed = events.withColumn("price_ticks", F.when(F.col("sequence") >= 500, F.col("price_ticks") + 1).otherwise(F.col("price_ticks")))
    return summary.parser_diff(events, changed)


def parser_diff_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = canonical_events(spark, sf_dir)
    return summary.parser_diff(events, events.where("sequence <= 700"))


def parser_diff_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = canonical_events(spark, sf_dir)
    return summary.parser_diff(events, events.repartition(5))


def determinism_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.determinism_report(canonical_events(spark, sf_dir))


def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one-sided orders: the flag says bid, ask or, as a trade, neither."""
    items = _items(spark, sf_dir)
    adds = items.select(
        (F.col("l_orderkey") * 64 + F.col("position")).alias("ingest_order"), F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "bid").when(F.col("l_returnflag") == "A", "ask").alias("side"),
        to_ticks(F.col("l_extendedprice"), F.lit("0.01")).alias("price"), F.col("l_quantity").cast("long").alias("size"),
    )
    return features.top_of_book(adds).where(F.col("side").isNotNull()).select("ingest_order", "symbol", *BOOK_FIELDS)


def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders by priority, written as chart JSON and decoded again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice").cast("double")
    day = F.unix_seconds(F.col("o_orderdate").cast("date").cast("timestamp"))
    bars = orders.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("day")).agg(
        F.max_by(price, "o_orderkey").alias("close"), F.min(price).alias("low"), F.max(price).alias("high"), F.count("*").alias("volume")
    )
    listed = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "close", "low", "high", "volume"))).alias("b"))
    quote = F.struct(*(F.col(f"b.{c}").alias(c) for c in ("close", "high", "low", "volume")))
    result = F.struct(F.col("b.day").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    raw = listed.select(F.substring("symbol", 1, 1).cast("int").alias("symbol_pos"), "symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("raw"))
    return assign_sequences(chart_json.events(raw, "X", TickTable.uniform()))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their position in the order, as line numbers repeat: an arrival order without ties or a global sort."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("position", F.row_number().over(at))


def _big(c: str, size: int):
    """A non-negative long, big-endian."""
    return F.unhex(F.lpad(F.hex(c), 2 * size, "0"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packets: some orders, some trades, and by turns each fault of a frame or message."""
    items = _items(spark, sf_dir)
    rows = items.select(
        (F.col("l_orderkey") * 64 + F.col("position")).alias("packet_index"), (F.col("l_orderkey") * 1000 + F.col("position")).alias("ts"),
        F.rpad(F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")), 8, " ").alias("name"), F.col("l_returnflag").alias("flag"),
        to_ticks(F.col("l_extendedprice"), F.lit("0.01")).alias("price"), F.col("l_quantity").cast("long").alias("size"), ((F.col("l_orderkey") * 64 + F.col("position")) % 101).alias("turn"),
    )
    side = F.when(F.col("flag") == "R", F.unhex(F.lit("00"))).when(F.col("flag") == "A", F.unhex(F.lit("01")))
    add = F.concat(_big("ts", 8), F.unhex(F.lit("00000001")), F.col("name").cast("binary"), side, _big("price", 8), _big("size", 8))
    trade = F.concat(_big("ts", 8), F.unhex(F.lit("00000002")), F.col("name").cast("binary"), _big("price", 8), _big("size", 8))
    message = F.when(F.col("turn") == 7, F.unhex(F.lit("0001"))).when(F.col("turn") == 8, F.concat(_big("ts", 8), F.unhex(F.lit("00000009")))).when(side.isNotNull(), add).otherwise(trade)
    message = F.when(F.col("turn") == 9, F.concat(message, F.unhex(F.lit("00")))).otherwise(message)
    rows = rows.withColumn("m", message).withColumn("udp_length", (F.length("m") + 8).cast("long"))
    length = F.when(F.col("turn") == 5, F.lit(7).cast("long")).when(F.col("turn") == 6, F.col("udp_length") + 1).otherwise(F.col("udp_length"))
    rows = rows.withColumn("udp_length", length)
    hexed = lambda text, turn, other: F.unhex(F.when(F.col("turn") == turn, other).otherwise(text))
    data = F.concat(
        F.unhex(F.lit("01005e010203020000000001")), hexed("0800", 1, "86dd"), hexed("45", 2, "65"), F.unhex(F.lit("00" * 8)), hexed("11", 3, "06"), F.unhex(F.lit("00" * 10)),
        F.unhex(F.lit("9c40c350")), _big("udp_length", 2), F.unhex(F.lit("0000")), "m",
    )
    return rows.withColumn("data", F.when(F.col("turn") == 0, F.substring(data, 1, 10)).when(F.col("turn") == 4, F.substring(data, 1, 38)).otherwise(data)).select("packet_index", "data")


def itch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture.decoded(_frames(spark, sf_dir)).where(F.col("message").isNotNull())
    return found.select("packet_index", "message.*")


def frame_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.issues(capture.decoded(_frames(spark, sf_dir)))


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_sequences(capture.pending_events(capture.decoded(_frames(spark, sf_dir)), "X"))


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture.decoded(_frames(spark, sf_dir))
    return found.agg(F.count("message").alias("events"), F.count("fault").alias("issues"))


def _csv(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The events table in a CSV layout, written and ingested. One file: its rows' order is part of the data."""
    rows = pending_from_events(spark, sf_dir).withColumn("order", F.col("ingest_order"))
    price = lambda c: (F.col(c).cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    moment = F.date_format(F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    millis = F.expr("timestamp_ns div 1000000").cast("string")
    text = lambda c: F.col(c).cast("string")
    fields = {
        "a": {"timestamp": moment, "symbol": F.col("symbol"), "bid_px": price("bid_px"), "bid_sz": text("bid_sz"), "ask_px": price("ask_px"), "ask_sz": text("ask_sz")},
        "b": {"timestamp_ms": millis, "symbol": F.col("symbol"), "price": price("price_ticks"), "size": text("size")},
        "c": {"timestamp": F.when(F.col("kind") == TRADE, millis).otherwise(moment), "symbol": F.col("symbol"), "type": F.when(F.col("kind") == TRADE, "TRADE").otherwise("Quote"), "price": price("price_ticks"), "size": text("size"), "bid_px": price("bid_px"), "bid_sz": text("bid_sz"), "ask_px": price("ask_px"), "ask_sz": text("ask_sz")},
    }[layout]
    kept = {"a": F.col("kind") == QUOTE, "b": F.col("kind") == TRADE, "c": F.lit(True)}[layout]
    path = scratch_path(spark, f"csv-{layout}")
    rows.where(kept).select("order", *(v.alias(f"_{k}") for k, v in fields.items())).coalesce(1).sortWithinPartitions("order").select(*(F.col(f"_{k}").alias(k) for k in fields)).write.csv(path, header=True)
    return csv.ingest(spark, layout, path, "X")


def csv_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir, "a")


def csv_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir, "b")


def csv_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir, "c")


def p99_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the gaps in time between events that follow each other; sequences have no gaps, so each meets the one before by number."""
    events = canonical_events(spark, sf_dir).select("sequence", "timestamp_ns")
    before = events.select((F.col("sequence") + 1).alias("sequence"), F.col("timestamp_ns").alias("before_ns"))
    gaps = events.join(before, "sequence").select((F.col("timestamp_ns") - F.col("before_ns")).alias("gap"))
    return selection.nearest_rank(gaps, "gap").withColumnRenamed("value", "p99")


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a log and read back."""
    path = scratch_path(spark, "log")
    store.write_events(canonical_events(spark, sf_dir), path, 5000)
    return selection.time_range(store.read_log(spark, path), FROM_NS, TO_NS)


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the log, replayed in micro-batches as fast as it goes, by features with state."""
    path, out, marks = (scratch_path(spark, f"stream-{x}") for x in ("log", "out", "marks"))
    store.write_events(canonical_events(spark, sf_dir), path)
    points = stateful_series(replay_stream(spark, path, max_speed=True, rows_per_batch=50_000))
    query = points.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
    query.processAllAvailable()
    query.stop()
    return rounded(spark.read.parquet(out).where(F.col("signal").isNotNull()))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_events, tick_conversion, replay_range, replay_range_unbounded, events_page, events_tail, meta_summary, symbol_dictionary, event_lines, book_state,
        mid_spread_imbalance, rolling_mid, ewma_vol, series_full, series_slice, signals, feature_lines, stride_index, index_seek, replay_schedule, replay_due,
        parser_diff, parser_diff_shorter, parser_diff_equal, determinism_report, top_of_book, chart_bars, itch_roundtrip, frame_issues, capture_events, ingest_counts,
        csv_a, csv_b, csv_c, p99_nearest_rank, log_roundtrip, stream_features,
    )
}

"""The same queries in SQL, over the driver's tables."""

from __future__ import annotations

from tickloom.plans.queries import FROM_NS, TO_NS

EVENTS = """
raw AS (
    SELECT event_id AS ingest_order, epoch_us(ts) * 1000 AS timestamp_ns, 'S' || (user_id % 8) AS symbol,
           event_type IN ('purchase', 'click') AS is_trade, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           10000 + CAST(round(CAST(value AS DECIMAL(20,10)) / CAST('0.01' AS DECIMAL(20,10)), 0) AS BIGINT) % 1000 AS px
    FROM events),
pending AS (
    SELECT ingest_order, timestamp_ns, 'X' AS venue, symbol, CASE WHEN is_trade THEN 'trade' ELSE 'quote' END AS kind,
           CASE WHEN is_trade THEN px END AS price_ticks, CASE WHEN is_trade THEN k + 1 END AS size,
           CASE WHEN NOT is_trade THEN CASE WHEN k % 17 = 0 THEN 0 ELSE px END END AS bid_px, CASE WHEN NOT is_trade THEN k + 1 END AS bid_sz,
           CASE WHEN NOT is_trade THEN px + 1 + k % 40 END AS ask_px, CASE WHEN NOT is_trade THEN 100 - k END AS ask_sz
    FROM raw)"""
FIELDS = "timestamp_ns, venue, symbol, kind, price_ticks, size, bid_px, bid_sz, ask_px, ask_sz"


def numbered(source: str = "pending", name: str = "log") -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY timestamp_ns, ingest_order, symbol, venue) AS sequence, {FIELDS} FROM {source})"


LOG = f"WITH RECURSIVE {EVENTS}, {numbered()}"
ALL = f"SELECT sequence, {FIELDS}"


def series(source: str = "log") -> str:
    """CTEs up to `points`. The volatility steps from update to update of a symbol."""
    return f"""
book AS (
    SELECT *, coalesce(last_value(bid_px IGNORE NULLS) OVER w, 0) AS bp, coalesce(last_value(bid_sz IGNORE NULLS) OVER w, 0) AS bs,
           coalesce(last_value(ask_px IGNORE NULLS) OVER w, 0) AS ap, coalesce(last_value(ask_sz IGNORE NULLS) OVER w, 0) AS az
    FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
quoted AS (
    SELECT *, CASE WHEN bp > 0 AND ap > 0 THEN (CAST(bp AS DOUBLE) + ap) * 0.5 WHEN kind = 'trade' THEN CAST(price_ticks AS DOUBLE) ELSE 0.0 END AS raw_mid,
           CASE WHEN bp > 0 AND ap > 0 THEN ap - bp ELSE 0 END AS spread,
           CASE WHEN bs + az = 0 THEN 0.0 ELSE CAST(bs - az AS DOUBLE) / (bs + az) END AS imbalance
    FROM book),
counted AS (
    SELECT *, CASE WHEN raw_mid > 0 THEN raw_mid END AS pm, count(CASE WHEN raw_mid > 0 THEN 1 END) OVER w AS n
    FROM quoted WINDOW w AS (PARTITION BY symbol ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
rolled AS (
    SELECT *, coalesce(avg(pm) OVER (PARTITION BY symbol ORDER BY n RANGE BETWEEN 7 PRECEDING AND CURRENT ROW), raw_mid) AS mid,
           last_value(pm IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM counted),
moved AS (SELECT symbol, n, ln(pm / prev) ** 2 AS r2 FROM rolled WHERE pm IS NOT NULL),
steps(symbol, n, v) AS (
    SELECT symbol, n, CAST(0.0 AS DOUBLE) FROM moved WHERE r2 IS NULL
    UNION ALL
    SELECT m.symbol, m.n, 0.2 * m.r2 + 0.8 * s.v FROM steps s JOIN moved m ON m.symbol = s.symbol AND m.n = s.n + 1),
points AS (
    SELECT r.sequence, r.timestamp_ns, r.symbol, r.mid, r.spread, r.imbalance, sqrt(coalesce(s.v, 0)) AS vol,
           nullif(concat_ws('|', CASE WHEN spread > 25 THEN 'spread' END, CASE WHEN abs(imbalance) > 0.7 THEN 'imb' END,
                                 CASE WHEN sqrt(coalesce(s.v, 0)) > 0.03 THEN 'vol' END), '') AS signal
    FROM rolled r LEFT JOIN steps s ON s.symbol = r.symbol AND s.n = r.n)"""


POINTS = "SELECT sequence, timestamp_ns, symbol, round(mid, 6) AS mid, spread, round(imbalance, 6) AS imbalance, round(vol, 6) AS vol, signal FROM points"
LINE = """CASE WHEN kind = 'trade' THEN sequence || ' ' || timestamp_ns || ' ' || venue || ' ' || symbol || ' trade px=' || price_ticks || ' sz=' || size
     ELSE sequence || ' ' || timestamp_ns || ' ' || venue || ' ' || symbol || ' quote bid=' || bid_px || 'x' || bid_sz || ' ask=' || ask_px || 'x' || ask_sz END"""


def diff(right: str) -> str:
    """The log against `right`, a query of the same columns."""
    columns = f"sequence, {FIELDS}"
    return f"""{LOG}, other AS ({right}),
l AS (SELECT row_number() OVER (ORDER BY sequence) AS pos, row({columns}) AS e, sequence AS seq, timestamp_ns AS ts, symbol AS sym, venue AS ven, {LINE} AS line FROM log),
r AS (SELECT row_number() OVER (ORDER BY sequence) AS pos, row({columns}) AS e, sequence AS seq, timestamp_ns AS ts, symbol AS sym, venue AS ven, {LINE} AS line FROM other),
both_sides AS (
    SELECT coalesce(l.pos, r.pos) AS pos, l.seq AS left_sequence, r.seq AS right_sequence, l.line AS left_line, r.line AS right_line,
           CASE WHEN l.pos IS NULL THEN 'left missing event' WHEN r.pos IS NULL THEN 'right missing event' WHEN l.seq <> r.seq THEN 'sequence mismatch'
                WHEN l.ts <> r.ts THEN 'timestamp mismatch' WHEN l.sym <> r.sym THEN 'symbol mismatch' WHEN l.ven <> r.ven THEN 'venue mismatch'
                WHEN l.e IS DISTINCT FROM r.e THEN 'payload mismatch' END AS reason
    FROM l FULL JOIN r ON l.pos = r.pos),
first_bad AS (SELECT * FROM both_sides WHERE reason IS NOT NULL ORDER BY pos LIMIT 1),
sizes AS (SELECT (SELECT count(*) FROM l) AS left_events, (SELECT count(*) FROM r) AS right_events)
SELECT f.pos IS NULL AS ok, left_events, right_events, coalesce(f.pos - 1, greatest(left_events, right_events)) AS matched_prefix, f.pos AS mismatch_index,
       f.left_sequence, f.right_sequence, f.reason, f.left_line, f.right_line
FROM sizes LEFT JOIN first_bad f ON true"""


PACKETS = """
item AS (
    SELECT l_orderkey * 64 + position AS packet_index, l_orderkey * 1000 + position AS ts, 'P' || (l_partkey % 50) AS symbol, l_returnflag AS flag,
           CAST(round(CAST(l_extendedprice AS DECIMAL(20,10)) * 100, 0) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS size, (l_orderkey * 64 + position) % 101 AS turn,
           CASE l_returnflag WHEN 'R' THEN 'bid' WHEN 'A' THEN 'ask' END AS side
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position FROM lineitem))"""
BOOK = """coalesce(last_value(CASE WHEN side = 'bid' THEN price END IGNORE NULLS) OVER w, 0) AS bid_px, coalesce(last_value(CASE WHEN side = 'bid' THEN size END IGNORE NULLS) OVER w, 0) AS bid_sz,
       coalesce(last_value(CASE WHEN side = 'ask' THEN price END IGNORE NULLS) OVER w, 0) AS ask_px, coalesce(last_value(CASE WHEN side = 'ask' THEN size END IGNORE NULLS) OVER w, 0) AS ask_sz"""
ARRIVAL = "WINDOW w AS (PARTITION BY symbol ORDER BY packet_index ROWS UNBOUNDED PRECEDING)"
FAULTS = """
faults AS (
    SELECT packet_index,
           CASE turn WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 14 WHEN 3 THEN 23 WHEN 4 THEN 34 WHEN 5 THEN 38 WHEN 6 THEN 38 WHEN 7 THEN 0 WHEN 8 THEN 8
                     ELSE CASE WHEN side IS NULL THEN 36 ELSE 37 END END AS "offset",
           CASE turn WHEN 0 THEN 'short ethernet header' WHEN 1 THEN 'unsupported ethertype 0x86dd' WHEN 2 THEN 'unsupported ip version 6' WHEN 3 THEN 'non-udp protocol 6'
                     WHEN 4 THEN 'short udp header' WHEN 5 THEN 'invalid udp length' WHEN 6 THEN 'truncated udp payload' WHEN 7 THEN 'short packet need 8 bytes'
                     WHEN 8 THEN 'unknown message type 9' ELSE 'trailing bytes' END AS detail
    FROM item WHERE turn < 10)"""
SEEK = " UNION ALL ".join(
    f"SELECT coalesce((SELECT max(sequence) FROM idx WHERE timestamp_ns < {t}), (SELECT min(sequence) FROM idx)) AS sequence, CAST({t} AS BIGINT) AS from_ns" for t in (0, FROM_NS, TO_NS, 2 * TO_NS)
)
SCHEDULE = "schedule AS (SELECT sequence, timestamp_ns, CAST(floor(CAST(timestamp_ns - first_value(timestamp_ns) OVER (ORDER BY sequence) AS DOUBLE) / {speed}) AS BIGINT) AS due_ns FROM log)"


def csv(where: str, time: str = "timestamp_ns") -> str:
    fields = FIELDS.replace("timestamp_ns,", f"{time} AS timestamp_ns,", 1)
    return f"WITH {EVENTS}, written AS (SELECT row_number() OVER (ORDER BY ingest_order) - 1 AS ingest_order, {fields} FROM pending WHERE {where}), {numbered('written')} {ALL} FROM log"


SQL = {
    "canonical_events": f"{LOG} {ALL} FROM log",
    "tick_conversion": """
WITH price AS (
    SELECT o_orderkey AS id, 0 AS part, o_orderpriority AS symbol, o_totalprice AS p FROM orders
    UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem),
sized AS (SELECT *, CASE symbol WHEN '1-URGENT' THEN 5 WHEN 'R' THEN 25 ELSE 1 END AS cents FROM price),
cents AS (SELECT id, part, symbol, cents, CAST(round(CAST(p AS DECIMAL(20,10)) * 100, 0) AS BIGINT) AS c FROM sized)
SELECT id, CAST(part AS BIGINT) AS part, symbol, (2 * c + cents) // (2 * cents) AS ticks, CAST(CAST((2 * c + cents) // (2 * cents) * cents AS DECIMAL(20,2)) / 100 AS DOUBLE) AS tick_price FROM cents""",
    "replay_range": f"{LOG} {ALL} FROM log WHERE timestamp_ns BETWEEN {FROM_NS} AND {TO_NS}",
    "replay_range_unbounded": f"{LOG} {ALL} FROM log",
    "events_page": f"{LOG} {ALL} FROM log WHERE sequence BETWEEN 100 AND 5000 AND lower(symbol) = 's3' ORDER BY sequence LIMIT 250",
    "events_tail": f"{LOG} {ALL} FROM log WHERE sequence <= 900 ORDER BY sequence DESC LIMIT 50",
    "meta_summary": f"""{LOG} SELECT count(*) AS events, count(*) FILTER (WHERE kind = 'trade') AS trades, count(*) FILTER (WHERE kind = 'quote') AS quotes,
       arg_min(timestamp_ns, sequence) AS first_timestamp_ns, arg_max(timestamp_ns, sequence) AS last_timestamp_ns, min(sequence) AS first_sequence,
       max(sequence) AS last_sequence, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM log""",
    "symbol_dictionary": f"{LOG} SELECT DISTINCT symbol FROM log",
    "event_lines": f"{LOG} SELECT sequence, {LINE} AS line FROM log",
    "book_state": f"{LOG}, {series()} SELECT sequence, symbol, bp AS bid_px, bs AS bid_sz, ap AS ask_px, az AS ask_sz FROM book",
    "mid_spread_imbalance": f"{LOG}, {series()} SELECT sequence, symbol, raw_mid, spread, round(imbalance, 6) AS imbalance FROM quoted",
    "rolling_mid": f"{LOG}, {series()} SELECT sequence, symbol, round(mid, 6) AS mid FROM rolled",
    "ewma_vol": f"{LOG}, {series()} SELECT sequence, symbol, round(vol, 6) AS vol FROM points",
    "series_full": f"{LOG}, {series()} {POINTS}",
    "series_slice": f"{LOG}, part AS (SELECT * FROM log WHERE sequence >= 200 ORDER BY sequence LIMIT 500), {series('part')} {POINTS}",
    "signals": f"{LOG}, {series()} {POINTS} WHERE signal IS NOT NULL",
    "stream_features": f"{LOG}, {series()} {POINTS} WHERE signal IS NOT NULL",
    "feature_lines": f"""{LOG}, {series()} SELECT sequence, format('{{}} {{}} {{}} mid={{:.6f}} spread={{}} imb={{:.6f}} vol={{:.6f}} signal={{}}', sequence, timestamp_ns, symbol, mid, spread, imbalance, vol, signal) AS line
       FROM points WHERE signal IS NOT NULL""",
    "stride_index": f"{LOG} SELECT timestamp_ns, sequence FROM log WHERE (sequence - 1) % 64 = 0",
    "index_seek": f"{LOG}, idx AS (SELECT timestamp_ns, sequence FROM log WHERE (sequence - 1) % 64 = 0) {SEEK}",
    "replay_schedule": f"{LOG}, {SCHEDULE.format(speed='2.0')} SELECT * FROM schedule",
    "replay_due": f"{LOG}, {SCHEDULE.format(speed='4.0')} SELECT * FROM schedule WHERE due_ns <= 86400000000000",
    "parser_diff": diff(f"SELECT sequence, {FIELDS.replace('price_ticks', 'CASE WHEN sequence >= 500 THEN price_ticks + 1 ELSE price_ticks END AS price_ticks', 1)} FROM log"),
    "parser_diff_shorter": diff(f"{ALL} FROM log WHERE sequence <= 700"),
    "parser_diff_equal": diff(f"{ALL} FROM log"),
    "determinism_report": f"{LOG}, {series()} SELECT true AS ok, count(*) FILTER (WHERE signal IS NOT NULL) AS lines, CAST(NULL AS BIGINT) AS first_mismatch_line FROM points",
    "top_of_book": f"WITH {PACKETS}, booked AS (SELECT packet_index AS ingest_order, symbol, side, {BOOK} FROM item {ARRIVAL}) SELECT ingest_order, symbol, bid_px, bid_sz, ask_px, ask_sz FROM booked WHERE side IS NOT NULL",
    "chart_bars": f"""
WITH bar AS (
    SELECT o_orderpriority AS symbol, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS day, arg_max(o_totalprice, o_orderkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS v
    FROM orders GROUP BY ALL),
cents AS (SELECT symbol, day * 1000000000 AS timestamp_ns, v, CAST(round(CAST(c AS DECIMAL(20,10)) * 100, 0) AS BIGINT) AS c, CAST(round(CAST(lo AS DECIMAL(20,10)) * 100, 0) AS BIGINT) AS lo, CAST(round(CAST(hi AS DECIMAL(20,10)) * 100, 0) AS BIGINT) AS hi FROM bar),
pending AS (
    SELECT symbol || '0' AS ingest_order, timestamp_ns, 'X' AS venue, symbol, 'trade' AS kind, c AS price_ticks, v AS size, NULL AS bid_px, NULL AS bid_sz, NULL AS ask_px, NULL AS ask_sz FROM cents
    UNION ALL SELECT symbol || '1', timestamp_ns, 'X', symbol, 'quote', NULL, NULL, lo, v, hi, v FROM cents),
{numbered()} {ALL} FROM log""",
    "itch_roundtrip": f"WITH {PACKETS} SELECT packet_index, ts AS timestamp_ns, symbol, side, price, size FROM item WHERE turn >= 10",
    "frame_issues": f"WITH {PACKETS}, {FAULTS} SELECT * FROM faults",
    "capture_events": f"""WITH {PACKETS}, booked AS (SELECT packet_index AS ingest_order, ts AS timestamp_ns, symbol, side, price, item.size AS size, {BOOK} FROM item WHERE turn >= 10 {ARRIVAL}),
pending AS (SELECT ingest_order, timestamp_ns, 'X' AS venue, symbol, CASE WHEN side IS NULL THEN 'trade' ELSE 'quote' END AS kind, CASE WHEN side IS NULL THEN price END AS price_ticks,
       CASE WHEN side IS NULL THEN size END AS size, CASE WHEN side IS NOT NULL THEN bid_px END AS bid_px, CASE WHEN side IS NOT NULL THEN bid_sz END AS bid_sz,
       CASE WHEN side IS NOT NULL THEN ask_px END AS ask_px, CASE WHEN side IS NOT NULL THEN ask_sz END AS ask_sz FROM booked),
{numbered()} {ALL} FROM log""",
    "ingest_counts": f"WITH {PACKETS} SELECT count(*) FILTER (WHERE turn >= 10) AS events, count(*) FILTER (WHERE turn < 10) AS issues FROM item",
    "csv_a": csv("kind = 'quote'"),
    "csv_b": csv("kind = 'trade'", "timestamp_ns // 1000000 * 1000000"),
    "csv_c": csv("true", "CASE WHEN kind = 'trade' THEN timestamp_ns // 1000000 * 1000000 ELSE timestamp_ns END"),
    "p99_nearest_rank": f"""{LOG}, between_ AS (SELECT timestamp_ns - lag(timestamp_ns) OVER (ORDER BY sequence) AS g FROM log),
gap AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM between_ WHERE g IS NOT NULL)
SELECT CAST(g AS BIGINT) AS p99 FROM gap WHERE r = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)""",
    "log_roundtrip": f"{LOG} {ALL} FROM log WHERE timestamp_ns BETWEEN {FROM_NS} AND {TO_NS}",
}

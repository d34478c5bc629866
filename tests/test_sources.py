"""Inputs with known events."""

import json
import random

import pytest

from tickloom.errors import ChecksumError, TickError
from tickloom.functions.ticks import TickTable, text_to_ticks
from tickloom.harness import lines
from tickloom.operators.features import feature_lines
from tickloom.schema import quote_row, trade_row
from tickloom.sources import binary_log, capture, chart_json, csv, store, synthetic
from tickloom.sources.binary_log import Index

CSVS = {
    "a": "timestamp,symbol,bid_px,bid_sz,ask_px,ask_sz\n2025-03-04T14:30:00Z,NOVA,41.07,300,41.11,200\n2025-03-04T14:30:00.250Z,KITE,7.5,40,7.53,60\n2025-03-04T14:30:00.250000001Z,NOVA,41.08,100,41.10,500\n",
    "b": "timestamp_ms,symbol,price,size\n1741098600000,NOVA,41.09,70\n1741098600004,KITE,7.51,11\n1741098600009,NOVA,41.1,35\n",
}
LINES = {
    "a": ["1 1741098600000000000 X NOVA quote bid=4107x300 ask=4111x200", "2 1741098600250000000 X KITE quote bid=750x40 ask=753x60", "3 1741098600250000001 X NOVA quote bid=4108x100 ask=4110x500"],
    "b": ["1 1741098600000000000 X NOVA trade px=4109 sz=70", "2 1741098600004000000 X KITE trade px=751 sz=11", "3 1741098600009000000 X NOVA trade px=4110 sz=35"],
}


def _lines(df):
    return [r.line for r in lines(df).orderBy("sequence").collect()]


@pytest.mark.parametrize("layout", sorted(CSVS))
def test_csv(spark, tmp_path, layout):
    path = tmp_path / "in.csv"
    path.write_text(CSVS[layout])
    assert _lines(csv.ingest(spark, layout, str(path), "X")) == LINES[layout]


@pytest.mark.parametrize("row", ["2025-03-04T14:30:00Z,A,1,1,2", "2025-03-04T14:30:00Z,A,1,x,2,1", "1969-12-31T23:59:59Z,A,1,1,2,1"])
def test_bad_csv_rows_raise(spark, tmp_path, row):
    path = tmp_path / "in.csv"
    path.write_text(CSVS["a"].split("\n")[0] + "\n" + row + "\n")
    with pytest.raises(Exception):
        csv.ingest(spark, "a", str(path), "X").collect()


def test_ticks(spark):
    from pyspark.sql import functions as F

    rows = [("1.025", "0.05", 21), ("1.024", "0.05", 20), ("-1.025", "0.05", -21), ("100.01", "0.01", 10001), ("100.01", "0.05", 2000)]
    df = spark.createDataFrame(rows, "p string, t string, want long")
    assert df.where(text_to_ticks(F.col("p"), F.col("t").cast("decimal(20,10)")) != F.col("want")).count() == 0
    with pytest.raises(TickError):
        TickTable.uniform("0")


def test_chart_bars(spark):
    quote = {"close": [None, 41.5], "high": [None, 41.75], "low": [None, 41.25], "volume": [None, 320]}
    raw = json.dumps({"chart": {"result": [{"timestamp": [1741098540, 1741098600], "indicators": {"quote": [quote]}}], "error": None}})
    assert _lines(chart_json.ingest(chart_json.charts(spark, [(0, "NOVA", raw)]), "X")) == ["1 1741098600000000000 X NOVA trade px=4150 sz=320", "2 1741098600000000000 X NOVA quote bid=4125x320 ask=4175x320"]


def test_order_feed(spark):
    # Time, type 2, symbol, price, size; time, type 1, symbol, side, price, size.
    sent = ["00000000000003e8" "00000002" "4e4f564120202020" "00000000000009c4" "000000000000001e", "00000000000003e9" "00000001" "4b49544520202020" "01" "0000000000000a28" "0000000000000028"]
    assert synthetic.trade(1000, "NOVA", 2500, 30).hex() == sent[0] and synthetic.add_order(1001, "KITE", 1, 2600, 40).hex() == sent[1]
    packets = spark.createDataFrame([(k + 1, bytearray(synthetic.frame(bytes.fromhex(x)))) for k, x in enumerate(sent)] + [(3, bytearray(b"\x01\x02\x03"))], "packet_index long, data binary")
    found = capture.decoded(packets)
    assert [tuple(r) for r in found.where("message IS NOT NULL").select("message.*").collect()] == [(1000, "NOVA", None, 2500, 30), (1001, "KITE", "ask", 2600, 40)]
    assert [tuple(r)[:2] for r in capture.issues(found).collect()] == [(3, 0)]


def test_frame_faults(spark):
    """Each fault of a frame, worked into one that is well formed."""
    good = synthetic.frame(synthetic.trade(1, "NOVA", 1, 1))
    cases = {
        "short ethernet header": good[:13], "unsupported ethertype 0x86dd": good[:12] + b"\x86\xdd" + good[14:], "short ipv4 header": good[:33],
        "unsupported ip version 6": good[:14] + b"\x65" + good[15:], "invalid ipv4 ihl": good[:14] + b"\x44" + good[15:], "truncated ipv4 header": good[:14] + b"\x4f" + good[15:40],
        "non-udp protocol 6": good[:23] + b"\x06" + good[24:], "short udp header": good[:41], "invalid udp length": good[:38] + b"\x00\x07" + good[40:], "truncated udp payload": good[:-1],
    }
    packets = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(cases.values())], "packet_index long, data binary")
    found = {r.packet_index: r.detail for r in capture.issues(capture.decoded(packets)).collect()}
    assert [found[k] for k in range(len(cases))] == list(cases)


def test_any_bytes_decode_or_are_an_issue(spark):
    draw = random.Random(5)
    good = synthetic.frame(synthetic.add_order(1, "NOVA", 0, 1, 1))
    data = [draw.randbytes(draw.randrange(120)) for _ in range(300)]
    data += [bytes(x if draw.random() > 0.05 else draw.randrange(256) for x in good[: draw.randrange(len(good) + 1)]) for _ in range(300)]
    found = capture.decoded(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)], "packet_index long, data binary"))
    decoded = {r.packet_index for r in found.where("message IS NOT NULL").select("packet_index").collect()}
    assert decoded ^ {r.packet_index for r in capture.issues(found).collect()} == set(range(len(data))) and len(decoded) < len(data)


def test_checksum():
    header = synthetic.frame(b"")[14:34]
    assert synthetic.checksum(header) == 0 and synthetic.checksum(header[:10] + b"\0\0" + header[12:]) == int.from_bytes(header[10:12], "big")


def test_capture_file(spark, tmp_path):
    path, symbols = str(tmp_path / "x.pcap"), ["NOVA", "KITE"]
    synthetic.generate_capture(path, symbols, 2000)
    sent = synthetic.feed(symbols, 2000)
    faulty = [k for k, p in enumerate(sent, 1) if p.fault]
    assert {p.fault for p in sent} == {None, *synthetic.FAULTS} and sent == synthetic.feed(symbols, 2000)
    events, issues = capture.ingest(spark, path, "X")
    times = [r.timestamp_ns for r in events.orderBy("sequence").collect()]
    assert len(times) == 2000 - len(faulty) and times == sorted(times) and sorted(r.packet_index for r in issues.collect()) == faulty


EVENTS = [quote_row(1, 1, "X", "NOVA", 300, 25, 330, 75), quote_row(2, 2, "X", "NOVA", 300, 25, 336, 25), trade_row(3, 3, "X", "NOVA", 320, 10)]


def _events(spark):
    return spark.createDataFrame(EVENTS, "sequence long, timestamp_ns long, venue string, symbol string, kind string, price_ticks long, size long, bid_px long, bid_sz long, ask_px long, ask_sz long")


def test_features(spark):
    # Mids 315, 318, 318; the return is ln(318 / 315) = 0.009479, its share in the variance 0.2, then 0.8 of that.
    assert [r.line for r in feature_lines(_events(spark)).orderBy("sequence").collect()] == [
        "1 1 NOVA mid=315.000000 spread=30 imb=-0.500000 vol=0.000000 signal=spread",
        "2 2 NOVA mid=316.500000 spread=36 imb=0.000000 vol=0.004239 signal=spread",
        "3 3 NOVA mid=317.000000 spread=36 imb=0.000000 vol=0.003791 signal=spread",
    ]


def test_binary_log(spark, tmp_path):
    path = tmp_path / "x.log"
    binary_log.write_binary_log(_events(spark), str(path))
    assert [tuple(r) for r in binary_log.read_binary_log(spark, str(path)).orderBy("sequence").select(*_events(spark).columns).collect()] == EVENTS
    raw = bytearray(path.read_bytes())
    raw[-1] ^= 1
    with pytest.raises(ChecksumError):
        list(binary_log.records(bytes(raw)))


def test_read_indexed(spark, tmp_path):
    """Any range, with ties at a stride's edge, from the strides that it touches alone."""
    times, path = [10, 20, 20, 20, 20, 30, 45, 45, 60], str(tmp_path / "x.log")
    rows = [trade_row(k, t, "X", "NOVA", k, 1) for k, t in enumerate(times, 1)]
    binary_log.write_binary_log(spark.createDataFrame(rows, _events(spark).schema), path, 2)
    for low, high in ((None, None), (20, 20), (21, 44), (45, 45), (60, 99), (None, 9), (61, None), (11, None)):
        want = [r[0] for r in rows if (low is None or r[1] >= low) and (high is None or r[1] <= high)]
        got = binary_log.read_indexed(spark, path, low, high)
        assert sorted(r.sequence for r in got.collect()) == want
    assert {tuple(r) for r in binary_log.read_indexed(spark, path).collect()} == {tuple(r) for r in binary_log.read_binary_log(spark, path).collect()}


def test_index_seek():
    index = binary_log.read_index(binary_log.pack_index(2, [(70, 1, 40), (90, 3, 160), (90, 5, 280)]))
    assert isinstance(index, Index) and [index.seek(t) for t in (60, 70, 89, 90)] == [40, 40, 40, 280]


def test_log(spark, tmp_path):
    store.write_events(_events(spark), str(tmp_path / "log"))
    assert sorted(tuple(r) for r in store.read_log(spark, str(tmp_path / "log")).select(*_events(spark).columns).collect()) == sorted(EVENTS)

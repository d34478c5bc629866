"""What a user touches first: commands, the HTTP API, replays over the wire, overrides, verification and measurements."""

import json
import threading
from contextlib import contextmanager
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest
from test_sources import CSVS, EVENTS, LINES, _events

from tickloom import api, cli, harness, wire
from tickloom.errors import IngestError, ReplayError
from tickloom.operators.selection import nearest_rank
from tickloom.schema import COLUMNS
from tickloom.sources import store
from tickloom.streaming.replay import ReplayConfig, paced, parse_speed, replay_stream


@contextmanager
def running(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"127.0.0.1:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()


def _rows():
    return [dict(zip(COLUMNS, e)) for e in EVENTS]


def test_wire():
    assert [wire.from_wire(wire.to_wire(r)) for r in _rows()] == _rows()
    for bad in (b"", b"[]", b'{"kind": "other"}', b'{"kind": "trade"}', wire.to_wire(_rows()[0]).replace(b'"bid_px": 300', b'"bid_px": null'), wire.to_wire(_rows()[2]).replace(b'"trade"', b'"quote"')):
        with pytest.raises(IngestError):
            wire.from_wire(bad)


def test_overrides():
    base = ReplayConfig(from_ns=5, speed=2.0)
    assert base.merged(**wire.overrides("")) == base
    assert base.merged(**wire.overrides("from=7&to=9&speed=0.5x&max_speed=true&step=1")) == ReplayConfig(7, 9, 0.5, True, True)
    assert [parse_speed(t) for t in ("2", "2x", " 0.5x ")] == [2.0, 2.0, 0.5]
    for bad in ("0x", "-1", "fast", "nan"):
        with pytest.raises(ReplayError):
            parse_speed(bad)


def test_replay_over_http(spark):
    with running(wire.serve_replay(_events(spark), ReplayConfig(max_speed=True))) as address:
        assert list(wire.subscribe(address)) == _rows()
        assert list(wire.subscribe(address, from_=2, to=2)) == _rows()[1:2]
        for path, status in (("replay?speed=-1", 400), ("replay?from=x", 400), ("other", 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(f"http://{address}/{path}")
            assert e.value.code == status


def test_paced(spark):
    """Waits add up to the events' own times, divided by the speed."""
    now, waits = [0], []

    def sleep(seconds):
        waits.append(round(seconds * 1e9))
        now[0] += waits[-1]

    times = _events(spark).selectExpr("sequence", "(sequence - 1) * 1000 AS timestamp_ns", *COLUMNS[2:])
    assert [r.sequence for r in paced(times, ReplayConfig(speed=2.0), lambda: now[0], sleep)] == [1, 2, 3] and waits == [500, 500]
    assert len(list(paced(times, ReplayConfig(max_speed=True), lambda: now[0], sleep))) == 3 and len(waits) == 2


@pytest.mark.parametrize("options, want", [({"max_speed": True}, [1, 2, 3]), ({"step_mode": True}, [1, 2, 3]), ({"max_speed": True, "from_ns": 2, "to_ns": 2}, [2]), ({"speed": "1000x"}, [1, 2, 3])])
def test_replay_stream(spark, tmp_path, options, want):
    _events(spark).coalesce(1).write.parquet(str(tmp_path / "log"))
    name = f"t{abs(hash(str(options)))}"
    query = replay_stream(spark, str(tmp_path / "log"), **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table(name).count() >= len(want):
                break
    finally:
        query.stop()
    assert sorted(r.sequence for r in spark.table(name).collect()) == want


def test_api(spark):
    served = api.serve(api.Api(_events(spark)), port=0)
    with running(served) as address:
        get = lambda path: json.load(urlopen(f"http://{address}{path}"))
        assert [e["sequence"] for e in get("/api/events?symbol=NOVA&from_seq=2")] == [2, 3]
        assert [p["mid"] for p in get("/api/series?limit=2")] == [315.0, 316.5]
        assert set(get("/api/diff")) == {"determinism", "parser"} and get("/api/meta")
        for path, status in (("/api/none", 404), ("/api/events?limit=x", 400)):
            with pytest.raises(HTTPError) as e:
                get(path)
            assert e.value.code == status
    with pytest.raises(ReplayError):
        api.Api(_events(spark).limit(0))


def _run(spark, *argv):
    cli.run(cli.parser().parse_args([str(a) for a in argv]), spark)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text(CSVS["a"])
    log = tmp_path / "log"
    _run(spark, "ingest-csv-a", "--input", tmp_path / "a.csv", "--venue", "X", "--out", log, "--binary-log", tmp_path / "x.log")
    assert json.loads(capsys.readouterr().out)["events"] == 3 and (tmp_path / "x.log.idx").exists()
    _run(spark, "print", "--log", log, "--out", tmp_path / "lines.txt")
    assert (tmp_path / "lines.txt").read_text().splitlines() == LINES["a"]
    _run(spark, "print", "--log", log, "--from", 1741098600250000001)
    assert capsys.readouterr().out.splitlines() == LINES["a"][2:]
    _run(spark, "serve", "--log", log, "--max-speed")
    assert [json.loads(x)["sequence"] for x in capsys.readouterr().out.splitlines()] == [1, 2, 3]
    store.write_events(_events(spark), str(tmp_path / "wide"))
    _run(spark, "verify", "--log", tmp_path / "wide", "--out", tmp_path / "v.txt")
    assert len(json.loads(capsys.readouterr().out)["sha256"]) == 64 and len((tmp_path / "v.txt").read_text().splitlines()) == 3
    _run(spark, "gen-pcap", "--out", tmp_path / "x.pcap", "--symbols", "NOVA,KITE", "--events", 50)
    _run(spark, "ingest-pcap", "--pcap", tmp_path / "x.pcap", "--schema", "mock_itch", "--venue", "X", "--out", tmp_path / "log2")
    with pytest.raises(IngestError):
        _run(spark, "ingest-pcap", "--pcap", tmp_path / "x.pcap", "--schema", "other", "--venue", "X", "--out", tmp_path / "log3")
    for text in ("8080", "host:port"):
        with pytest.raises(ReplayError):
            cli._address(text)


def test_measure(spark):
    found = harness.measure(_events(spark))
    assert set(found) == {"events_per_sec", "p99_replay_latency_ns", "parse_throughput_events_per_sec"} and all(v > 0 for v in found.values())


@pytest.mark.parametrize("values", [[], [7], [3, 3, 3], list(range(-50, 150)), [-(2**63), 2**63 - 1, 0, 5, 5], [1] * 98 + [10**12, 10**15]])
def test_nearest_rank(spark, values):
    want = sorted(values)[min(int(len(values) * 0.99), len(values) - 1)] if values else 0
    assert nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v").first().value == want

"""python -m tickloom.cli COMMAND: ingest-csv-a, -b, -c, ingest-real, ingest-pcap, gen-pcap, serve, ui, print, feature, verify, bench, subscribe.

Logs are Parquet folders; --binary-log also writes the record-framed file and its index.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tickloom import api, harness, wire
from tickloom.errors import IngestError, ReplayError
from tickloom.functions.ticks import TickTable
from tickloom.operators.features import FeatureConfig, feature_lines
from tickloom.operators.selection import INDEX_STRIDE, read_events
from tickloom.sources import binary_log, capture, chart_json, csv, store, synthetic
from tickloom.streaming.replay import ReplayConfig, paced, parse_speed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tickloom", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        for o in options:
            made.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
        return made

    for layout in csv.LAYOUTS:
        ingest = command(f"ingest-csv-{layout}", "input", "venue", "out", "tick-config?", "binary-log?")
        ingest.add_argument("--index-stride", type=int, default=INDEX_STRIDE)
    real = command("ingest-real", "symbols", "venue", "out", "url", "tick-config?", "binary-log?")
    real.add_argument("--range", default="1d")
    real.add_argument("--interval", default="1m")
    real.add_argument("--index-stride", type=int, default=INDEX_STRIDE)
    pcap = command("ingest-pcap", "pcap", "schema", "venue", "out", "binary-log?")
    pcap.add_argument("--index-stride", type=int, default=INDEX_STRIDE)
    gen = command("gen-pcap", "out", "symbols")
    gen.add_argument("--events", type=int, required=True)
    gen.add_argument("--seed", type=int, default=42)

    def reading(name: str, *options: str) -> argparse.ArgumentParser:
        made = command(name, "log", *options)
        made.add_argument("--from", type=int, dest="from_ns")
        made.add_argument("--to", type=int, dest="to_ns")
        return made

    reading("print", "out?")
    for name in ("feature", "verify"):
        reading(name, "out" if name == "verify" else "out?").add_argument("--seed", type=int, default=42)
    reading("bench")
    serve = reading("serve")
    serve.add_argument("--speed", default="1x")
    serve.add_argument("--max-speed", action="store_true")
    serve.add_argument("--step-mode", action="store_true")
    serve.add_argument("--addr", help="host:port of an HTTP stream; standard output without it")
    client = command("subscribe", "addr", "from?", "to?", "speed?")
    client.add_argument("--max-speed", action="store_true")
    reading("ui", "compare-log?").add_argument("--addr", default="127.0.0.1:8080")
    return top


def _address(text: str) -> tuple[str, int]:
    host, _, port = text.rpartition(":")
    if not host or not port.isdigit():
        raise ReplayError(f"invalid address: {text}")
    return host, int(port)


def _write(events: DataFrame, args: argparse.Namespace) -> None:
    store.write_events(events, args.out)
    log = store.read_log(events.sparkSession, args.out)
    if args.binary_log:
        binary_log.write_binary_log(log, args.binary_log, args.index_stride)
    print(json.dumps({"events": log.count(), "out": args.out}))


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    name = args.command
    if name.startswith("ingest-csv-"):
        _write(csv.ingest(spark, name[-1], args.input, args.venue, TickTable.load(args.tick_config)), args)
    elif name == "ingest-real":
        raw = chart_json.fetch(args.url, chart_json.parse_symbols(args.symbols), args.interval, args.range)
        _write(chart_json.ingest(chart_json.charts(spark, raw), args.venue, TickTable.load(args.tick_config)), args)
    elif name == "ingest-pcap":
        if args.schema != "mock_itch":
            raise IngestError(f"unsupported schema: {args.schema}")
        events, issues = capture.ingest(spark, args.pcap, args.venue)
        _write(events, args)
        print(json.dumps({"issues": issues.count()}))
    elif name == "gen-pcap":
        synthetic.generate_capture(args.out, chart_json.parse_symbols(args.symbols), args.events, args.seed)
    else:
        events = read_events(store.read_log(spark, args.log), args.from_ns, args.to_ns)
        if name == "print":
            harness.write_lines(harness.lines(events), args.out)
        elif name == "feature":
            harness.write_lines(feature_lines(events, FeatureConfig.seeded(args.seed)), args.out)
        elif name == "verify":
            print(json.dumps({"sha256": harness.verify(events, args.seed, args.out)}))
        elif name == "bench":
            print(json.dumps(harness.measure(events)))
        elif name == "serve":
            config = ReplayConfig(speed=parse_speed(args.speed), max_speed=args.max_speed, step_mode=args.step_mode)
            if args.addr:
                wire.serve_replay(events, config, *_address(args.addr)).serve_forever()
            for row in paced(events, config):
                print(wire.to_wire(row.asDict()).decode(), end="", flush=True)
        elif name == "ui":
            other = store.read_log(spark, args.compare_log) if args.compare_log else None
            api.serve(api.Api(events, other), *_address(args.addr)).serve_forever()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "subscribe":
        for event in wire.subscribe(args.addr, from_=getattr(args, "from"), to=args.to, speed=args.speed, max_speed=args.max_speed):
            print(wire.to_wire(event).decode(), end="", flush=True)
        return
    spark = SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run(args, spark)


if __name__ == "__main__":
    main()

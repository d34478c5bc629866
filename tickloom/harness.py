"""Text sinks, verification and measurements."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.errors import NonDeterministic
from tickloom.functions.render import event_line
from tickloom.operators.features import FeatureConfig, feature_lines
from tickloom.operators.selection import nearest_rank, throughput
from tickloom.scratch import scratch_path


def lines(events: DataFrame) -> DataFrame:
    """sequence, line of each event."""
    return events.select("sequence", event_line().alias("line"))


def write_lines(df: DataFrame, out: str | None) -> str:
    """Lines in order, each ended by a line feed, to a file or, without one, to standard output; no lines give one empty line.

    Rows reach the driver one partition at a time. Returns the SHA-256 of what was written.
    """
    digest, first = hashlib.sha256(), True
    sink = Path(out).open("wb") if out else None
    try:
        def put(raw: bytes) -> None:
            digest.update(raw)
            if sink:
                sink.write(raw)
            else:
                print(raw.decode(), end="")

        for row in df.orderBy("sequence").select("line").toLocalIterator(prefetchPartitions=True):
            put(row[0].encode() + b"\n")
            first = False
        if first:
            put(b"\n")
    finally:
        if sink:
            sink.close()
    return digest.hexdigest()


def verify(events: DataFrame, seed: int, out: str) -> str:
    """Features twice, in jobs that deal the rows out differently; equal bytes are written to out."""
    config = FeatureConfig.seeded(seed)
    one = write_lines(feature_lines(events, config), out)
    two = write_lines(feature_lines(events.repartition(7, "timestamp_ns"), config), f"{out}.again")
    Path(f"{out}.again").unlink()
    if one != two:
        raise NonDeterministic("determinism check failed")
    return one


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line the time since the one before it, as an equal share of its batch's."""
    began = time.perf_counter_ns()
    for batch in batches:
        now = time.perf_counter_ns()
        yield pa.RecordBatch.from_arrays([pa.array([(now - began) // max(1, batch.num_rows)] * batch.num_rows, pa.int64())], ["ns"])
        began = time.perf_counter_ns()


def _seconds(df: DataFrame) -> float:
    """Of computing all of df, every column of it."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measure(events: DataFrame) -> dict[str, float]:
    """Events per second of an ordered load and of a scan, and the nearest-rank p99 of the time a line takes to render (ns)."""
    count = events.count()
    loaded, scanned = _seconds(events.orderBy("sequence")), _seconds(events)
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "line-times")
    lines(events).select("line").mapInArrow(_gaps, "ns long").write.parquet(path)  # a second run would measure other times
    p99 = nearest_rank(spark.read.parquet(path), "ns").first()[0]
    return {"events_per_sec": throughput(count, loaded), "p99_replay_latency_ns": p99, "parse_throughput_events_per_sec": throughput(count, scanned)}

"""The event log as Parquet: sorted by sequence, so that footers prune ranges of time and sequence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.errors import StorageError
from tickloom.schema import EVENT

#: Version and schema name of a log.
VERSION, SCHEMA_NAME = 1, "event_v1"
#: Events of one file.
FILE_ROWS = 5_000_000


def schema_hash() -> int:
    from zlib import crc32

    return crc32(SCHEMA_NAME.encode())


def write_events(events: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Files hold disjoint ranges of sequences; sequences have no gaps, so their ranges need no sampling."""
    header = json.dumps({"version": VERSION, "schema_hash": schema_hash()})
    blocks = events.withColumn("__block", F.expr(f"(sequence - 1) div {file_rows}L")).repartition("__block").sortWithinPartitions("__block", "sequence")
    rows = blocks.drop("__block")
    rows = rows.select(*(F.col(f.name).alias(f.name, metadata={"log": header}) if f.name == "sequence" else F.col(f.name) for f in EVENT.fields))
    rows.write.option("maxRecordsPerFile", file_rows).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of write_events(), after a check of version and schema."""
    events = spark.read.parquet(path)
    header = json.loads(events.schema["sequence"].metadata.get("log", "{}")) if "sequence" in events.columns else {}
    if header != {"version": VERSION, "schema_hash": schema_hash()}:
        raise StorageError(f"{path}: not an event log of version {VERSION}")
    return events

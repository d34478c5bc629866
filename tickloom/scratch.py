"""Folders for what a query has to write before it can go on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the session names; on a local master (tests) in one of our own where it names none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"

"""One Spark session, and DuckDB views over the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x) -> str:
    return repr(round(x, 9)) if isinstance(x, float) else repr(x)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query's rows are those of its SQL, by column name and as a multiset."""

    def check(query, sql: str) -> None:
        df = query(spark, SF)
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        theirs = sorted(tuple(_cell(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        ours = sorted(tuple(_cell(r[c]) for c in sorted(names)) for r in df.collect())
        assert ours == theirs

    return check

"""What the operators of this subpackage share: tables, scratch space and size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of eight to thirty bytes that a broadcast side may have; a larger side is shuffled instead.
BROADCAST_ROWS = 500_000

#: Words of most contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, one of our own on a local master (tests); elsewhere that is an
    error, as executors would each write to a disk of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        place = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Where staged tables lie, for discard().
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    Everything computed from it (row ids, samples) is fixed from here on. Tables that no returned DataFrame reads go by discard();
    the others stay until the session's owner clears spark.checkpoint.dir, as later lazy reads need them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables of which nothing will be read again: all that came of them is staged itself by now."""
    for df in tables:
        if path := _places.pop(df, None):
            jvm, context = df.sparkSession._jvm, df.sparkSession._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver's cleaner drop the shuffles and broadcasts of tables that nobody holds any more, between steps of a long run."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of a filter for each of its keys, and of a whole one at most (128 MB).
KEY_BITS, FILTER_BITS = 8, 1 << 30


def maybe(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with __maybe: whether a row's long `key` may be among those of `keys` (staged). A filter of hashed bits, broadcast.

    Its size is bounded by FILTER_BITS. False is certain; true asks for the exact join that follows, which is thereby
    saved from shuffling most other rows. Where the keys outgrow the filter more and more rows pass, and the join decides alike.
    """
    bits = min(FILTER_BITS, 1 << max(20, (KEY_BITS * keys.count()).bit_length()))
    bit = F.col(key).bitwiseAND(F.lit(bits - 1))
    place, block = bit.bitwiseAND(F.lit(32767)), F.shiftright(bit, 15)
    blocks = keys.groupBy(block.alias("__block")).agg(F.bitmap_construct_agg(place).alias("__bits"))
    hit = df.withColumn("__block", block).join(F.broadcast(blocks), "__block", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr(f"shiftleft(1, cast(`{key}` & 7 AS int))")
    return hit.withColumn("__maybe", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("__block", "__bits")


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose long `key` is among those of `keys` (staged), and a few others."""
    return maybe(df, key, keys).where("__maybe").drop("__maybe")


#: A key with more than one in so many of all rows is hot; there can be no more hot keys than this.
HOT_KEYS = 1000


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], n: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with `unique` (staged; one row for each key of `on`, and n, how many of `rows` have it), without a hot task.

    Rows of a hot key are dealt out by the hash of their column `by` to as many parts as it takes to be small, and the key's row
    in `unique` is repeated for each. The hot keys are HOT_KEYS at most, so they are broadcast.
    """
    total = unique.agg(F.sum(n)).first()[0] or 0
    limit = max(1, -(-total // HOT_KEYS))
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = unique.where(F.col(n) > limit).select(*on, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), "__parts"), F.lit(0)).cast("int")).drop("__parts")
    repeated = unique.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated.hint("merge"), [*on, "__part"], how).drop("__part")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if it has at most `limit` rows; otherwise the join shuffles.

    df should be staged, so that the check costs a look at Parquet footers. The result of the join is
    the same either way.
    """
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1 and so on, which can't clash with an operator's own, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that further columns can't clash with ours."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )

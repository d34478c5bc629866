"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's target is its weight's share of all words, three times its own words at most; what the limit
cuts off is shared again by weight. A document of a source is due target / words copies: a whole part and a
fraction. The fractions are rounded together. Two documents of a source exchange words: one's fraction
rises as the other's falls, by the amounts that leave the sum of words as it is, until one of them is 0 or
1. Which one rises is random, with odds that leave each fraction's expectation as it is. What is left of a
block of documents is one fraction, and the blocks' fractions are paired in the same way, level by level: a reduction tree
whose levels are tables of the shared folder. The last fraction of a source is rounded by itself, so a source's words
miss its target by less than one document.

The draws are hashes of (seed, doc_id, size), and pairs are made in the order of such hashes: reruns agree,
whatever the partitions. A source that holds a third of all rows is many blocks of about `block` rows.

Sources go by code point, null last; weights repeat. Null texts have no words. A document without words takes
none. Rows that repeat doc_id, source and size are told apart by a running number. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, staged, table

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
BLOCK = 128
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, target of rows (source, size).

    The windows run over one row per source, sums that each task has combined before. With the ratio of
    limit and weight ascending, the limited sources are a prefix; the rest shares what is left by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = total.withColumn("weight", weight).withColumn("limit", max_rate * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    shared = weighed.withColumn("each", (F.sum("source_size").over(everything) - before) / rest)
    fits = F.when(F.col("each") * F.col("weight") <= F.col("limit"), F.col("each"))
    level = F.coalesce(F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return shared.select("source", "source_size", F.least(F.col("limit").cast("double"), level * F.col("weight")).alias("target"))


#: u in [0, 1) of the hashes of a pair.
_DRAW = "(xxhash64(acc.cur.h, item.h, {seed}L) & 9007199254740991L) / 9007199254740992D"

#: One exchange. up, down: words that can move to, or from, the waiting document; done: the one that is settled.
_EXCHANGE = """
transform(array(struct(
    least((1 - acc.cur.x) * acc.cur.size, item.x * item.size) AS up,
    least(acc.cur.x * acc.cur.size, (1 - item.x) * item.size) AS down)), m ->
  IF({draw} * (m.up + m.down) < m.down,
    IF((1 - acc.cur.x) * acc.cur.size <= item.x * item.size,
      struct({cur_one} AS done, named_struct({item}, 'x', greatest(item.x - m.up / item.size, 0D)) AS cur),
      struct({item_zero} AS done, named_struct({cur}, 'x', least(acc.cur.x + m.up / acc.cur.size, 1D)) AS cur)),
    IF(acc.cur.x * acc.cur.size <= (1 - item.x) * item.size,
      struct({cur_zero} AS done, named_struct({item}, 'x', least(item.x + m.down / item.size, 1D)) AS cur),
      struct({item_one} AS done, named_struct({cur}, 'x', greatest(acc.cur.x - m.down / acc.cur.size, 0D)) AS cur))))[0]
"""
_FIELDS = ("h", "doc_id", "copy", "size")


def _fold(seed: int) -> Column:
    """units -> cur, the document that is left, and out, the settled ones; x is 0 or 1 in these."""

    def of(row: str) -> str:
        return ", ".join(f"'{f}', {row}.{f}" for f in _FIELDS)

    cur, item = of("acc.cur"), of("item")
    settled = {f"{n}_{w}": f"named_struct({v}, 'x', {x})" for n, v in (("cur", cur), ("item", item)) for w, x in (("one", "1D"), ("zero", "0D"))}
    exchange = _EXCHANGE.format(draw=_DRAW.format(seed=seed), cur=cur, item=item, **settled)
    merge = f"""
    IF(acc.cur.x <= 0 OR acc.cur.x >= 1,
       named_struct('cur', item, 'out', concat(acc.out, array(acc.cur))),
       transform(array({exchange}), e -> named_struct('cur', e.cur, 'out', concat(acc.out, array(e.done))))[0])
    """
    return F.expr(f"aggregate(slice(units, 2, size(units)), named_struct('cur', units[0], 'out', slice(units, 1, 0)), (acc, item) -> {merge})")


def _round_fractions(units: DataFrame, seed: int, block: int) -> DataFrame:
    """source, doc_id, copy, size, x: the units' fractions, rounded to 0 or 1 by the tree."""
    settled = None
    while True:
        per_source = units.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        blocks = staged(per_source, "mix-blocks")
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            return units.select("source", "doc_id", "copy", "size", "x")
        placed = units.join(blocks.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        grouped = placed.groupBy("source", F.pmod("h", "blocks").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*_FIELDS, "x"))).alias("units"))
        folded = staged(grouped.select("source", _fold(seed).alias("f")).select("source", "f.cur", "f.out"), "mix-level")
        out = folded.select("source", F.explode("out").alias("u")).select("source", "u.doc_id", "u.copy", "u.size", "u.x")
        settled = out if settled is None else settled.unionByName(out)
        seed += 1
        left = folded.select("source", "cur.*")
        if most == 1:
            alone = F.when((F.xxhash64("h", F.lit(seed)).bitwiseAND(F.lit(2**53 - 1))) / F.lit(float(2**53)) < F.col("x"), 1.0).otherwise(0.0)
            last = left.select("source", "doc_id", "copy", "size", F.when(F.col("x") >= 1, 1.0).when(F.col("x") <= 0, 0.0).otherwise(alone).alias("x"))
            return settled.unionByName(last)
        whole = (F.col("x") <= 0) | (F.col("x") >= 1)
        settled = settled.unionByName(left.where(whole).select("source", "doc_id", "copy", "size", "x"))
        units = left.where(~whole).withColumn("h", F.xxhash64("h", F.lit(seed)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies: a row for each document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Rows that are alike get a running number, so that each is one unit.
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = staged(alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")), "mix-sizes")
    goals = staged(targets(rows.select("source", "size"), weights, max_rate), "mix-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    # A fraction that differs from a whole number by rounding errors alone is one.
    due = due.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("x", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    due = due.select("doc_id", "source", "size", "copy", "source_size", "target", "base", F.when(F.col("x") > 1e-9, F.col("x")).otherwise(0.0).alias("x"))
    open_ = (F.col("x") > 0) & (F.col("size") > 0)
    units = due.where(open_).select("source", F.xxhash64("doc_id", "copy", "size", F.lit(seed)).alias("h"), "doc_id", "copy", "size", "x")
    rounded = _round_fractions(units, seed, block)
    taken = rounded.select("source", "doc_id", "copy", "size", F.col("x").cast("long").alias("more"))
    rest = due.where(~open_).select("source", "doc_id", "copy", "size", F.lit(0).cast("long").alias("more"))
    named = taken.unionByName(rest).join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("n_copies", F.floor(rate + 1e-9) + F.col("more"))
    return named.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("n_copies")

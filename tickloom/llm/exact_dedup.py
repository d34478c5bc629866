"""Exact deduplication with counting quotient filters.

1. Every partition builds a counting quotient filter over the 64-bit fingerprints of its texts. The upper
   half of a fingerprint is its quotient, the lower half its remainder; runs of one quotient hold sorted
   remainders with counters. Nothing is hashed away, so the filter is exact about fingerprints.
2. A filter is cut at quotient boundaries into blocks, blocks of one range meet in one task and are merged
   run by run: sorted remainders, counters added. A text that a third of all rows share is one counter per
   partition by then.
3. Fingerprints counted once are unique texts. Rows of the others go to byte verification: each partition
   groups its rows by their bytes and sends one text per group; equal bytes meet in a group-by on the
   text itself, so colliding fingerprints part again.

Rows: null text counts as empty. Of equal texts the row with the largest doc_id stays, a null doc_id being
smaller than any; if that doc_id is repeated, exactly one of its rows stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import broadcast_if_small, documents, staged, table

HALF = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


class CountingQuotientFilter:
    """Runs by quotient: `quotients` ascending, `lengths` of their runs, and per slot a remainder and a count."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def empty(cls) -> CountingQuotientFilter:
        return cls(*(np.empty(0, t) for t in (np.uint32, np.int64, np.uint32, np.int64)))

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From unsigned 64-bit fingerprints in any order; counts are ones unless given."""
        if not len(prints):
            return cls.empty()
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        slots, sums = prints[first], np.add.reduceat(counts, first)
        quotient = (slots >> HALF).astype(np.uint32)
        head = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]])
        return cls(quotient[head], np.diff(np.r_[head, len(slots)]), (slots & LOW).astype(np.uint32), sums)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths).astype(np.uint64) << HALF) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Lossless: the slots of both, sorted by quotient and remainder, counters of equal ones added."""
        return CountingQuotientFilter.of(
            np.concatenate([self.fingerprints(), other.fingerprints()]), np.concatenate([self.counts, other.counts])
        )

    def blocks(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Parts by the quotients' leading bits."""
        if not len(self.quotients):
            return
        block = self.quotients >> np.uint32(32 - bits) if bits else np.zeros_like(self.quotients)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        slot = np.r_[0, np.cumsum(self.lengths)]
        for a, b in zip(starts, ends):
            s = slice(slot[a], slot[b])
            yield int(block[a]), CountingQuotientFilter(self.quotients[a:b], self.lengths[a:b], self.remainders[s], self.counts[s])

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.quotients.tobytes(), self.lengths.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def unpack(cls, quotients: bytes, lengths: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(*(np.frombuffer(b, t) for b, t in ((quotients, np.uint32), (lengths, np.int64), (remainders, np.uint32), (counts, np.int64))))


PARTS = ("quotients", "lengths", "remainders", "counts")
FILTER = "block int, " + ", ".join(f"{p} binary" for p in PARTS)


def _build(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, fresh, waiting = CountingQuotientFilter.empty(), [], 0
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fresh.append(prints)
            waiting += len(prints)
            if waiting > 1_000_000:
                whole, fresh, waiting = whole.merge(CountingQuotientFilter.of(np.concatenate(fresh))), [], 0
        if fresh:
            whole = whole.merge(CountingQuotientFilter.of(np.concatenate(fresh)))
        rows = [(block, *part.pack()) for block, part in whole.blocks(bits)]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["block", *PARTS]
            )

    return build


def _merge(parts: pa.Table) -> pa.Table:
    """Fingerprints of one block that are counted more than once."""
    filters = [CountingQuotientFilter.unpack(*row) for row in zip(*(parts.column(p).to_pylist() for p in PARTS))]
    while len(filters) > 1:
        filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) // 2 * 2 :]
    whole = filters[0]
    return pa.table({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})


#: Bytes of texts that a task holds to group its rows by.
HELD_BYTES = 64 << 20
GROUPED = "fp long, row long, doc_id long, sha string, local long, text string, n long, best struct<doc_id: long, row: long>"


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by their bytes: a narrow row for each, then one row with the text for each group."""
    base = TaskContext.get().partitionId() << 40
    known: dict[str, int] = {}
    groups: list[list] = []
    row = before = held = 0  # rows, groups sent, bytes held so far
    best_type = pa.struct([("doc_id", pa.int64()), ("row", pa.int64())])

    def out(fp, rows, ids, shas, local, texts, n, best):
        arrays = [pa.array(fp, pa.int64()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(shas, pa.string()), pa.array(local, pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(best, best_type)]
        return pa.RecordBatch.from_arrays(arrays, ["fp", "row", "doc_id", "sha", "local", "text", "n", "best"])

    def sent() -> Iterator[pa.RecordBatch]:
        for start in range(0, len(groups), 1000):
            part = groups[start : start + 1000]
            nothing = [None] * len(part)
            best = [{"doc_id": k[1] if k[0] else None, "row": base + k[2]} for *_, k in part]
            yield out([g[0] for g in part], nothing, nothing, nothing, [base + before + start + i for i in range(len(part))], [g[1] for g in part], [g[2] for g in part], best)

    for batch in batches:
        fps, ids, texts, shas = (batch.column(c).to_pylist() for c in ("fp", "doc_id", "text", "sha"))
        rows, local = [], []
        for fp, doc_id, text in zip(fps, ids, texts):
            at = known.setdefault(text, len(groups))
            if at == len(groups):
                groups.append([fp, text, 0, None])
                held += len(text)
            group = groups[at]
            group[2] += 1
            key = (doc_id is not None, doc_id or 0, row)
            if group[3] is None or key > group[3]:
                group[3] = key
            rows.append(base + row)
            local.append(base + before + at)
            row += 1
        nothing = [None] * len(ids)
        yield out(fps, rows, ids, shas, local, nothing, nothing, nothing)
        if held > HELD_BYTES:  # a text that comes again is a further group: groups of one text meet in the verification
            yield from sent()
            before += len(groups)
            known, groups, held = {}, [], 0
    yield from sent()


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    normalise, if given, is an expression over `text`; copies are then equal after it.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    if normalise is not None:
        rows = rows.withColumn("text", normalise)
    rows = rows.withColumn("fp", F.xxhash64("text"))
    bits = min(16, max(2, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    repeated = staged(
        rows.select("fp").mapInArrow(_build(bits), FILTER).groupBy("block").applyInArrow(_merge, "fp long"), "repeated-prints"
    )
    small = broadcast_if_small(repeated)
    hashed = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    alone = hashed.join(small, "fp", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    routed = staged(hashed.join(small, "fp", "left_semi").select("fp", "doc_id", "text", "sha").mapInArrow(_by_bytes, GROUPED), "byte-groups")
    verified = (
        routed.where("text is not null")
        .groupBy("fp", "text")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_list("local").alias("locals"))
        .select(F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.explode("locals").alias("local"))
    )
    together = (
        routed.where("text is null")
        .join(verified, "local")
        .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    return alone.unionByName(together)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

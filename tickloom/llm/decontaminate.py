"""Benchmark decontamination: token windows of the corpus against a broadcast set of benchmark n-grams.

Words are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters. The windows of a
benchmark item are its n consecutive words each (n = 13), or all its words if it has fewer. The set of
windows goes to every executor in blocks of at most `block_words` benchmark words, so what is broadcast
has a fixed bound whatever the benchmark's size; one block is all that usual benchmarks need. A longer item is cut
into pieces that overlap by a window less a word. Each document's rolling window hashes are looked up in the set and hits are verified
word by word; documents pass the blocks one after another and never move.

Documents keep one row each, repeated rows too. Null texts have no words. Items without words have no
windows; a null item_id counts as an item whose id is the empty string. An empty benchmark hits nothing. Further columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, positional, staged, table

WINDOW = 13
#: Words of one broadcast block; about 100 MB of windows in a worker at most.
BLOCK_WORDS = 500_000
#: Blocks that documents pass in one job, each in a worker of its own beside the others.
TOGETHER = 4
#: Documents that a worker holds the words of.
TEXTS = 256

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive ids."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + ids[k : k + len(out)]
    return out


class WindowSet:
    """All windows of some items (their words): by length, the sorted hashes, and by window the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, own in items:
            found = [self.ids.setdefault(w, len(self.ids) + 1) for w in own]
            n = min(window, len(found))
            for i in range(len(found) - n + 1 if n else 0):
                self.items.setdefault(tuple(found[i : i + n]), set()).add(item)
        lengths: dict[int, list[tuple[int, ...]]] = {}
        for key in self.items:
            lengths.setdefault(len(key), []).append(key)
        self.hashes = {n: np.unique(_rolled(np.array(keys, np.uint64).ravel(), n)[::n]) for n, keys in lengths.items()}

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [start, end) of the windows that occur in a document, and their items."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        spans, items = [], set()
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            known = np.r_[0, np.cumsum(ids == 0)]
            starts = np.flatnonzero(known[n:] == known[:-n])  # windows without any foreign word
            if not len(starts):
                continue
            rolled = _rolled(ids, n)[starts]
            at = np.searchsorted(hashes, rolled).clip(max=len(hashes) - 1)
            for i in starts[hashes[at] == rolled].tolist():
                if (key := self.items.get(tuple(ids[i : i + n].tolist()))) is not None:
                    spans.append((i, i + n))
                    items |= key
        return spans, items


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    return np.cumsum(edges)[:n] > 0


#: What the blocks so far have found: words hit, disjoint spans of them as start, end pairs, and items in order.
FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
FOUND_SQL = "n_words long, n_hit long, spans array<int>, items array<string>"


def _scan(shared, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                own = [n for n in batch.schema.names if n not in FOUND]
                before = zip(batch.column("spans"), batch.column("items")) if "spans" in batch.schema.names else [(None, None)] * batch.num_rows
                rows = []
                for text, (spans, items) in zip(batch.column(text_col), before):
                    found = words(text.as_py())
                    at, of = windows.hits(found)
                    if spans is not None:
                        flat = spans.as_py()
                        at, of = [*at, *zip(flat[::2], flat[1::2])], of.union(items.as_py())
                    hit = covered(at, len(found)) if at else np.zeros(0, bool)
                    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist() if at else []
                    rows.append((len(found), int(hit.sum()), edges, sorted(of)))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(FOUND.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *arrays], [*own, *FOUND])

    return scan


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items' words in blocks; the driver holds one partition of the benchmark at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        found = words(text)
        for start in range(0, max(1, len(found) - window + 1), block_words):
            piece = found[start : start + block_words + window - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            if piece:
                block.append((item, piece))
                size += len(piece)
    if block:
        yield block


def _searched(own: DataFrame, text_col: str, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """own, in all its columns, with FOUND."""
    context = own.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    scan = lambda rows, block: rows.mapInArrow(_scan(context.broadcast(WindowSet(block, window)), text_col), f"{fields}, {FOUND_SQL}")
    blocks = _blocks(benchmark, window, block_words)
    found = scan(own, next(blocks, []))
    for k, block in enumerate(blocks, 1):
        found = scan(staged(found, "searched-documents") if k % TOGETHER == 0 else found, block)
    return found


def _contaminated(share: int):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit words, as start, end pairs).

    contaminated: some word is hit and at least one word in `share` is.
    """
    found = _searched(documents(docs), "text", benchmark, window, block_words)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), _contaminated(share).alias("contaminated"), "spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, share: int = 20) -> DataFrame:
    """docs, in all its columns, without contaminated documents."""
    own, at = positional(docs)
    found = _searched(own, at["text"], benchmark, window, block_words)
    return found.where(~_contaminated(share)).select(*own.columns).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text: the words (normalised, one space between) that no benchmark window covers."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                found, flat = words(text.as_py()), spans.as_py()
                hit = covered(list(zip(flat[::2], flat[1::2])), len(found))
                texts.append(b" ".join(w for w, h in zip(found, hit) if not h).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    found = _searched(documents(docs), "text", benchmark, window, block_words)
    return found.select("doc_id", "text", "spans").mapInArrow(strip, "doc_id long, text string")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


# Windows are compared as text: words have no spaces, so joining them by one is unambiguous.
SQL = r"""
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
item AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
item_window AS (
    SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc_window AS (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM doc_window JOIN item_window USING (n, g)),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

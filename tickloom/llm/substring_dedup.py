"""Substring dedup by level-wise doubling of repeated word windows.

A word is removed if a window of `window` (35) consecutive words covers it whose word sequence also starts
anywhere else, in the same document or another; windows are judged on the input.

Level 1, a quarter of the window (9 words): of each full window, the 9-word part with the least hash stands for it. Which part
that is depends on the window's words alone, so two equal windows have the same one; a part is chosen about every 14th word.
Parts seen once in the corpus die there, and with them every window that they stand for: it can have no equal.
Level 2, twice the length (18 words): of each window whose part is alive, that part is extended to the right, or to the left where the
window ends before. Extensions are equal in equal windows too, are counted in the same way, and those seen once die.
Level 3, twice the length again, cut to the window (35 words): the windows of living extensions are compared by
128-bit hashes. Longer windows would cover no further words, so the doubling ends there; where nothing is alive, it ends before.

At the last level texts are in chunks. A chunk sends its distinct window hashes, sorted and cut by hash range, and gets a bit for each back:
whether another chunk, or another place in this one, has it too. A passage that a third of all texts share is one hash for
each chunk by then; at the levels before, counts are combined on the map side and the rows of a hot part are dealt out.

Texts that equal each other byte by byte are one text with a count from level 2 on: of a repeated text
with a full window each word goes, and its windows enter the levels once, so a large group of copies costs
as much as one. What the tasks exchange are hashes; texts travel once to the chunks, and once from there to their bits.

Null texts have no words. Documents shorter than a window lose nothing. Repeated rows are further documents
with the same text, so they lose everything too. An empty table gives no rows, and further columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import discard, documents, maybe_in, spread_join, staged, table

WINDOW = 35
#: Odd multipliers of the two rolling hashes and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Bytes that are hashed together, and what may come between words.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words of a chunk (a longer text is a chunk of its own), and windows that one task merges.
CHUNK_WORDS = 1 << 19
MERGED = 1 << 20
#: Texts that a worker holds the words of.
TEXTS = 200


def split(data: bytes) -> list[bytes]:
    return data.split()


_powers: list[np.ndarray] = []


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a multiplier and of its inverse."""
    while len(_powers) < 4:
        _powers.append(np.ones(1, np.uint64))
    for k, base in ((2 * which, _BASES[which]), (2 * which + 1, _INVERSES[which])):
        if len(_powers[k]) <= n:
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 65536), base, np.uint64)], dtype=np.uint64)
    return _powers[2 * which], _powers[2 * which + 1]


def windows(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each `length` consecutive words."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _power(which, n)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64)]
    rolled = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    rolled ^= rolled >> np.uint64(29)  # the low bits of a product depend on low bits alone
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ (rolled >> np.uint64(32))


def _blocks(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Parts of about `size` bytes, cut before white space; a longer word is not cut."""
    start = 0
    while start < len(data):
        end = start + size
        space = _SPACE.search(data, end) if end < len(data) else None
        end = space.start() if space else len(data)
        yield start, end
        start = end


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in bytes, and a 64-bit hash of each: a rolling sum over its bytes, mixed with its length."""
    starts, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a, b in _blocks(data, BLOCK_BYTES):
        x = np.frombuffer(data, np.uint8, b - a, a)
        space = (x == 32) | ((x >= 9) & (x <= 13))
        edges = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
        first, last = edges[::2], edges[1::2]
        up, down = _power(0, len(x))
        sums = np.r_[np.uint64(0), np.cumsum((x + np.uint64(1)) * up[: len(x)], dtype=np.uint64)]
        h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        starts.append(first + a)
        hashes.append(h ^ (h >> np.uint64(31)))
    return np.concatenate(starts), np.concatenate(hashes)


def levels(window: int) -> tuple[int, int, int]:
    """Words of a window at each level: the next has twice as many, the last as many as the full window."""
    half = (window + 1) // 2
    return (half + 1) // 2, half, window


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` consecutive values is, the first of equal ones."""
    have, least, at = 1, values, np.arange(len(values))
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return at


class Texts:
    """Some texts, one after another: the hashes of their words, how many each has, and their full windows.

    parts, halves: hashes of every 9 and 18 consecutive words; starts: where full windows within one text start, and owner: that text;
    at, extended: where the part and the extension that stand for each begin.
    """

    def __init__(self, texts: list[str], window: int):
        short, half, _ = levels(window)
        self.data = [t.encode("utf-8", "surrogatepass") for t in texts]
        places, self.hashes = words_of(b"\n".join(self.data))
        self.ends = np.searchsorted(places, np.cumsum([len(d) + 1 for d in self.data]))
        self.sizes = np.diff(self.ends, prepend=0)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.parts, self.halves = windows(self.hashes, short), windows(self.hashes, half)
        places = np.arange(max(0, len(self.hashes) - window + 1))
        inside = places + window <= self.ends[owner[: len(places)]]
        self.starts, self.owner = places[inside], owner[: len(places)][inside]
        self.at = least_at(self.parts, window - short + 1)[inside] if len(places) else places
        self.extended = np.where(self.at + half <= self.starts + window, self.at, self.at + short - half)


def _repeats(owner: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, hash, places of the distinct hashes of each text, over distinct places."""
    _, first = np.unique(places, return_index=True)
    owner, hashes = owner[first], values[places[first]]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)])
    return owner[new], hashes[new], np.diff(np.r_[new, len(owner)])


FIRST = "doc_id long, row long, content binary, n_words long, kept_sha256 string, parts array<long>, parents array<long>, extensions array<long>, weights array<int>"


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """The values of each of n texts; owner ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _first(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts that stand for a text's windows, twice where the text itself repeats one, and their extensions with a weight of 1 or 2."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                own, n = Texts(batch.column("text").to_pylist(), window), batch.num_rows
                shas = [hashlib.sha256(b" ".join(split(d))).hexdigest() for d in own.data]
                of, parts, places = _repeats(own.owner, own.at, own.parts)
                often = np.where(places > 1, 2, 1)
                # A part has one extension or two; the same one of a text weighs 2 if it is at several places.
                pairs, one = np.unique(2 * own.at + (own.extended != own.at), return_index=True)
                owner, parents, extensions = own.owner[one], own.parts[own.at[one]], own.halves[own.extended[one]]
                order = np.lexsort((parents, extensions, owner))
                owner, parents, extensions = owner[order], parents[order], extensions[order]
                same = np.r_[False, (owner[1:] == owner[:-1]) & (extensions[1:] == extensions[:-1])][: len(owner)]
                weights = np.where(same | np.r_[same[1:], False][: len(owner)], 2, 1).astype(np.int32)
                new = ~same | np.r_[False, parents[1:] != parents[:-1]][: len(owner)]
                arrays = [
                    batch.column("doc_id"), batch.column("row"), batch.column("content"), pa.array(own.sizes), pa.array(shas, pa.string()),
                    _lists(np.repeat(of, often), n, np.repeat(parts, often).view(np.int64)),
                    *(_lists(owner[new], n, x[new]) for x in (parents.view(np.int64), extensions.view(np.int64), weights)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "content", "n_words", "kept_sha256", "parts", "parents", "extensions", "weights"])

    return first


CHUNK = "ids array<long>, alone array<boolean>, texts array<string>, living array<binary>, n_words long"


def _chunks(chunk_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to chunks of at most `chunk_words` words, or of one longer text."""

    def out(rows: list[tuple], size: int) -> pa.RecordBatch:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.list_(pa.binary()))
        arrays = [pa.array([[r[k] for r in rows]], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([size], pa.int64())], ["ids", "alone", "texts", "living", "n_words"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row, copies, text, n, living in zip(*(batch.column(c) for c in ("id", "copies", "text", "n_words", "living"))):
                if rows and size + n.as_py() > chunk_words:
                    yield out(rows, size)
                    rows, size = [], 0
                rows.append((row.as_py(), copies.as_py() == 1, text.as_py(), np.unique(living.values.to_numpy()).tobytes()))
                size += n.as_py()
        if rows:
            yield out(rows, size)

    return chunks


class Chunk:
    """The windows of some texts whose extension is alive, by distinct hash in ascending order."""

    def __init__(self, texts: list[str], living: list[bytes], window: int):
        self.texts, self.window = Texts(texts, window), window
        # What is alive is so in every text that has it.
        alive = np.unique(np.frombuffer(b"".join(living), np.int64).view(np.uint64))
        self.places = self.texts.starts[np.isin(self.texts.halves[self.texts.extended], alive)]
        both = np.stack([windows(self.texts.hashes, window, k)[self.places] for k in (0, 1)])
        order = np.lexsort((both[1], both[0]))
        ordered = both[:, order]
        new = np.r_[True, (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)][: len(order)]
        self.one, self.two = ordered[:, new]
        #: Of each window, in the order of places, which of the distinct ones it is.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.several = np.bincount(self.which, minlength=len(self.one)) > 1

    def buckets(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Bucket, start and end of its distinct windows: ranges of the first hash."""
        of = ((self.one >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True][: len(of) + 1])
        yield from zip(of[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())

    def removed(self, repeated: np.ndarray) -> list[np.ndarray]:
        """Of each text, which words repeated windows cover."""
        at, edges = self.places[repeated[self.which]], np.zeros(len(self.texts.hashes) + 1, np.int64)
        edges[at] += 1
        edges[at + self.window] -= 1  # places are distinct, and so are their ends
        return np.split(np.cumsum(edges)[:-1] > 0, self.texts.ends[:-1])


def _send(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct windows of each chunk by bucket: both hashes, and bits of those at several places of the chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts, living in zip(batch.column("chunk"), batch.column("texts"), batch.column("living")):
                own = Chunk(texts.as_py(), living.as_py(), window)
                rows = [(b, own.one[s:e].tobytes() + own.two[s:e].tobytes(), np.packbits(own.several[s:e]).tobytes()) for b, s, e in own.buckets(buckets)]
                arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk.as_py()] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "hashes", "several"])

    return send


def _merge(sent: pa.Table) -> pa.Table:
    """Of one bucket: bits of the windows that several chunks have, or one has several times."""
    hashes = [np.frombuffer(h.as_py(), np.uint64).reshape(2, -1) for h in sent.column("hashes")]
    bits = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=h.shape[1]).astype(bool) for b, h in zip(sent.column("several"), hashes)]
    both, repeated = np.concatenate(hashes, axis=1), np.concatenate(bits)
    order = np.lexsort((both[1], both[0]))
    same = (both[:, order][:, 1:] == both[:, order][:, :-1]).all(axis=0)
    repeated[order] |= np.r_[False, same] | np.r_[same, False]
    cuts = np.cumsum([h.shape[1] for h in hashes])[:-1]
    return pa.table({"chunk": sent.column("chunk"), "bucket": sent.column("bucket"), "repeated": pa.array([np.packbits(r).tobytes() for r in np.split(repeated, cuts)], pa.binary())})


def _strip(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts that no other equals, without the words that repeated windows cover."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, alone, texts, living, bits in zip(*(batch.column(c) for c in ("ids", "alone", "texts", "living", "bits"))):
                own = Chunk(texts.as_py(), living.as_py(), window)
                repeated, sent = np.zeros(len(own.one), bool), {b["bucket"]: b["repeated"] for b in bits.as_py()}
                for b, s, e in own.buckets(buckets):
                    repeated[s:e] = np.unpackbits(np.frombuffer(sent[b], np.uint8), count=e - s)
                rows = []
                for row, single, data, gone in zip(ids.as_py(), alone.as_py(), own.texts.data, own.removed(repeated)):
                    if single and gone.any():
                        words = split(data)
                        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                        rows.append((row, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "removed", "sha", "kept"])

    return strip


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, chunk_words: int = CHUNK_WORDS, merged: int = MERGED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with texts=True also kept, null where a document stays whole.

    kept_sha256 is of the kept words, joined by one space.
    """
    rows = documents(docs).withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    marked = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_first(window), FIRST), "stand-ins")

    # One id for each text: a row that has it.
    contents = staged(marked.where(F.col("n_words") >= window).groupBy("content").agg(F.min("row").alias("id"), F.count("*").alias("copies")), "contents")

    # Level 1: parts seen more than once, copies of a text included.
    parts = marked.select(F.explode("parts").alias("parent"))
    alive = staged(parts.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1"), "living-parts")
    # Level 2: their extensions, each text once.
    extended = marked.select(F.col("row").alias("id"), F.explode(F.arrays_zip("parents", "extensions", "weights")).alias("x")).select("id", F.col("x.parents").alias("parent"), F.col("x.extensions").alias("extension"), F.col("x.weights").alias("weight"))
    extended = maybe_in(extended, "parent", alive).join(contents.select("id").hint("merge"), "id")
    second = staged(spread_join(extended, alive, ["parent"], "n", "id").select("id", "extension", "weight"), "extensions")
    counted = second.groupBy("extension").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").select("extension", "rows")
    living = staged(counted, "living-extensions")
    of_text = spread_join(maybe_in(second, "extension", living), living, ["extension"], "rows", "id").groupBy("id").agg(F.collect_set("extension").alias("living"))

    # The texts of living extensions, one row of each: both its content and its doc_id are the key, so that copies
    # of one text do not meet in one task. A row that repeats all of that is a copy, and copies are not stripped.
    key = F.xxhash64("content", "of").alias("key")
    named = contents.join(of_text, "id").join(marked.select(F.col("row").alias("id"), F.col("doc_id").alias("of"), "n_words").hint("merge"), "id")
    wanted = staged(named.select("content", "of", "id", "copies", "n_words", "living", key), "wanted-texts")
    candidates = maybe_in(rows.withColumnRenamed("doc_id", "of").withColumn("key", key), "key", wanted).withColumnRenamed("of", "__of").withColumnRenamed("content", "__content").drop("key")
    held = candidates.join(wanted.hint("merge"), (F.col("__content") == F.col("content")) & F.col("__of").eqNullSafe(F.col("of"))).select("id", "copies", "text", "n_words", "living")
    chunks = staged(held.mapInArrow(_chunks(chunk_words), CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    discard(alive, second, living, wanted)

    # Level 3: full windows.
    buckets = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // merged))
    sent = chunks.select("chunk", "texts", "living").mapInArrow(_send(window, buckets), "bucket long, chunk long, hashes binary, several binary")
    back = sent.groupBy("bucket").applyInArrow(_merge, "chunk long, bucket long, repeated binary")
    bits = back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeated")).alias("bits"))
    stripped = chunks.join(bits.hint("merge"), "chunk").mapInArrow(_strip(window, buckets), "id long, removed long, sha string, kept string")
    stripped = staged(stripped if texts else stripped.drop("kept"), "stripped-texts")

    # Back to the documents, by text.
    copied = F.col("copies") > 1
    verdict = contents.join(stripped.hint("merge"), "id", "left").where(copied | F.col("removed").isNotNull()).select(
        "content", "copies", F.when(~copied, F.col("removed")).alias("removed"), F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("sha"),
        *([F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    verdict = staged(verdict, "judged-texts")
    discard(contents, chunks, stripped)
    final = spread_join(marked.select("doc_id", "row", "content", "n_words", "kept_sha256"), verdict, ["content"], "copies", "row", "left")
    whole = F.col("copies").isNull()
    return final.select(
        "doc_id", "n_words", F.when(whole, F.lit(0)).otherwise(F.coalesce("removed", "n_words")).cast("long").alias("n_removed"),
        F.when(whole, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"), *(["kept"] if texts else []),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM again),
kept AS (
    SELECT r, string_agg(x, ' ' ORDER BY j) AS t
    FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM doc) ANTI JOIN gone USING (r, j)
    GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""

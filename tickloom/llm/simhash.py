"""SimHash near-duplicates: fingerprints over word shingles, a binary-trie self-join, connected components.

1. A document's fingerprint takes the XXH64 (seed 42) of its three-word shingles; a bit is one if more than
   half of the hashes have it.
2. Distinct fingerprints alone go on, so copies of one text are one key. Two fingerprints at most `budget`
   (2) bits apart agree in one of three bands of bits. Each fingerprint enters three tries, rotated so that
   another band leads; below a shared leading band, the trie is joined with itself: node pairs are traversed
   together, differing bits add up and pairs beyond the budget are pruned.
3. A node pair with more than `node_limit` fingerprints is not handed to one task: it is opened by four bits
   at a time, into the child pairs that the budget allows, until every pair is small. No partner is cut.
4. A task returns a star for each of its connected groups, never all pairs; stars are joined to components by
   alternating large-star and small-star rounds on tables of the shared folder. A component's id is
   the smallest doc_id in it.

A null text counts as empty, and a text without words has fingerprint zero. Repeated rows keep a row each;
null ids are larger than others, so component_id is null only where all ids of a component are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import discard, documents, maybe, positional, spread_join, staged, table

SHINGLE = 3
BUDGET = 2
#: First bit and width of the bands; by the pigeonhole principle one is free of two differing bits.
BANDS = ((0, 21), (21, 21), (42, 22))
NODE_LIMIT = 2048
LEAF = 48

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints.view(np.int64))], ["doc_id", "row", "fp"])


def trie_join(keys: np.ndarray, others: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys (and others, or keys again) that differ in `budget` bits at most below `depth`.

    keys: distinct, ascending, equal in their first `depth` bits. A node is a range of them; node pairs
    are walked together and dropped as soon as the bits that differ exceed the budget.
    """
    right = keys if others is None else others
    todo = [(0, len(keys), 0, len(right), depth, budget)]
    while todo:
        a, b, c, d, bit, left = todo.pop()
        same = others is None and a == c
        if a >= b or c >= d:
            continue
        if bit == 64 or (b - a <= LEAF and d - c <= LEAF):
            mask = np.uint64((1 << (64 - bit)) - 1)
            differ = np.bitwise_count((keys[a:b, None] ^ right[None, c:d]) & mask)
            i, j = np.nonzero(differ <= left)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + c
            continue
        one = np.uint64(1 << (63 - bit))
        m = a + int(np.count_nonzero((keys[a:b] & one) == 0))
        n = m if same else c + int(np.count_nonzero((right[c:d] & one) == 0))
        todo.append((a, m, c, n, bit + 1, left))
        todo.append((m, b, n, d, bit + 1, left))
        if left:
            todo.append((a, m, n, d, bit + 1, left - 1))
            if not same:
                todo.append((m, b, c, n, bit + 1, left - 1))


def _rotated(keys: np.ndarray, bits: int) -> np.ndarray:
    bits %= 64
    return keys if not bits else (keys << np.uint64(bits)) | (keys >> np.uint64(64 - bits))


def _stars(budget: int):
    """Sorted node pairs -> star edges of what each pair links."""

    def links(band: int, depth: int, a: int, b: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if a == b:
            left, right, pairs = keys, None, trie_join(keys, None, depth, budget)
            whole = keys
        else:
            side = keys >> np.uint64(64 - depth) == np.uint64(a)
            left, right = keys[side], keys[~side]
            pairs = trie_join(left, right, depth, budget - int(a ^ b).bit_count())
            whole = np.concatenate([left, right])
        label = np.arange(len(whole))
        for i, j in pairs:
            j = j if right is None else j + len(left)
            while True:
                x, y = label[i], label[j]
                apart = np.flatnonzero(x != y)
                if not len(apart):
                    break
                x, y = int(x[apart[0]]), int(y[apart[0]])
                label[label == max(x, y)] = min(x, y)
        linked = np.flatnonzero(label != np.arange(len(whole)))
        back = 64 - BANDS[band][0]
        return _rotated(whole[linked], back), _rotated(whole[label[linked]], back)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            band, depth, a, b, key = (rows.column(c).to_numpy() for c in ("band", "depth", "a", "b", "key"))
            cut = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
            us, vs = [], []
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s > 1:
                    keys = np.sort(key[s:e].view(np.uint64))
                    u, v = links(int(band[s]), int(depth[s]), int(a[s]), int(b[s]), keys)
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = lambda x, i: tuple(x.column(c)[i].as_py() for c in ("band", "depth", "a", "b"))
            whole = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            last = group(whole, whole.num_rows - 1)
            same = np.ones(whole.num_rows, bool)
            for c, x in zip(("band", "depth", "a", "b"), last):
                same &= whole.column(c).to_numpy() == x
            at = whole.num_rows - int(np.count_nonzero(same))
            yield from of(whole.slice(0, at)) if at else ()
            waiting = whole.slice(at).to_batches()
        if waiting:
            yield from of(pa.Table.from_batches(waiting).combine_chunks())

    return stars


def _top(key: str, depth) -> F.Column:
    """The leading `depth` bits of a long."""
    return F.expr(f"shiftrightunsigned({key}, 64 - {depth})")


def links(prints: DataFrame, budget: int = BUDGET, node_limit: int = NODE_LIMIT) -> DataFrame:
    """u, v: star edges that connect what `budget` differing bits connect, of distinct fingerprints `fp`; staged."""
    bands = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.lit(w).alias("depth"), F.expr(f"shiftleft(fp, {s}) | " + (f"shiftrightunsigned(fp, {64 - s})" if s else "0L")).alias("key")) for k, (s, w) in enumerate(BANDS))))
    nodes = prints.select(bands.alias("x")).select("x.*").withColumn("a", _top("key", "depth")).withColumn("b", F.col("a"))
    group = ["band", "depth", "a", "b"]
    edges, used = None, []
    while True:
        sized = nodes.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
        rows = staged(nodes.join(sized, group), "trie-nodes")
        used.append(rows)
        small = rows.where(F.col("n") <= node_limit).select(*group, "key")
        found = small.repartition(*group).sortWithinPartitions(*group).mapInArrow(_stars(budget), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        large = rows.where(F.col("n") > node_limit)
        if large.isEmpty():
            out = staged(edges, "trie-edges")
            discard(*used)
            return out
        # Open each node pair by four bits: the children of a key's own side, paired with those of the other side.
        own = F.expr("shiftrightunsigned(key, 60 - depth) & 15")
        nodes = (
            large.withColumn("own", own)
            .withColumn("left", F.expr(f"{budget} - bit_count(a ^ b)"))
            .withColumn("other", F.explode(F.expr("filter(sequence(0L, 15L), x -> bit_count(x ^ own) <= left)")))
            .withColumn("in_a", F.expr("shiftrightunsigned(key, 64 - depth) = a"))
            .select("band", (F.col("depth") + 4).alias("depth"), "key",
                    F.expr("a * 16 + if(in_a, own, other)").alias("x"), F.expr("b * 16 + if(in_a, other, own)").alias("y"))
            .select("band", "depth", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "key")
        )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for each node of the edges (u, v) the smallest node that it is connected with; staged.

    Large-star and small-star in turn; each halves distances, so the rounds grow with the logarithm of the
    longest path. Aggregates combine on the map side, and the joins' skewed sides are split by the adaptive
    planner, as what follows them is dealt out anew anyway.
    """

    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour of a node is linked to the node's smallest one.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = staged(small, "edges")
        discard(now)
        now = after
        was, state = state, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.count_distinct("u")).first()
        if state[0] == state[2] and state == was:
            break
    else:
        raise RuntimeError("connected components have not settled")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = staged(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "component-roots")
    discard(now)
    return out


def _grouped(marked: DataFrame, key: str, budget: int, node_limit: int) -> DataFrame:
    """fp, n (rows that have it), least (the smallest `key` among them), root: the distinct fingerprints by component; staged."""
    prints = staged(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = links(prints.select("fp"), budget, node_limit)
    found = components(edges)
    joined = prints.join(found, F.col("fp") == F.col("node"), "left")
    out = staged(joined.select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "components")
    discard(prints, edges, found)
    return out


def near_duplicates(docs: DataFrame, budget: int = BUDGET, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id: a row for each document. budget: differing bits, 2 at most."""
    if not 0 <= budget <= BUDGET:
        raise ValueError("the bands are laid out for two differing bits")
    rows = documents(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    marked = staged(rows.mapInArrow(_fingerprints, "doc_id long, row long, fp long"), "fingerprints")
    grouped = _grouped(marked, "doc_id", budget, node_limit)
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    ids = staged(ids, "component-ids")
    named = staged(spread_join(grouped, ids, ["root"], "prints", "fp").select("fp", "n", "component_id"), "named-fingerprints")
    discard(grouped, ids)
    # Copies of one text share a fingerprint: a hot one is dealt out.
    out = spread_join(marked, named, ["fp"], "n", "row")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET, node_limit: int = NODE_LIMIT) -> DataFrame:
    """docs, in all its columns: of each component the row with the smallest doc_id (nulls last) stays."""
    own, at = positional(docs)
    rows = staged(own.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    of = rows.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), "row", F.coalesce(F.col(at["text"]), F.lit("")).alias("text"))
    prints = of.mapInArrow(_fingerprints, "doc_id long, row long, fp long")
    # By key: doc_id, nulls after all others, then row.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    marked = staged(prints.select("fp", "row", key.alias("key")), "fingerprints")
    grouped = _grouped(marked, "key", budget, node_limit)
    first = grouped.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("prints"))
    first = staged(first.where("rows > 1").select("root", F.col("first.row").alias("stays"), "prints"), "first-copies")
    stays = staged(spread_join(grouped, first, ["root"], "prints", "fp").select("fp", "n", "stays"), "stays")
    gone = staged(spread_join(marked.select("fp", "row"), stays, ["fp"], "n", "row").where("row <> stays").select("row"), "near-copies")
    discard(marked, grouped, first, stays)
    # Only rows that may go move to meet their fate.
    flagged = maybe(rows, "row", gone)
    kept = flagged.where("NOT __maybe").unionByName(flagged.where("__maybe").join(gone.hint("merge"), "row", "left_anti"))
    return kept.select(*own.columns).toDF(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

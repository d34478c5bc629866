"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

x has an entry for each distinct lower-cased word of a text whose bucket LEAST_ROWS rows of the sample have, whether it tells the
classes apart by itself or not: a word may do so beside another alone. Decay holds back weights that only fit noise (`CHANCE`). The
linear weights learn what a word says alone; the products of latent vectors learn what two words say together, an insult beside the
mention of a group, which no linear weight can.

Learning uses labelled rows in the order of a hash of text and id, until there are `max_rows` of them or their terms would be more than
`max_terms`; these bounds are the parameters that keep the driver's share of the work the same for any corpus. Labels, language, source
and doc_id are no inputs. Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts reach the
fit. Scoring runs over all rows and whole texts; the model that is broadcast has at most `buckets` x (1 + rank) floats.

Null texts count as empty, and empty texts score the bias. Rows whose doc_id is repeated are scored one by one, and rows
that repeat doc_id and text are one row of the sample, so that copies can't outgrow its bound; labels that
are null, or differ for one doc_id, are not learned from. Without both classes among the labels, scores are the share of ones.
Further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, documents, positional, staged, table

BUCKETS = 1 << 18
RANK = 6
MAX_ROWS = 12_000
#: Terms of all rows of the sample, at most; a single row has no more than BUCKETS.
MAX_TERMS = 4_000_000
#: A bucket enters the model if so many rows of the sample have it.
LEAST_ROWS = 5
#: Bytes of a longer word that stand for its inflections.
STEM = 5
EPOCHS = 30
BATCH = 256
#: Texts that a worker holds the terms of.
TEXTS = 200
#: Decay of words without an effect of their own, in standard errors of a mean over the rows.
CHANCE = 1.0
#: Of a toxic row in the loss; they are few.
ONES = 3.0
SEED = 11

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the distinct words of a text, and of the stems of its longer words."""
    from zlib import crc32

    words = set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    stems = {b"^" + w[:STEM] for w in words if len(w) > STEM}
    return sorted({crc32(w) % buckets for w in words | stems})


class Rows:
    """The terms of some texts, one after another."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes

    @classmethod
    def of(cls, rows: list[list[int]]) -> Rows:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return cls(np.fromiter((t for row in rows for t in row), np.int32, int(sizes.sum())), sizes)

    def __len__(self) -> int:
        return len(self.sizes)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the runs of `values` that begin at `starts`; those of no size are zero."""
    out = np.zeros((len(starts), *values.shape[1:]), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


@dataclass
class Model:
    """Kept buckets in order, their linear weights and latent vectors, and a bias."""

    kept: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def scores(self, rows: Rows | list[list[int]]) -> np.ndarray:
        rows = rows if isinstance(rows, Rows) else Rows.of(rows)
        out = np.full(len(rows), self.bias, np.float64)
        if len(self.kept) and len(rows.flat):
            at = np.searchsorted(self.kept, rows.flat).clip(max=len(self.kept) - 1)
            known = self.kept[at] == rows.flat
            sizes = _sums(known.astype(np.int64), np.r_[0, np.cumsum(rows.sizes)[:-1]], rows.sizes)
            at, starts = at[known], np.r_[0, np.cumsum(sizes)[:-1]]
            v = self.vectors[at]
            s = _sums(v, starts, sizes)
            out += _sums(self.weights[at], starts, sizes) + 0.5 * ((s * s).sum(axis=1) - _sums((v * v).sum(axis=1), starts, sizes))
        return 1 / (1 + np.exp(-out.clip(-30, 30)))


@dataclass
class _Batch:
    """Some rows of the sample: terms by row, and the same terms in the order of the distinct ones."""

    rows: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    seen: np.ndarray
    by_term: np.ndarray
    term_starts: np.ndarray


def _batches(at: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> list[_Batch]:
    out = []
    for start in range(0, len(order), BATCH):
        rows = order[start : start + BATCH]
        sizes = bounds[rows + 1] - bounds[rows]
        ids = np.concatenate([at[bounds[i] : bounds[i + 1]] for i in rows])
        by_term = np.argsort(ids, kind="stable").astype(np.int32)
        seen, counts = np.unique(ids, return_counts=True)
        out.append(_Batch(rows, ids, np.r_[0, np.cumsum(sizes)[:-1]], sizes, seen, by_term, np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)))
    return out


def fit(rows: Rows | list[list[int]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, least_rows: int = LEAST_ROWS, seed: int = SEED) -> Model:
    """Adagrad over mini-batches of the logistic loss."""
    rows = rows if isinstance(rows, Rows) else Rows.of(rows)
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    kept, counts = np.unique(rows.flat, return_counts=True)
    kept = kept[counts >= least_rows].astype(np.int64)
    if not len(kept) or share in (0.0, 1.0):
        return Model(np.empty(0, np.int64), np.empty(0), np.empty((0, rank)), bias)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), rows.sizes)
    number = np.full(int(kept[-1]) + 1, -1, np.int32)
    number[kept] = np.arange(len(kept))
    at = np.where(rows.flat <= kept[-1], number[np.minimum(rows.flat, kept[-1])], -1).astype(np.int32)
    present = at >= 0
    at, owner = at[present], owner[present]
    del present, number
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))

    # Words that tell the classes apart in neither direction stay, for what they say beside others, but start near zero and decay by
    # as much as chance moves a mean over the rows: what they learn must be more than that.
    ones = np.bincount(at[labels[owner] > 0], minlength=len(kept))
    del owner
    expected = np.bincount(at, minlength=len(kept)) * share
    telling = np.abs(ones - expected) / np.sqrt(expected * (1 - share) + 1e-9) > 3.0
    chance = CHANCE / np.sqrt(len(rows))
    decay_w, decay_v = np.where(telling, 1e-5, chance).astype(np.float32), np.where(telling, 1e-4, chance).astype(np.float32)[:, None]

    # Row k of `p` is v_k and then w_k: both take the same path through the sums.
    random = np.random.default_rng(seed)
    p = np.zeros((len(kept), rank + 1), np.float32)
    p[:, :rank] = random.normal(0, 1, (len(kept), rank)) * np.where(telling, 0.05, 0.01)[:, None]
    g, gb = np.full(p.shape, 1e-2, np.float32), 1e-2
    decay = np.concatenate([np.repeat(decay_v, rank, axis=1), decay_w[:, None]], axis=1)
    rate = np.r_[np.full(rank, 0.05), 0.3].astype(np.float32)
    batches, weight = _batches(at, bounds, random.permutation(len(rows))), np.where(labels > 0, ONES, 1.0)
    del at
    for _ in range(epochs):
        for k in random.permutation(len(batches)):
            b = batches[k]
            mine = p[b.at]
            sums = _sums(mine, b.starts, b.sizes)
            squares = _sums((mine[:, :rank] ** 2).sum(axis=1), b.starts, b.sizes)
            raw = bias + sums[:, rank] + 0.5 * ((sums[:, :rank] ** 2).sum(axis=1) - squares)
            error = ((1 / (1 + np.exp(-raw.clip(-30, 30))) - labels[b.rows]) * weight[b.rows]).astype(np.float32)
            db = float(error.mean())
            gb += db**2
            bias -= 0.1 * db / np.sqrt(gb)
            if not len(b.seen):
                continue
            of = np.repeat(np.arange(len(b.rows)), b.sizes)
            pull = sums[of] - mine
            pull[:, rank] = 1
            pull *= error[of][:, None]
            # Of the words of the batch alone: the others have no gradient.
            d = np.add.reduceat(pull[b.by_term], b.term_starts, axis=0) / len(b.rows) + decay[b.seen] * p[b.seen]
            g[b.seen] += d**2
            p[b.seen] -= rate * d / np.sqrt(g[b.seen])
    return Model(kept, p[:, rank].astype(np.float64), p[:, :rank].astype(np.float64), float(bias))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(start, TEXTS)
            rows = [np.array(terms(t.as_py()), np.int32) for t in batch.column("text")]
            arrays = [batch.column("order"), batch.column("label"), pa.array(list(map(len, rows)), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["order", "label", "n", "terms"])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> tuple[Rows, np.ndarray]:
    """The terms and labels of a bounded sample of the labelled rows that are not held out."""
    clear = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("label")).where("label IS NOT NULL AND of IS NOT NULL").groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    rows = documents(docs).where(~held_out()).select("doc_id", "text", F.xxhash64("text", "doc_id").alias("order"))
    # The sample is drawn before any text moves: ids and hashes are joined and cut, then texts are looked up by their hash.
    drawn = rows.select("doc_id", "order").join(clear, F.col("doc_id") == F.col("of")).select("order", "label").distinct().orderBy("order").limit(max_rows)
    chosen = F.broadcast(drawn.withColumnRenamed("order", "chosen"))  # max_rows rows at most
    found = rows.join(chosen, F.col("order") == F.col("chosen")).select("order", "label", "text")
    kept = staged(found.mapInArrow(_terms, "order long, label int, n long, terms binary").dropDuplicates(["order"]), "toxicity-sample")
    # max_rows numbers at most are in one task; the first that brings the sum above the bound ends the sample.
    so_far = kept.select("order", F.sum("n").over(Window.orderBy("order")).alias("terms")).where(F.col("terms") <= max_terms).agg(F.max("order")).first()[0]
    got = kept.where(F.col("order") <= F.lit(so_far)).toArrow() if so_far is not None else kept.limit(0).toArrow()
    discard(kept)
    at = np.argsort(got.column("order").to_numpy(), kind="stable")
    lists = [np.frombuffer(t.as_buffer(), np.int32) for t in got.column("terms")]
    flat = np.concatenate([np.empty(0, np.int32), *(lists[i] for i in at)])
    return Rows(flat, got.column("n").to_numpy()[at]), got.column("label").to_numpy()[at].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rank: int = RANK, max_terms: int = MAX_TERMS) -> Model:
    """The model of the sample."""
    rows, ones = sample(docs, labels, max_rows, max_terms)
    return fit(rows, ones, rank)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                scores = model.scores([terms(t.as_py() or "") for t in batch.column("text")])
                rest = batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores, pa.float64())], [*rest.schema.names, "score"])

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns as c0, c1 and so on, and score."""
    own, at = positional(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.withColumn("text", F.col(at[text_col])).mapInArrow(_score(shared), f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    rows = scored(documents(docs).select("doc_id", "text"), train(docs, labels, max_rows)).select(F.col("c0").alias("doc_id"), "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs, in all its columns, without the rows predicted toxic."""
    rows = scored(docs, train(docs, labels, max_rows)).where("score < 0.5")
    return rows.drop("score").toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

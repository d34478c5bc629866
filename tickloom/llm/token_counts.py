"""Token counts of whole texts, with overlap resynchronisation for huge documents.

The library (tokenizers) decides every token. Its byte-level pre-tokenizer cuts a text into pieces from
left to right without looking back, and each piece is encoded alone; so

* a piece's count can be remembered, and texts of ordinary length are sums over their pieces. Pieces are
  cut by the published pattern where every character is below U+0250, on which this and the library agree; other texts, and texts that hold an added token's string, go to the
  library whole;
* a huge text is encoded in overlapping chunks with offsets. A position of the overlap where both chunks
  start a new piece, far enough from the first chunk's end for no look-ahead or added token to reach
  past it, is a stable boundary: what follows depends only on the text from there on. The counts are
  spliced at it. If an overlap has none (a run without any boundary), it is doubled, up to the whole rest.

A row holds at most one chunk's encoding at a time. Null counts as empty; repeated rows keep a row each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, table

#: Characters of a chunk and of the first overlap tried; texts longer than a chunk are huge.
CHUNK = 60_000
OVERLAP = 400
#: Pieces remembered by a worker; when so many are known it starts anew.
REMEMBERED = 400_000

#: The pattern of the vocabulary's pre-tokenizer.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile(r"[^\x00-\x1b\x20-ɏ]")


class Counter:
    """Counts tokens as the library does for one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.margin = 16 + max(map(len, added), default=0)
        self.chunk, self.overlap = chunk, max(overlap, 4 * self.margin)
        self.pieces = regex.compile(PIECE).findall
        self.known: dict[str, int] = {}

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        whole: list[int] = []
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.huge(text)
            elif _BEYOND.search(text) or self.added.search(text):
                whole.append(i)
            else:
                out[i] = self.by_pieces(text)
        for start in range(0, len(whole), 64):
            part = whole[start : start + 64]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = len(e.ids)
        return out

    def by_pieces(self, text: str) -> int:
        found, known = self.pieces(text), self.known
        try:
            return sum(map(known.__getitem__, found))
        except KeyError:
            pass
        fresh = [p for p in set(found) if p not in known]
        counts = [len(e.ids) for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(set(found))
            counts = [len(e.ids) for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        known.update(zip(fresh, counts))
        return sum(map(known.__getitem__, found))

    @staticmethod
    def starts(encoding, base: int) -> dict[int, int]:
        """Where pieces start: position in the text -> number of tokens before it in the chunk."""
        out, last = {}, None
        for k, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
            if word is None or word != last:
                out.setdefault(base + a, k)
            last = word
        return out

    def huge(self, text: str) -> int:
        """Chunks that overlap, spliced at stable boundaries. Each chunk starts at the last splice or before it."""
        size, total = len(text), 0
        begin, chunk_end = 0, min(self.chunk, len(text))
        left = self.encode(text[begin:chunk_end])
        skipped = 0  # tokens of `left` that earlier chunks have counted
        while chunk_end < size:
            overlap = self.overlap
            while True:
                start = max(begin, chunk_end - overlap)
                end = min(size, start + self.chunk + overlap)
                right = self.encode(text[start:end])
                ours, theirs = self.starts(left, begin), self.starts(right, start)
                # Not the right chunk's own start: whether a piece starts there, the left chunk alone can say,
                # and it may be inside an added token; one further common boundary settles both.
                common = [p for p in theirs if start < p <= chunk_end - self.margin and p in ours and ours[p] >= skipped]
                if common or start == begin:
                    break
                overlap *= 2
            if common:
                p = max(common)
                total += ours[p] - skipped
                begin, left, skipped = start, right, theirs[p]
            else:  # no boundary in all of the left chunk: the right one starts where it does and reaches further
                left = right
            chunk_end = end
        return total + len(left.ids) - skipped


def _count(path: str, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tickloom.llm.token_counts as here

        counter = here._kept.get((path, chunk, overlap))
        if counter is None:
            counter = here._kept[path, chunk, overlap] = Counter(path, chunk, overlap)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


_kept: dict[tuple[str, int, int], Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: the vocabulary file, readable on every executor."""
    rows = documents(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Every stage of the pipeline against brute force on what the stage before has left, and the whole run."""

import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from test_operators import _edits

from tickloom.llm import toxicity
from tickloom.llm.common import staged, table

COLUMNS = list(corpus_pipeline.COLUMNS)


def _tables(spark, folder):
    """Documents with toxic ones, repeated and nearly repeated lines, near copies, passages of the benchmark, nulls and repeats."""
    random = np.random.default_rng(8)
    words = [f"w{k}x" for k in range(400)]
    sentence = lambda n: " ".join(random.choice(words, n))
    shared, passage = [sentence(12) for _ in range(4)], sentence(30)
    rows, labels = [], []
    for k in range(160):
        lines = [sentence(int(random.integers(8, 30))) for _ in range(int(random.integers(1, 5)))]
        if k % 4 == 0:
            line = shared[k // 4 % 4]
            at = int(random.integers(0, len(line)))
            lines.insert(0, (line, line[:at] + line[at + 1 :], line[:at] + "q" + line[at:] + "z", line[:-3] + "abc")[int(random.integers(0, 4))])
        if k % 7 == 0:
            lines.append("menu")
        if k % 11 == 0:
            lines[-1] += " " + passage[:150]
        if k % 5 == 0:
            lines.append("you vile hateful insult")
        text = "\n".join(lines)
        if k % 13 == 0 and rows:
            text = rows[-1][1] or text
        rows.append((None if k == 50 else k, None if k == 90 else "" if k == 91 else text, "en", None if k % 9 == 0 else f"s{k % 3}", len(text)))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [rows[3], (50, rows[50][1], "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", passage), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def _key(row):
    return (row[0] is None, row[0] or 0)


def _lines(rows):
    """Rows without equal lines, and without those within two edits, one for each 20 characters; rows of one doc_id have one text here."""
    seen, out = [], []
    for row in sorted(rows, key=_key):
        kept, lines = [], (row[1] or "").split("\n")
        for line in lines:
            near = lambda x: x == line or (k := min(2, min(len(x), len(line)) // 20)) > 0 and abs(len(x) - len(line)) <= k and _edits(x, line) <= k  # noqa: E731, B023
            if not (line.strip() and any(near(x) for x in seen)):
                kept.append(line)
            if line.strip():
                seen.append(line)
        if len(kept) == len(lines):
            out.append(row)
        elif kept:
            out.append((row[0], "\n".join(kept), *row[2:4], len("\n".join(kept))))
    return out


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _one_of_each(rows):
    prints, groups = [_fingerprint(r[1]) for r in rows], list(range(len(rows)))
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= 2:
                a, b = groups[i], groups[j]
                groups = [min(a, b) if g in (a, b) else g for g in groups]
    first = {}
    for row, g in zip(rows, groups):
        if g not in first or _key(row) < _key(first[g]):
            first[g] = row
    return list(first.values())


def _clean(rows, passage):
    of = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    items = of(passage)
    windows = {tuple(items[i : i + 13]) for i in range(len(items) - 12)}
    out = []
    for row in rows:
        words, hit = of(row[1]), set()
        for i in range(len(words) - 12):
            if tuple(words[i : i + 13]) in windows:
                hit |= set(range(i, i + 13))
        if not (hit and 20 * len(hit) >= len(words)):
            out.append(row)
    return out


def _same(got, want):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    _tables(spark, out)
    return out


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    passage = table(spark, folder, "benchmark").where("item_id IS NOT NULL").first().text
    brute = (
        lambda rows: [r for r, s in zip(rows, model.scores([toxicity.terms(r[1] or "") for r in rows])) if s < 0.5],
        _lines, _one_of_each, lambda rows: _clean(rows, passage),
    )
    sizes = [docs.count()]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute):
        before = [tuple(r) for r in docs.collect()]
        docs = staged(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        _same(docs.collect(), expected(before))
        sizes.append(docs.count())
    assert all(a > b for a, b in zip(sizes, sizes[1:2] + sizes[3:]))  # toxic ones, copies and contaminated ones go
    want = corpus_pipeline.mix_sources(spark, docs, folder)
    _same(corpus_pipeline.run(spark, folder).collect(), [tuple(r) for r in want.collect()])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

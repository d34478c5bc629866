"""Hostile tables: columns with the operators' own names, nulls, ties, repeats, very long texts, small blocks and buckets."""

import numpy as np
import pytest
from test_operators import PASSAGE, _docs, _vocabulary

from tickloom.llm import chat_format, common, decontaminate, exact_dedup, line_dedup, mixing, secrets, simhash, substring_dedup, token_counts, toxicity

CLASHES = ("row", "fp", "id", "key", "ord", "places", "score", "label", "unique", "part", "start", "spans", "items", "n_words", "__row", "__id", "__maybe", "__text", "__score", "c0", "c1", "content", "place")


def _clashing(spark):
    return spark.createDataFrame([(*r[:2], *range(len(CLASHES)), r.source) for r in _docs(spark).collect()], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in CLASHES) + ", source string")


def test_clashing_columns(spark):
    docs = _clashing(spark)
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(9)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    for kept in (line_dedup.strip_documents(docs), toxicity.harmless(docs, labels), decontaminate.clean_documents(docs, bench), simhash.one_of_each(docs)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and {tuple(r)[2:-1] for r in kept.collect()} == {tuple(range(len(CLASHES)))}
    n = docs.count()
    for out in (
        exact_dedup.find_copies(docs), secrets.find_secrets(docs), line_dedup.dedup_lines(docs), toxicity.toxicity(docs, labels), decontaminate.find_contamination(docs, bench),
        mixing.mix(docs), simhash.near_duplicates(docs), substring_dedup.remove_repeats(docs), token_counts.count_tokens(docs, _vocabulary()),
    ):
        assert out.count() == n


def test_decontamination_in_blocks(spark):
    bench = spark.createDataFrame([("i1", PASSAGE), ("i2", "a"), ("i3", " ".join(PASSAGE.split()[20:40])), ("i4", "same text here"), (None, "x y")], "item_id string, text string")
    whole, parts = (sorted(map(tuple, decontaminate.find_contamination(_docs(spark), bench, block_words=n).collect()), key=str) for n in (500_000, 5))
    assert whole == parts and sum(r[5] for r in whole) > 3
    stripped = {r.doc_id: r.text for r in decontaminate.remove_spans(_docs(spark), bench, block_words=5).collect()}
    assert stripped[8] == "start end" and stripped[4] == stripped[3] == ""


def test_substring_dedup_in_chunks(spark):
    random = np.random.default_rng(3)
    words = [f"v{k}" for k in range(50)]
    blocks = [" ".join(random.choice(words, 45)) for _ in range(6)]
    texts = [" ".join([*random.choice(words, int(random.integers(0, 40))), *(blocks[b] for b in random.integers(0, 6, int(random.integers(0, 3))))]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, parts = (sorted(map(tuple, substring_dedup.remove_repeats(docs, texts=True, **k).collect())) for k in ({}, {"chunk_words": 70, "merged": 100}))
    seen = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for t in texts:
        w = t.split()
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((len(w), len(gone)))
    assert whole == parts and [r[1:3] for r in whole] == want and 0 < sum(n for _, n in want) < sum(n for n, _ in want)


def test_lines_of_many_characters(spark):
    """Two lines of 120,000 characters, one edit apart, and two documents without an id."""
    line = "".join(np.random.default_rng(7).choice(list("abcdefgh "), 120_000))
    rows = [(1, line), (None, line[:70_000] + line[70_001:]), (None, "nobody else has this line of the text")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed, len(r.kept_text)) for r in got) == [(False, 0, 120_000), (True, 0, 37), (True, 1, 0)]


def test_chat_edges(spark):
    path = _vocabulary()
    schema = "conv_id long, turn int, role string, text string, part string, ids string"
    assert chat_format.summarise(chat_format.format_conversations(spark.createDataFrame([], schema), path)).count() == 0
    rows = [(1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(2, k, "assistant" if k % 2 else "us\\er\n", f"turn {k} <\\\\| of many 漢字 <|im_end|> ") for k in range(60)]
    turns = spark.createDataFrame([(*r, "p", "i") for r in rows], schema)
    whole, parts = (sorted(map(tuple, chat_format.summarise(chat_format.format_conversations(turns, path, part=n)).collect()), key=str) for n in (200_000, 100))
    assert whole == parts and [r[:2] for r in whole] == [(1, 3), (2, 60), (None, 2)]
    assert [r[3] for r in whole] == [3, sum(len(r[3]) for r in rows if r[0] == 2 and r[2] == "assistant"), 0]
    for r in chat_format.format_conversations(turns, path).collect():
        assert len(r.ids) == len(r.loss_mask) and r.loss == [t for c, _, role, t in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] or 0, x[2] or "", x[3] or "")) if role == "assistant"]


def test_secrets_take_linear_time(spark):
    text = "token=abcdef1 " * 30_000
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_assign == 30_000 and got.spans.count(",") == 29_999


def test_filter_and_hot_keys(spark):
    """The filter loses no row; a key with most rows is dealt out and joined whole."""
    rows = spark.range(20_000).selectExpr("id AS r", "IF(id % 3 = 0, 7, id) AS k")
    keys = common.staged(rows.groupBy("k").count().where("k % 2 = 1"), "keys")
    want = sorted(r.r for r in rows.where("k % 2 = 1").collect())
    passed = common.maybe_in(rows, "k", keys)
    assert set(want) <= {r.r for r in passed.collect()} and passed.count() < 15_000
    joined = common.spread_join(rows, keys, ["k"], "count", "r")
    assert sorted(r.r for r in joined.collect()) == want
    assert common.spread_join(rows, keys, ["k"], "count", "r", "left").count() == 20_000
    common.discard(keys)
    with pytest.raises(Exception):
        keys.count()


def test_no_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.scratch_dir(Elsewhere)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"insult word{k} " + " ".join(f"t{k}x{j}" for j in range(50))) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    rows, ones = toxicity.sample(docs, labels, max_terms=1000)
    assert 0 < len(rows.flat) <= 1000 and len(rows) == len(ones) > 5
    assert len(toxicity.sample(docs, labels, max_rows=7)[0]) == 7


def test_toxicity_held_out(spark):
    """Recall and precision on rows whose labels and texts the fit never sees."""
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(r.predicted, r.toxic): r["count"] for r in got}
    right = n.get((1, 1), 0)
    assert right / (right + n.get((0, 1), 0)) > 0.85 and right / (right + n.get((1, 0), 0)) > 0.95

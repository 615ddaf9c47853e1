"""Ids in very many rows, and folders with odd names."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, sketch, suffix


def expected(data):
    """What follows what, in the order of ids and, where one has several texts, of any order of them: pairs that must come out."""
    return Counter((d, len(t or "")) for d, t in data)


@pytest.mark.parametrize("hot", [None, -7, 40, 10**6])
@pytest.mark.parametrize("texts", [1, 3, 400])
def test_hot_ids(spark, hot, texts):
    data = [(i, f"text {i} of the others " * (1 + i % 3)) for i in range(300)]
    data += [(hot, f"hot text {i % texts} and more of it {i % texts}" if i % texts or texts == 1 else None) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    placed = sketch.in_order_with_next(df, "doc_id", "text")
    sizes = [r["count"] for r in placed.where("own").groupBy("bucket").count().collect()]
    assert placed.where("own").agg(F.sum("n")).first()[0] == 1000
    assert max(sizes) <= 200, sizes
    got = sketch.fingerprint(df).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == expected(data)
    # the edited texts are those of one ring through all documents, in the order of ids
    key = lambda d: (d[0] is not None, d[0] or 0)
    full = [(d, t or "") for d, t in data]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t for _, t in full}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    is_hot = bool(placed.where("h <> 0").count())
    assert is_hot
    ring = sorted(full, key=lambda d: (*key(d), hashes[d[1]] if d[0] == hot else 0, d[1]))
    want = Counter()
    for (d, t), (_, nxt) in zip(ring, [*ring[1:], ring[0]], strict=True):
        half = len(t) // 2
        want[d, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_one_row_for_all(spark):
    df = spark.range(25_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a b c d e f g").alias("text"))
    got = sketch.fingerprint(df).groupBy("doc_id", "near_edited", "near_next").count().collect()
    assert [(r["doc_id"], r["near_next"], r["count"]) for r in got] == [(3, 1.0, 25_000)]


def test_repeats_in_a_folder_with_an_odd_name(spark, tmp_path, monkeypatch):
    folder = tmp_path / "shared # of %20 it"
    folder.mkdir()
    # as if spark.checkpoint.dir named it
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{folder}")
    passage = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5))
    df = spark.createDataFrame([(1, "x" + passage), (2, "y" + passage + "z"), (3, "other")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(df).collect()}
    assert any(folder.iterdir())
    assert got == {1: (320, 1), 2: (320, 1), 3: (0, 0)}

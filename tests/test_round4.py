"""Indexes of very many documents: what their joins and their compaction move."""

from pyspark.sql import functions as F

from leafmill.plans import blocks as B
from leafmill.plans.index import Index


def documents(spark, start, n, text):
    return spark.range(start, start + n).selectExpr("CAST(id AS STRING) AS uri", f"{text} AS content", "'TXT' AS parser")


def test_documents_are_not_collected_for_joins(spark, tmp_path, monkeypatch):
    """Joins of documents are shuffled, whatever their compressed columns seem to hold; compaction unpacks no block."""
    plans, real = {}, Index._write

    def noted(self, folder, name, df, **options):
        out = real(self, folder, name, df, **options)
        plans.setdefault(name, []).append(df._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(Index, "_write", noted)
    monkeypatch.setattr(B, "SENT_DOCS", 10, raising=False)
    index = Index(spark, str(tmp_path / "i"))
    index.add(documents(spark, 0, 100, "'ant'"))
    index.add(documents(spark, 0, 100, "concat('bee ', id % 7)"))
    index.delete(documents(spark, 0, 20, "''").select("uri"))
    assert len(plans["gone"]) == 2 and not any("BroadcastHashJoin [uri" in p for name in ("docs", "gone") for p in plans[name])
    # of the blocks and the bitmaps, the latter are sent
    less = [p for k in plans if len(k) == 32 for p in plans[k] if "arrays_zip" in p]
    assert len(less) == 2 and all("rightHint=(strategy=broadcast)" in p for p in less)
    plans.clear()
    index.compact()
    assert "Generate" not in plans["blocks"][0] and not any("uri" in p for p in plans["blocks"])
    t = index.tables()
    assert t.search("bee").count() == 80 and t.search("ant").count() == 0 and t.search("3").count() == 11
    assert not any("BroadcastHashJoin" in x._jdf.queryExecution().toString() for x in (t.with_uri(t.blocks.select("segment", F.explode("docs").alias("doc"))),))


def test_small_chunks_are_put_together(spark, tmp_path, monkeypatch):
    """Chunks that are half full or less share a new one, live documents keep their order, and nothing is left of dead ones."""
    monkeypatch.setattr(B, "CHUNK_BITS", 3)
    index = Index(spark, str(tmp_path / "i"))
    for i in range(5):
        index.add(documents(spark, 20 * i, 20, "concat('ant ', id, ' ant ', IF(id % 2 = 0, 'even', 'odd'))").coalesce(1))
    gone = [str(i) for i in range(100) if i % 3 == 0 or 40 <= i < 55]
    index.delete(gone)
    before = {r["uri"]: r["nwords"] for r in index.tables().docs.collect()}
    blocks = index.tables().blocks.where("term = 'ant'").count()
    terms = sorted(map(tuple, index.terms().collect()))
    index.compact()
    t = index.tables()
    numbers = {r["uri"]: r["doc"] for r in t.docs.collect()}
    live = [str(i) for i in range(100) if str(i) not in gone]
    assert {r["uri"]: r["nwords"] for r in t.docs.collect()} == before and sorted(numbers) == sorted(live) and len(set(numbers.values())) == len(live)
    heads = t.blocks.where("term = 'ant'").collect()
    assert len(heads) < blocks and all(r["docs"] == sorted(r["docs"]) and len(r["docs"]) == r["n"] <= 8 and {d >> 3 for d in r["docs"]} == {r["chunk"]} for r in heads)
    assert sum(r["cf"] for r in heads) == 2 * len(live) and sorted(d for r in heads for d in r["docs"]) == sorted(numbers.values())
    assert sorted(map(tuple, index.terms().collect())) == terms
    assert {r["uri"] for r in t.search('"ant even"').collect()} == {u for u in live if int(u) % 2 == 0}
    place = t.postings.where("term = 'odd'").select("uri", "pos").collect()
    assert {(r["uri"], r["pos"]) for r in place} == {(u, 4) for u in live if int(u) % 2}


def test_dictionary_reads_blocks_once(spark):
    rows = [("a", "m", 0, 3, 5, 2, 0), ("a", "m", 1, 2, 2, 1, 0), ("a", "t", 0, 2, 3, 7, 1), ("a", "k", 0, 9, 9, 9, 0), ("b", "t", 0, 1, 1, 1, 0)]
    blocks = spark.createDataFrame(rows, "term string, meta string, chunk long, n int, cf long, max_tf int, shared int")
    got = B.dictionary(blocks, ["m", "t"])
    assert sorted(map(tuple, got.select("meta", "term", "df", "cf", "max_tf").collect())) == [("", "a", 6, 10, 9), ("", "b", 1, 1, 1), ("k", "a", 9, 9, 9), ("m", "a", 5, 7, 2), ("t", "a", 2, 3, 7), ("t", "b", 1, 1, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert not [r for r in B.dictionary(blocks, []).collect() if r["meta"] == B.BOTH]


def test_words_are_ordered_by_one_key():
    import numpy as np

    some = np.random.default_rng(4)
    for terms, chunks in ((1, 1), (50, 1), (50, 7), (1 << 30, 1 << 40)):
        term, meta, chunk = some.integers(0, terms, 5000).astype(np.int32), some.integers(0, 3, 5000).astype(np.int32), some.integers(0, chunks, 5000)
        assert (B._ordered(term, meta, chunk) == np.lexsort((chunk, meta, term))).all()

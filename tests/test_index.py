"""The stored index: blocks, dictionary, bitmaps, log, pages without scoring all; against tables in memory."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.plans import blocks as B
from leafmill.plans.commits import Log
from leafmill.plans.index import Index, analyzed_tables
from leafmill.plans.query import Tables
from leafmill.plans.rank import promising, ranked, top
from leafmill.plans.results import sorted_hits
from leafmill.streaming.ingest import upsert_stream

WORDS = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen"]


def frame(spark, rows):
    return spark.createDataFrame([(u, t, "XML", i) for i, (u, t) in enumerate(rows)], "uri string, content string, parser string, seq long")


def texts(seed, uris):
    rng = random.Random(seed)
    out = []
    for u in uris:
        body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
        out.append((u, f"<d><title>{rng.choice(WORDS)} {rng.choice(WORDS)}</title>{body}<k>{rng.choice(WORDS)} {rng.choice(WORDS)}</k></d>"))
    return out


CONFIG = "<c><MetaNames><k bias='3'/><title/></MetaNames></c>"
SEARCHES = ["ant or bee not cat", "k:(ant bee)", '"ant bee"', '"cat cat"', '"ant bee ant"', "el*", "not ant"]
RANKED = ["ant or k:bee", '"fox gnu" or hen', "ant or el*"]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    """An index after adding, replacing, skipping and deleting, and the same documents in memory."""
    path = str(tmp_path_factory.mktemp("i") / "index of % it")
    index = Index(spark, path, Config.read(CONFIG))
    one, two, three = texts(1, [f"u{i}" for i in range(120)]), texts(2, [f"u{i}" for i in range(60, 160)]), texts(3, [f"u{i}" for i in range(150, 200)])
    assert index.add(frame(spark, one)) == 120 and index.add(frame(spark, two)) == 100
    assert index.add(frame(spark, three), skip_known=True) == 40
    gone = [f"u{i}" for i in range(0, 200, 7)]
    assert index.delete([*gone, "none"]) == (len(gone), ["none"])
    live = dict(one) | dict(two) | {u: t for u, t in three if int(u[1:]) >= 160}
    live = [(u, t) for u, t in live.items() if u not in gone]
    t = analyzed_tables(frame(spark, live), index.config)
    plain = Tables(index.config, *(t[n].cache() for n in ("docs", "postings", "props")))
    return index, plain


def rows(df):
    return sorted(map(tuple, df.collect()))


def same(index, plain):
    t = index.tables()
    every = lambda x: reduce(DataFrame.unionByName, [x.search(q).withColumn("q", F.lit(q)) for q in SEARCHES])
    scored = lambda x: reduce(DataFrame.unionByName, [ranked(x, q).select("uri", F.round("score", 9).alias("score"), F.lit(q).alias("q")) for q in RANKED])
    assert rows(every(t)) == rows(every(plain)) and rows(scored(t)) == rows(scored(plain))
    place = ["uri", "meta", "context", "term", "pos", "len"]
    assert rows(t.postings.select(place)) == rows(plain.postings.select(place))
    want = plain.postings.groupBy("meta", "term", "uri").agg(F.count("*").alias("n")).groupBy("meta", "term").agg(F.count("*"), F.sum("n"))
    assert rows(index.terms()) == rows(want)
    both = plain.postings.where(F.col("meta").isin(index._both)).groupBy("term").agg(F.count_distinct("uri"))
    assert rows(t.terms.where(F.col("meta") == B.BOTH).groupBy("term").agg(F.sum("df").alias("n")).where("n > 0")) == rows(both)
    assert (t.n_docs, t.n_words) == tuple(plain.docs.agg(F.count("*"), F.sum("nwords")).first())


def test_stored_equals_memory(pair):
    index, plain = pair
    same(index, plain)
    plan = index.tables().search("ant")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # that of the query; none over documents


def test_pages_skip_blocks(pair):
    index, plain = pair
    t = index.tables()
    for q, size, begin in (("ant or bee", 3, 0), ("ant and bee not cat", 5, 4), ("k:ant or title:bee", 500, 0), ("not ant", 3, 0)):
        want = sorted_hits(plain, ranked(plain, q), max=size, begin=begin).collect()
        got = top(t, q, size, begin=begin, first=1).collect()
        assert [(r["uri"], round(r["score"], 9)) for r in got] == [(r["uri"], round(r["score"], 9)) for r in want], (q, size)


def test_pages_read_few_blocks(spark, tmp_path, monkeypatch):
    """With 30 chunks of which two hold the best documents, the blocks of the others are not unpacked."""
    monkeypatch.setattr(B, "CHUNK_BITS", 6)
    docs = [(f"v{i:05d}", "<d>" + ("rare " * 30 if i in (70, 700) else "rare") + " filler" * (20 + i % 7) + "</d>") for i in range(1920)]
    index = Index(spark, str(tmp_path / "i"))
    index.add(frame(spark, docs).repartition(2))
    t = index.tables()
    assert t.blocks.where("term = 'rare'").count() >= 30
    chunks = promising(t, "rare or filler", 2, first=2)
    assert chunks.count() <= 4 and t.within(chunks).blocks.where("term = 'rare'").count() <= 4
    assert [r["uri"] for r in top(t, "rare or filler", 2, first=2).collect()] == ["v00070", "v00700"]


def test_compaction(spark, pair, tmp_path):
    index, plain = pair
    before = len(index.segments())
    index.compact(most_docs=80)
    assert 1 < len(index.segments()) < before
    t = index.tables()
    want = plain.docs.agg(F.count("*"), F.sum("nwords")).first()
    assert rows(t.search("ant or not bee")) == rows(plain.search("ant or not bee")) and (t.n_docs, t.n_words) == tuple(want)
    index.compact()
    assert len(index.segments()) == 1 and index.log.state().dead is None
    same(index, plain)
    index.compact()


def test_two_writers(spark, tmp_path, monkeypatch):
    """A commit that came first makes the other prepare anew: both survive, and the later one counts."""
    path = str(tmp_path / "i")
    first, second = Index(spark, path), Index(spark, path)
    first.add(frame(spark, [("a", "<d>zero</d>"), ("b", "<d>zero</d>")]))
    raced = []
    real = Index._segment

    def racing(self, folder, rows):
        real(self, folder, rows)
        if not raced:
            raced.append(1)
            second.add(frame(spark, [("a", "<d>second</d>"), ("c", "<d>second</d>")]))

    monkeypatch.setattr(Index, "_segment", racing)
    assert first.add(frame(spark, [("a", "<d>first</d>"), ("d", "<d>first</d>")])) == 2
    found = lambda q: [r[0] for r in rows(Index(spark, path).tables().search(q))]
    assert found("first") == ["a", "d"] and found("second") == ["c"] and found("zero") == ["b"]
    raced.clear()
    assert first.add(frame(spark, [("c", "<d>third</d>"), ("e", "<d>third</d>")]), skip_known=True) == 1
    assert found("third") == ["e"] and found("second") == ["a", "c"]
    assert Log(spark, f"{path}/log").state().version == 5


def test_put_if_absent_and_replayed_batches(spark, tmp_path):
    from leafmill.sources import storage

    path = str(tmp_path / "x y%.json")
    assert storage.put_if_absent(spark, path, "one") and not storage.put_if_absent(spark, path, "two") and storage.read_text(spark, path) == "one"
    index = Index(spark, str(tmp_path / "i"))
    docs = frame(spark, [("a", "<d>one</d>")])
    assert index.add(docs, batch=("s", 0)) == 1 and index.add(docs, batch=("s", 0)) == 0 and len(index.segments()) == 1
    assert index.add(docs, batch=("s", 1)) == 1 and index.add(docs, batch=("other", 0)) == 1
    assert index.delete(["a"], batch=("s#delete", 3))[0] == 1 and index.tables().search("one").count() == 0
    assert index.delete(["a"])[0] == 0


def test_stream_replays_nothing(spark, tmp_path):
    index, source = Index(spark, str(tmp_path / "i")), str(tmp_path / "in")
    frame(spark, [("a", "<d>one</d>"), ("b", "<d>one</d>")]).withColumn("action", F.lit("update")).write.parquet(source)
    stream = lambda: spark.readStream.schema("uri string, content string, parser string, seq long, action string").parquet(source)
    upsert_stream(stream(), index, str(tmp_path / "cp"), once=True).awaitTermination()
    n = len(index.segments())
    # the stream's own record of the batch is lost, so it comes again
    import shutil

    shutil.rmtree(tmp_path / "cp" / "commits")
    upsert_stream(stream(), index, str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(index.segments()) == n == 1 and rows(index.tables().search("one")) == [("a",), ("b",)]


def test_bitmaps(spark):
    dead = spark.createDataFrame([(1, d) for d in (0, 63, 64, 4095, 4096, 10_000)] + [(2, 5), (2, 5)], "segment int, doc long")
    bits = B.bitmaps(dead.where("segment = 2 or doc > 4000"), B.bitmaps(dead.where("segment = 1 and doc < 4000")))
    every = spark.range(12_000).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("segment"), F.col("id").alias("doc"))
    left = B.alive(every, bits)
    assert left.count() == 36_000 - 7 and rows(every.exceptAll(left)) == rows(dead.distinct())
    assert B.alive(every, None) is every


def test_empty_and_odd_documents(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    assert index.add(frame(spark, []).limit(0)) == 0 and index.segments() == [] and index.delete(["a"]) == (0, ["a"])
    assert index.add(frame(spark, [("e", "<d></d>"), (None, "<d>x</d>"), ("f", "<d>x</d>"), ("f", "<d>y</d>")]), seq="seq") == 2
    assert rows(index.tables().search("y")) == [("f",)] and rows(index.tables().search("not y")) == [("e",)] and index.tables().search("x").count() == 0


def test_dictionary_without_comparing_documents(spark, tmp_path, monkeypatch):
    """New blocks know what title and text share, and are written once."""
    written, real = [], Index._write
    monkeypatch.setattr(Index, "_write", lambda self, folder, name, df, **o: written.append(name) or real(self, folder, name, df, **o))
    monkeypatch.setattr(B, "CHUNK_BITS", 3)
    index = Index(spark, str(tmp_path / "i"))
    docs = [(f"u{i}", f"<d><title>ant {WORDS[i % 8]}</title>{WORDS[i % 5]} {'ant' if i % 3 else 'bee'} bee</d>") for i in range(60)]
    index.add(frame(spark, docs).repartition(3))
    assert "blocks" in written and "_blocks" not in written
    blocks = index.tables().blocks
    new, old = B.dictionary(blocks, index._both), B.dictionary(blocks.drop("shared"), index._both)
    assert "collect_list" not in new._jdf.queryExecution().toString()
    assert rows(new.select("meta", "term", "df", "cf")) == rows(old.select("meta", "term", "df", "cf"))
    assert rows(new.where("meta = '' and term = 'ant'").select("df")) == [(60,)]


def test_frequent_terms_have_several_parts(spark):
    """A term that is a bound several times is spread by its chunks; others stay together, in order."""
    docs = spark.createDataFrame([(d << 12, 3, [{"meta": "m", "context": "m", "words": ["a", "the", "z"]}]) for d in range(40)], "doc long, nwords long, words array<struct<meta:string,context:string,words:array<string>>>")
    found = B.blocks(docs.coalesce(1), None, ["m", "t"], ["b", "the", "the", "the"])
    parts = {t: {r["part"] for r in found.where(F.col("term") == t).select("part").collect()} for t in ("a", "the", "z")}
    assert parts == {"a": {0}, "the": {1, 2, 3, 4}, "z": {4}}
    some = docs.select(B.some_words("words", "doc").alias("some"))
    assert B.term_bounds(some.limit(0), 4) == [] and len(B.term_bounds(docs.select(F.col("words")[0]["words"].alias("some")), 4)) == 3

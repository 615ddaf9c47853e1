"""Registered queries on tables of other shapes than those of the small samples."""

import __spark_entry__ as entry


def test_stream_totals_of_a_table_of_many_files(spark, tmp_path):
    spark.createDataFrame([(i, "one two") for i in range(40)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in entry.queries()["stream_totals"](spark, str(tmp_path)).collect()] == [(40, 80)]


def test_normalized_words_of_pages_with_one_url(spark, tmp_path):
    rows = [(i, url, f"<p>w{i}</p>") for i, url in enumerate(["http://a/x.html", "http://a/x.html", "http://a/y.html", None])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = entry.queries()["normalized_words"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["words"]) for r in found) == [(0, ["w0"]), (1, ["w1"]), (2, ["w2"])]


def test_words_are_cut_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from leafmill.operators import tokens as T

    texts = ["_" * 250 + "abcdefghij", "x" * 253 + "𐐨字éaéb", "a" + "字" * 90 + "b" + "é" * 9, "é" * 1_000_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    start = time.time()
    found = [r["w"] for r in rows.select(T.tokens(F.col("t"), T.PLAIN_LETTERS).alias("w")).collect()]
    assert time.time() - start < 60
    want = [["abcdef", "ghij"], ["x" * 253 + "字", "éaéb"], ["a" + "字" * 85, "字" * 5 + "b" + "é" * 9], ["é" * 128] * 7812 + ["é" * 64]]
    assert sorted(found) == sorted(want)


def test_escapes_run_without_python(spark):
    from leafmill.functions import columns as C
    from leafmill.functions import words as W

    texts = ["a\\é字𐐨\0\x07\n\x7f~", "\\", "\\x", "\\x4", "\\u00e9\\U0001F600\\777\\q\\a", "\\UFFFFFFFF", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape_utf8("t").alias("e"), C.unescape_utf8("t").alias("u"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(r["e"] == W.escape_text(r["t"]) and r["u"] == W.unescape_text(r["t"]) for r in df.collect())


def test_files_of_rows_are_written_by_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafmill.sources import listing

    folder = str(tmp_path / "in")
    rows = spark.range(3000).repartition(5).select((F.col("id") % 3).cast("string").alias("within"), F.concat("id", F.lit("\n")).alias("content"))
    listing.write_each(rows, folder)
    found = listing.read_listed(listing.listed(spark, folder)).collect()
    assert sorted(int(r["content"]) for r in found if r["content"]) == list(range(3000))
    assert [(r["uri"].split("/")[-1], r["error"]) for r in found if not r["content"]] == [("_SUCCESS", "empty")]


def test_folders_are_told_without_asking_for_files(tmp_path):
    from leafmill.sources import listing

    for name in ("a", "b", ".c"):
        (tmp_path / name).mkdir()
    (tmp_path / "x").write_text("x")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "b" / "side").symlink_to(tmp_path / "a")
    for links in (False, True):
        for place in (tmp_path, tmp_path / "a", tmp_path / "b"):
            assert listing._folders(str(place), links) == listing._entries(str(place), links)[0]


def test_words_that_a_task_holds_are_bounded(monkeypatch):
    import pyarrow as pa

    from leafmill.plans import blocks as B

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    sizes, built = [], B._built
    monkeypatch.setattr(B, "HELD_WORDS", 1000)
    monkeypatch.setattr(B, "_built", lambda held, *x: sizes.append(sum(b.num_rows for b in held)) or built(held, *x))
    words = [[{"meta": "m", "context": "m", "words": ["a", "b"] * 10}]] * 5000
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array([20] * 5000, pa.int64()), pa.array(words)], names=["doc", "nwords", "words"])
    out = pa.Table.from_batches(B.blocks(Rows())(iter([batch])))
    assert max(sizes) * 20 < 1000 + 64 * 20 and sum(out["cf"].to_pylist()) == 100_000


def test_ranked_queries_split_texts_once(spark):
    """What is ranked reads stored counts; no plan of a result splits texts again."""
    found = entry.queries()["bm25_topk"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()


def test_narrowed_tables_rank_as_whole_ones(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafmill.plans.rank import ranked
    from leafmill.queries import corpus

    rows = [(1, "Thing thing, ing", "there"), (2, "ing'ing there\x03thing", "thing"), (3, "", "b"), (4, None, "ing"), (5, "things ing", None), (None, "thing", "a")]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    t = corpus(spark, str(tmp_path))
    for i, q in enumerate(("thing ing there", "thing* not ing", "source:thing or ing", "there and lang:a..z", '"thing ing" or there')):
        one, two = (sorted((r["uri"], r["score"]) for r in ranked(x, q).select("uri", F.round("score", 9).alias("score")).collect()) for x in (t, t.narrowed(q, str(tmp_path / f"q{i}"))))
        assert one == two and one, q


def test_words_with_and_without_gaps_are_the_same(spark):
    from pyspark.sql import functions as F

    from leafmill.operators import tokens as T

    texts = ["Añb ß9 d'e_ _f", "''x'' __y", "İI Σ字", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [r[0] for r in df.select(T.tokens(F.col("t"))).collect()]
    gapped = [r[0] for r in df.select(T.tokens(F.concat("t", F.lit("\x03")))).collect()]
    assert plain == gapped == [["añb", "ß9", "d'e", "f"], ["x", "y"], ["ii", "σ字"], []]


def test_batches_of_an_index_are_small(spark, tmp_path, monkeypatch):
    """Workers get few documents at a time, and the session's own bounds are back afterwards."""
    from leafmill.plans import blocks as B
    from leafmill.plans.index import Index

    (seen := tmp_path / "seen").mkdir()
    folder, built = str(seen), B.blocks

    def note(batches):
        import uuid

        for b in batches:
            open(f"{folder}/{uuid.uuid4().hex}-{b.num_rows}", "w").close()
            yield b

    def spied(rows, *x):
        rows = rows.select("doc", "nwords", "words")
        return built(rows.mapInArrow(note, rows.schema), *x)

    monkeypatch.setattr(B, "blocks", spied)
    names = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before = [spark.conf.get(k, None) for k in names]
    index = Index(spark, str(tmp_path / "index"))
    assert index.add(spark.range(16_000).selectExpr("CAST(id AS STRING) AS uri", "'ant bee' AS content", "'TXT' AS parser")) == 16_000
    sizes = [int(p.name.split("-")[1]) for p in seen.iterdir()]
    assert sum(sizes) == 16_000 and max(sizes) <= 1000
    assert [spark.conf.get(k, None) for k in names] == before


def test_documents_without_words_that_a_task_holds_are_bounded(monkeypatch):
    """Documents of no or few words take room too; what was held is let go before blocks are written."""
    import pyarrow as pa

    from leafmill.plans import blocks as B

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    lists, sizes, built = [], [], B._built

    def noted(held, *x):
        sizes.append(sum(b.num_rows for b in held))
        lists.append(held)
        return built(held, *x)

    monkeypatch.setattr(B, "HELD_WORDS", 1000)
    monkeypatch.setattr(B, "_built", noted)
    piece = lambda words: [{"meta": "m", "context": "m", "words": words}]
    kind = pa.list_(pa.struct([("meta", pa.string()), ("context", pa.string()), ("words", pa.list_(pa.string()))]))
    words = pa.array([piece([])] * 2000 + [[]] * 2000 + [None] * 2000 + [piece(["a"])] * 2000, kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array([0] * 6000 + [1] * 2000, pa.int64()), words], names=["doc", "nwords", "words"])
    held = []
    out = []
    for b in B.blocks(Rows())(iter([batch])):
        held.append(sum(x.num_rows for x in lists[-1]))
        out.append(b)
    assert sum(sizes) == 8000 and max(sizes) <= 1000 + 64
    assert sum(pa.Table.from_batches(out)["cf"].to_pylist()) == 2000 and set(held) == {0}

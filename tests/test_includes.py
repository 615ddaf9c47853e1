"""Documents that include others of their table, against a walk in plain Python; byte-exact words and one-to-one case."""

import random

from pyspark.sql import functions as F

from leafmill.config import Config
from leafmill.functions import columns as C
from leafmill.functions.words import escape_text, unescape_text
from leafmill.operators import analyze as A
from leafmill.operators import tokens as T
from leafmill.operators.includes import included
from leafmill.operators.markup import resolved
from leafmill.plans.index import Index

XI = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
CONFIG = "<c><MetaNames><k/></MetaNames><PropertyNames><k/></PropertyNames></c>"


def doc(text, *hrefs, kind=""):
    return f"<d {XI}>{text} <k>{text}</k>" + "".join(f'<xi:include href="{h}"{kind}/>' for h in hrefs) + "</d>"


def frame(spark, docs):
    return spark.createDataFrame([(u, t, "XML") for u, t in docs], "uri string, content string, parser string")


def whole(spark, docs, path):
    df = frame(spark, docs)
    A.analyze(df, Config.read(CONFIG)).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/found")
    got = included(spark.read.parquet(f"{path}/found"), df, Config.read(CONFIG), str(path), "row")
    return {r["uri"]: r for r in got.collect()}


def test_included_documents_against_a_walk(spark, tmp_path):
    rng = random.Random(5)
    links = {f"a/{i}.xml": [rng.choice([f"{rng.randrange(40)}.xml", f"../a/{rng.randrange(40)}.xml", f"none{i}.xml"]) for _ in range(rng.choice([0, 0, 1, 2]))] for i in range(40)}
    links["a/0.xml"] = ["0.xml"]
    got = whole(spark, [(u, doc(u.replace("/", "").replace(".", ""), *h)) for u, h in links.items()], tmp_path)

    def walk(u, above):
        values, warnings = [u.replace("/", "").replace(".", "")], []
        for h in links[u]:
            to = resolved(u, h)
            if to in above:
                warnings.append(f"includes itself: {to}")
            elif to not in links:
                warnings.append(f"cannot include {to}")
            else:
                more = walk(to, [*above, to])
                values, warnings = values + more[0], warnings + more[1]
        return values, warnings

    assert set(got) == set(links)
    for u in links:
        values, warnings = walk(u, [u])
        assert got[u]["properties"].get("k") == values, u
        assert got[u]["metas"]["k"] == values and sorted(got[u]["warnings"]) == sorted(warnings)


def test_includes_of_text_nulls_repeats_and_no_rows(spark, tmp_path):
    docs = [("m", doc("one", "t", kind=' parse="text"')), ("t", "<b>plain</b>"), (None, doc("null", "t")), ("m2", doc("two", "e")), ("e", None), ("s", doc("self", "s", kind=' parse="text"')), ("t", "<a/>")]
    got = whole(spark, docs, tmp_path / "x")
    assert [p["text"].strip() for p in got["m"]["pieces"] if "plain" in p["text"]] == ["<b>plain</b>"]
    assert got[None]["properties"]["k"] == ["null"] and "plain" in "".join(p["text"] for p in got[None]["pieces"])
    assert "empty document" in got["m2"]["warnings"]
    assert "xi:include" in "".join(p["text"] for p in got["s"]["pieces"])
    assert whole(spark, docs[:0], tmp_path / "y") == {}
    assert [w for w in whole(spark, [("q", doc("q", "/etc/hostname"))], tmp_path / "z")["q"]["warnings"]] == ["cannot include /etc/hostname"]


def test_part_that_is_refused(spark, tmp_path):
    df = frame(spark, [("a", f'<k {XI}>x<xi:include href="b"/></k>'), ("b", "<other/>"), ("c", "<k>y</k>")])
    config = Config.read("<c><MetaNames><k/></MetaNames><UndefinedMetaTags>error</UndefinedMetaTags></c>")
    config.add_meta("include")
    A.analyze(df, config).write.parquet(f"{tmp_path}/found")
    got = {r["uri"]: r["error"] for r in included(spark.read.parquet(f"{tmp_path}/found"), df, config, str(tmp_path)).collect()}
    assert got["a"] == got["b"] == "XML tag other is not a defined metaname" and got["c"] is None


def test_index_takes_in_includes_of_its_batch(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), Config.read(CONFIG))
    docs = [(f"m{i}", doc(f"main{i}", "shared")) for i in range(30)] + [("shared", doc("common", "deep")), ("deep", doc("bottom"))]
    assert index.add(frame(spark, docs)) == 32
    t = index.tables()
    assert t.search("bottom").count() == 32 and t.search("k:common").count() == 31 and t.search("k:main7").count() == 1
    assert t.docs.where("uri = 'm3'").first()["nwords"] == 6


def plain_cut(word, size):
    out, own = [], ""
    for c in word:
        if len((own + c).encode()) <= size:
            own += c
        if len(own.encode()) >= size:
            out, own = [*out, own], ""
    return [*out, own] if own else out


def test_long_words_are_cut_by_bytes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé字𐐨_'") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["é" * 127 + "a字b" + "c" * 300, "x" * 600, "'" + "é" * 200, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["w"] for r in df.select("id", T.tokens(F.col("text")).alias("w")).collect()}
    for i, t in enumerate(texts):
        want = [w.strip("'_") for w in plain_cut(t, 256)]
        assert got[i] == [w for w in want if w], t
        assert all(len(w.encode()) <= 256 for w in got[i])
    short = spark.createDataFrame([("字é",)], "t string").select(T.tokens(F.col("t"), max_word=2).alias("w")).first()["w"]
    assert short == ["é"]


def test_lower_case_keeps_the_number_of_characters(spark):
    texts = ["İstanbul İİ", "ΟΔΟΣ ΣΑΣ", "ẞ Ä ǅ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.lower("t").alias("low"))
    for r in df.collect():
        assert (r["low"] is None) == (r["t"] is None)
        if r["t"] is not None:
            assert len(r["low"]) == len(r["t"])
    assert C.words.fold_case("İΣ ΟΔΟΣ") == "iσ οδοσ"
    assert df.where("t = 'ΟΔΟΣ ΣΑΣ'").first()["low"] == "οδοσ σασ"


def test_escapes_of_controls_before_hex_digits():
    for text in ("\x01A", "\x0fF0", "\x7f1", "é\x02é"):
        text = text.encode().decode("unicode_escape")
        assert unescape_text(escape_text(text)) == text

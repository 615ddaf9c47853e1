"""Parsing, fields, tokens, configuration, sources, search and index of the engine."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from leafmill import __main__ as cli
from leafmill.api import Analyzer, Engine
from leafmill.config import GAP, Config, ConfigError, validate
from leafmill.functions import columns as C
from leafmill.functions import words as W
from leafmill.operators import analyze as A
from leafmill.operators import markup as M
from leafmill.operators import stem
from leafmill.operators import tokens as T
from leafmill.plans import query as Q
from leafmill.plans.index import Index
from leafmill.plans.rank import ranked, with_percent
from leafmill.plans.results import facets, parse_template, rendered, sort_spec, sorted_hits
from leafmill.sources import files, framed, mime, tables


def words(analysis):
    return [w for _, _, t in analysis.pieces for part in t.split(GAP) for w in Q.split_text(part)]


def config(body):
    return Config.read(f"<c>{body}</c>")


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


# ---- tokens

CASES = {
    "foobar": ["foobar"], "++foo++": ["foo"], "布朗在迅速跳下懒狐狗": ["布朗在迅速跳下懒狐狗"], "http://FOOBAR.COM/": ["http", "foobar", "com"],
    "can't 'quoted' _x_ a_b": ["can't", "quoted", "x", "a_b"], "x₂ y²": ["x", "y"], "Ünï Ça 12,5": ["ünï", "ça", "12", "5"], "": [], " ' ": [],
}


def test_tokens(spark):
    assert one(spark, T.tokens, *CASES) == list(CASES.values())
    assert [Q.split_text(k) for k in CASES] == list(CASES.values())
    assert [[t.value for t in Engine().tokenize(k)] for k in CASES] == list(CASES.values())


def test_long_words_are_cut(spark):
    got = one(spark, T.tokens, "a" * 600 + " b")[0]
    assert [len(w) for w in got] == [256, 256, 88, 1]
    assert one(spark, lambda c: T.tokens(c, min_word=4), "ab abc abcd")[0] == ["abc", "abcd"]


def test_positions_and_gaps(spark):
    df = spark.createDataFrame([("d", [("m", "m", f"now is{GAP}time"), ("n", "m/n", "to be")])], "uri string, pieces array<struct<meta:string,context:string,text:string>>")
    got = [(r["term"], r["pos"], r["meta"], r["context"], r["len"]) for r in T.postings(df).orderBy("pos").collect()]
    assert got == [("now", 1, "m", "m", 3), ("is", 2, "m", "m", 2), ("time", 4, "m", "m", 4), ("to", 5, "n", "m/n", 2), ("be", 6, "n", "m/n", 2)]
    assert one(spark, T.pattern_tokens, "It’s Bob's_x y-z")[0] == ["It’s", "Bob's_x", "y", "z"]


# ---- markup

def test_html_inline_tags_glue_and_blocks_part():
    got = M.parse_html("<html><body><p>one<b>two</b>three</p><p>four</p>five<br>six</body></html>", Config())
    assert words(got) == ["onetwothree", "four", "five", "six"]
    assert got.properties["leafdescription"] == ["onetwothree four five six"]


def test_xml_tags_part():
    got = M.parse_xml("<d>one<b>two</b>three</d>", Config())
    assert words(got) == ["one", "two", "three"]


def test_html_title_and_meta():
    page = '<html><head><title>A  title</title><meta name="Kind" content="some words"/><meta name="kind" content="more"></head><body>text</body></html>'
    got = M.parse_html(page, config("<MetaNames><kind/></MetaNames><PropertyNames><kind/></PropertyNames>"))
    assert got.properties["kind"] == ["some words", "more"] and got.metas["kind"] == ["some words", "more"]
    assert got.properties["leaftitle"] == ["A  title"] and got.metas["leaftitle"] == ["A  title"]
    plain = M.parse_html(page, Config())
    assert "some words" in " ".join(plain.metas["leafdefault"]).replace(GAP, " ")


def test_noindex_comments_nest():
    page = "<html><body>seen <!-- noindex -->no <!-- AnyCommand noindex -->no<!-- index --> no<!-- AnyCommand INDEX --> again<!-- note -->end</body></html>"
    got = M.parse_html(page, Config())
    assert words(got) == ["seen", "again", "end"]


def test_entities_scripts_and_broken_html():
    got = M.parse_html("<p>a &amp; b&eacute;<script>var x;</script><style>p{}</style><p>c <p>d</zzz>", Config())
    assert words(got) == ["a", "bé", "c", "d"]
    assert "var" in words(M.parse_html("<p>a <script>var x;</script>", Config(flags={"index_script": True})))


DOM = "<doc><one>red <two four='blue'>green <three>yellow</three></two></one></doc>"


def test_properties_by_path():
    got = M.parse_xml(DOM, config("<MetaNames><doc.one.two.three/><doc.one.two/></MetaNames><PropertyNames><doc.one.two.three/><doc.one.two/></PropertyNames>"))
    assert got.properties == {"doc.one.two": ["green", "yellow"], "doc.one.two.three": ["yellow"]}
    assert words(got) == ["red", "green", "yellow"]


def test_attributes():
    cls = config("<MetaNames><a/><a.foo/></MetaNames><XMLClassAttributes>class</XMLClassAttributes>")
    got = M.parse_xml("<d><A>x</A><A class='FOO'>y</A></d>", cls)
    assert got.metas["a"] == ["x"] and got.metas["a.foo"] == ["y"]
    own = M.parse_xml("<d><a id='V1'>x</a></d>", config("<MetaNames><a.id/></MetaNames>"))
    assert own.metas["a.id"] == ["v1"]


UNDEFINED = "<doc><name age='23'>John Smith</name><foo>bar</foo></doc>"


def test_undefined_policies():
    policy = lambda p: config(f"<UndefinedMetaTags>{p}</UndefinedMetaTags><UndefinedXMLAttributes>{p}</UndefinedXMLAttributes>")
    assert words(M.parse_xml(UNDEFINED, policy("ignore"))) == []
    auto = M.parse_xml(UNDEFINED, policy("auto"))
    assert (auto.metas["foo"], auto.metas["name"], auto.metas["name.age"]) == (["bar"], ["John Smith"], ["23"])
    assert auto.new_metas == ["doc.age"] or set(auto.new_metas) == {"doc", "name", "name.age", "foo"}
    with pytest.raises(M.MarkupError, match="not a defined metaname"):
        M.parse_xml(UNDEFINED, policy("error"))
    assert words(M.parse_xml(UNDEFINED, policy("index"))) == ["23", "john", "smith", "bar"]
    both = M.parse_xml(UNDEFINED, policy("autoall"))
    assert both.properties["foo"] == ["bar"] and "name" in both.new_properties
    some = M.parse_xml("<doc><in>x</in><out>y<in>z</in></out><in>w</in></doc>", config("<MetaNames><doc/><in/></MetaNames><UndefinedMetaTags>ignore</UndefinedMetaTags>"))
    assert words(some) == ["x", "w"]


def test_namespaces():
    doc = "<d xmlns:q='http://q'><q:size>big</q:size><size>small</size></d>"
    names = "<MetaNames><q:size/><size/></MetaNames>"
    kept = M.parse_xml(doc, config(names + "<IgnoreXMLNameSpaces>0</IgnoreXMLNameSpaces>"))
    assert kept.metas["q:size"] == ["big"] and kept.metas["size"] == ["small"]
    assert M.parse_xml(doc, config(names)).metas["size"] == ["big", "small"]


def test_cascade_and_context():
    c = config("<MetaNames><a/><b/></MetaNames><CascadeMetaContext>1</CascadeMetaContext>")
    got = M.parse_xml("<a>x<b>y</b></a>", c)
    assert got.metas["a"] == ["x", "y"] and got.metas["b"] == ["y"] and got.metas["leafdefault"] == ["x", "y"]
    assert ("b", "leafdefault/a/b", "y") in got.pieces
    plain = M.parse_xml("<a>x<b>y</b></a>", config("<MetaNames><a/><b/></MetaNames>"))
    assert plain.metas == {"a": ["x"], "b": ["y"]}


def test_aliases():
    c = config("<MetaNames><real/><other alias_for='real'/></MetaNames><TagAlias><real>x y</real></TagAlias><PropertyNames><p max='3'/><q alias_for='p'/></PropertyNames>")
    got = M.parse_xml("<d><x>1</x><other>2</other><q>  abcdef </q></d>", c)
    assert got.metas["real"] == ["1", "2"] and got.properties["p"] == ["abc"]
    with pytest.raises(ConfigError, match="not defined"):
        config("<MetaNames><a alias_for='none'/></MetaNames>")


def test_broken_xml_keeps_what_follows():
    got = M.parse_xml("<doc><a>one two <b></a></b> three</doc>", Config())
    assert words(got) == ["one", "two", "three"] and "not well-formed" in got.warnings[0]


def test_xinclude(tmp_path):
    (tmp_path / "in.xml").write_text("<x>inner words</x>")
    (tmp_path / "in.txt").write_text("plain")
    (tmp_path / "loop.xml").write_text('<x xmlns:xi="http://www.w3.org/2001/XInclude">l<xi:include href="loop.xml"/></x>')
    doc = '<d xmlns:xi="http://www.w3.org/2001/XInclude">outer <xi:include href="in.xml"/><xi:include href="in.txt" parse="text"/><xi:include href="none.xml"/></d>'
    got = M.parse_xml(doc, Config(), str(tmp_path / "main.xml"))
    assert {"outer", "inner", "words", "plain"} <= set(words(got)) and "none.xml" in got.warnings[0]
    assert words(M.parse_xml(doc, Config(flags={"follow_xinclude": False}))) == ["outer"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "link.xml").symlink_to(tmp_path / "in.xml")
    for href in ("../in.xml", str(tmp_path / "in.xml"), "/etc/hostname", "link.xml"):
        out = M.parse_xml(f'<d xmlns:xi="http://www.w3.org/2001/XInclude">outer <xi:include href="{href}"/></d>', Config(), str(tmp_path / "sub" / "main.xml"))
        assert words(out) == ["outer"] and "outside" in out.warnings[0]
    assert words(M.parse_xml((tmp_path / "loop.xml").read_text(), Config(), str(tmp_path / "loop.xml"))).count("l") == 17


def test_encodings():
    latin = "caf\xe9".encode("latin-1")
    assert M.analyze(latin, "TXT", Config()).metas["leafdefault"] == ["café"]
    assert M.analyze(b"<?xml version='1.0' encoding='iso-8859-1'?><d>" + latin + b"</d>", "XML", Config()).metas["leafdefault"] == ["café"]
    assert M.analyze(b"<p>" + latin + b"</p>", "HTML", Config()).encoding == "ISO-8859-1"
    assert M.analyze("a\x00b".encode(), "txt", Config(), "u").metas["leafdefault"] == ["a\nb"]
    assert M.analyze(b"", "XML", Config()).warnings == ["empty document"]
    with pytest.raises(M.MarkupError):
        M.analyze(b"x", "PDF", Config())


# ---- configuration

def test_config_sections(tmp_path):
    c = config("""<MetaNames><foo bias="+10"/><bar bias="-5"/><other>color size</other><MixEd/></MetaNames>
<PropertyNames><n type="int"/><d type="date"/><t type="text" ignore_case="0" sort="0"/><al>p1 p2</al><v verbatim="1" max="10"/></PropertyNames>
<MIME><au>foo/bar</au></MIME><Parsers><HTML>foo/bar 12/34</HTML><TXT>default</TXT></Parsers><TagAlias><foo>x y</foo></TagAlias><Index><Name>i</Name></Index>
<Tokenize>no</Tokenize><CascadeMetaContext>1</CascadeMetaContext><Anything>at all</Anything><XMLClassAttributes>a "b c"</XMLClassAttributes>""")
    assert c.metanames["foo"].weight == 10 and c.metanames["bar"].weight == 1 and c.metanames["size"].alias_for == "other" and "mixed" in c.metanames
    assert (c.properties["n"].type, c.properties["d"].type, c.properties["t"].ignore_case, c.properties["p1"].alias_for) == (3, 2, False, "al")
    assert c.mimes["au"] == "foo/bar" and c.parsers["12/34"] == "HTML" and c.parsers["default"] == "TXT" and c.tag_aliases["y"] == "foo"
    assert not c.flag("tokenize") and c.flag("cascade") and c.misc["Anything"] == "at all" and c.stringlists["XMLClassAttributes"] == ["a", "b c"]
    again = Config.read(c.to_xml())
    assert again == c
    (tmp_path / "a.xml").write_text("<c><IncludeConfigFile>b.xml</IncludeConfigFile></c>")
    (tmp_path / "b.xml").write_text("<c><MetaNames><inc/></MetaNames></c>")
    assert "inc" in Config.read(str(tmp_path / "a.xml")).metanames
    assert validate("<c/>") and not validate("<c>") and not validate("<c><MetaNames><a id='8'/><b id='8'/></MetaNames></c>")
    own = config("<MetaNames><a id='1'/></MetaNames>")
    assert own.metanames["a"].id == 1 and own.metanames["leaftitle"].id not in (0, 1)


def test_config_that_includes_itself(tmp_path):
    (tmp_path / "a.conf").write_text("<c><IncludeConfigFile>b.conf</IncludeConfigFile></c>")
    (tmp_path / "b.conf").write_text("<c><IncludeConfigFile>a.conf</IncludeConfigFile></c>")
    with pytest.raises(ConfigError):
        Config.read(str(tmp_path / "a.conf"))


def test_config_merge_and_errors():
    a, b = config("<MetaNames><x bias='2'/></MetaNames><Tokenize>0</Tokenize>"), config("<MetaNames><y/><x bias='5'/></MetaNames><Index><k>v</k></Index>")
    m = a.merge(b)
    assert m.metanames["x"].bias == 5 and not m.flag("tokenize") and m.index == {"k": "v"} and len({x.id for x in m.metanames.values()}) == len(m.metanames)
    for bad in ("<UndefinedMetaTags>maybe</UndefinedMetaTags>", "<MetaNames><a what='1'/></MetaNames>", "<PropertyNames><a type='x'/></PropertyNames>", "<MetaNames><a id='7'/><b id='7'/></MetaNames>"):
        with pytest.raises((ConfigError, ValueError)):
            config(bad)
    c = Config()
    assert [c.property_id(f"leaf{n}") for n in ("rank", "docpath", "title", "docsize", "lastmodified", "description", "wordnum", "mime", "parser")] == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    with pytest.raises(ConfigError):
        c.property_id("leafencoding")
    c.delete("properties", "leaftitle")
    assert "leaftitle" not in c.properties


# ---- scalar functions

def test_words_and_escapes():
    assert W.split_words(" a 'b c' \"d\\\"e\" f\\g\nh") == ["a", "b c", 'd"e', "f\\g"] and W.split_words(None) == [] and W.split_words("a '' b") == ["a"]
    assert W.merge_words(["a"], ["b", "a"]) == ["b", "a", "a"]
    assert W.unescape_c("a\\tb\\x41\\012\\q\\") == "a\tbA\nq\\"
    text = "tab\t nl\n \x01 \\ é 😀 \x7f"
    assert W.escape_text(text) == "tab\\t nl\\n \\x01 \\\\ \\u00E9 \\U0001F600 \\x7F" and W.unescape_text(W.escape_text(text)) == text
    assert W.escape_text(None) is None and W.unescape_text("\\101\\u41") == "AA"
    assert [W.to_int(x) for x in ("12ab", "-3", "x", None)] == [12, -3, 0, 0] and [W.to_bool(x) for x in ("yes", "1", "on", "On", "no", "")] == [True, True, True, False, False, False]


def test_columns(spark):
    assert one(spark, C.file_ext, "a/b.TXT", "a.b/c", "x.", "x") == ["txt", None, "", None]
    assert one(spark, C.real_ext, "a.txt.gz", "b.html") == ["txt", "html"]
    assert one(spark, C.file_path, "a/b", "/b", "b", "/a/b/c") == ["a/", None, None, "/a/b/"]
    assert one(spark, C.sorted_chars, "banana", "") == ["abn", ""]
    assert one(spark, C.trim_space, " \t a b \n") == ["a b"] and one(spark, C.all_space, " \n", "a") == [True, False]
    assert one(spark, C.ctrl_to_space, "a\x01b", "é\x01") == ["a b", "é\x01"]
    assert one(spark, C.string_to_int, "42x", "x", "99999999999") == [42, 0, None]
    assert one(spark, C.code_point, "😀", "é") == [128512, 233] and one(spark, C.char_bytes, "😀a", "é") == [4, 2]
    assert one(spark, lambda c: C.date_to_string(F.lit(20000), F.lit(13), F.lit(0)), "") == ["99991201"]
    assert one(spark, lambda c: C.time_print(F.lit(3661.6)), "") == ["01:01:02"] and one(spark, lambda c: C.time_print_fine(F.lit(12.0)), "") == ["9.99999"]
    assert one(spark, lambda c: C.bytes_to_int(C.int_to_bytes(c.cast("int"))), "-5", "70000") == [-5, 70000]
    assert one(spark, C.char_class, "a", "5", " ") == [["alnum", "alpha", "ascii", "graph", "lower", "print", "word", "xdigit"], ["alnum", "ascii", "digit", "graph", "print", "word", "xdigit"], ["ascii", "blank", "print", "space"]]
    assert one(spark, lambda c: C.snippet(c, "bob", 3), "hello BOB there", "none") == ["lo *BOB* th", "none"]
    assert one(spark, lambda c: mime.mime_type(C.file_ext(c)), "a.txt", "a.zip", "a") == ["text/plain", "text/html", "text/html"]
    assert one(spark, lambda c: mime.parser_of(c), "text/xml", "x/y") == ["XML", "HTML"]


# ---- sources

FRAME = b"Content-Length: 11\nContent-Location: a.xml\nParser-Type: XML\nAction: add\n\n<d>hi u</d>"


def test_frames(spark, tmp_path):
    two = FRAME + b"Content-Length: 2\nPath-Name: b.txt\nContent-Type: text/plain; charset=utf-8\n\nok"
    got = [d for d, _ in framed.read_frames(io.BytesIO(two))]
    assert [(d["uri"], d["content"], d["mtime"], d["action"]) for d in got] == [("a.xml", b"<d>hi u</d>", 0, "add"), ("b.txt", b"ok", 0, None)] and got[1]["mime"] == "text/plain" and got[1]["encoding"] == "utf-8"
    for bad in (b"Content-Length: 3\n\nabc", b"Content-Length: 9\nContent-Location: a\n\nabc", b"X\nY\n\n", FRAME + b"Content-Length: 2\n"):
        with pytest.raises(framed.FrameError):
            list(framed.read_frames(io.BytesIO(bad)))
    (tmp_path / "s").write_bytes(two)
    framed.register(spark)
    assert sorted(r["uri"] for r in spark.read.format("framed").load(str(tmp_path)).collect()) == ["a.xml", "b.txt"]
    for n in ("t", "u"):
        (tmp_path / n).write_bytes(FRAME.replace(b"a.xml", n.encode() + b".xml"))
    q = spark.readStream.format("framed").load(str(tmp_path)).writeStream.format("memory").queryName("folder").start()
    try:
        q.processAllAvailable()
        assert sorted(r["uri"] for r in spark.table("folder").collect()) == ["a.xml", "b.txt", "t.xml", "u.xml"]
        (tmp_path / "v").write_bytes(FRAME.replace(b"a.xml", b"v.xml"))
        q.processAllAvailable()
        assert spark.table("folder").count() == 5
    finally:
        q.stop()
    (tmp_path / "grow").write_bytes(FRAME + FRAME[:30])
    q = spark.readStream.format("framed").load(str(tmp_path / "grow")).writeStream.format("memory").queryName("grown").start()
    try:
        q.processAllAvailable()
        assert spark.table("grown").count() == 1
        (tmp_path / "grow").write_bytes(FRAME + FRAME)
        q.processAllAvailable()
        assert spark.table("grown").count() == 2
    finally:
        q.stop()
    df = spark.createDataFrame([("u", "tëxt")], "uri string, t string").select(framed.framed(F.col("uri"), F.col("t")).alias("b"))
    assert df.first()[0].startswith("Content-Length: 5\nLast-Modified: 0\nContent-Location: u\n\n") and framed.frames(df, "b").first()["content"] == "tëxt".encode()


def test_files(spark, tmp_path, monkeypatch):
    d = tmp_path / "docs" / "sub"
    d.mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("alpha")
    (d / "b.html.gz").write_bytes(gzip.compress(b"<p>beta</p>"))
    (d / "empty.txt").write_text("")
    (d / ".hidden.txt").write_text("x")
    got = {os.path.basename(r["uri"]): r for r in files.read_files(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"a.txt", "b.html.gz"} and got["b.html.gz"]["content"] == b"<p>beta</p>" and got["b.html.gz"]["parser"] == "HTML" and got["a.txt"]["mime"] == "text/plain"
    (tmp_path / "list").write_text(f"# names\n\n{tmp_path}/docs/a.txt\n  \n")
    assert [r["uri"] for r in files.read_listed(spark, str(tmp_path / "list")).collect()] == [f"{tmp_path}/docs/a.txt"] and files.count_lines(spark, str(tmp_path / "list")) == 1
    assert files.refused_files(spark, str(tmp_path / "docs")).count() == 0
    monkeypatch.setattr(files, "MAX_FILE", 5)
    assert [(os.path.basename(r["uri"]), r["size"]) for r in files.refused_files(spark, str(tmp_path / "docs"), recursive=False).collect()] == [("a.txt", 5)]
    monkeypatch.undo()
    two = gzip.compress(b"one ") + gzip.compress(b"two")
    unzipped = spark.createDataFrame([(two,), (two[:-9],), (b"no gzip",), (None,)], "b binary").select(files.gunzip("b")).collect()
    assert [r[0] and bytes(r[0]) for r in unzipped] == [b"one two", None, None, None]
    e = Engine()
    assert e.parse_directory(str(tmp_path / "docs")) == 3 and e.parse(FRAME).metaname("leafdefault") == "hi u" and e.parse(io.BytesIO(FRAME)) == 1
    assert e.get_mime("foo/bar") is None and e.get_real_mime("x.txt.gz") == "text/plain" and e.get_mime("a.txt") == "text/plain"


def test_tables_as_documents(spark):
    df = spark.createDataFrame([(1, "a<b", None), (2, "c&d", "x")], "id long, name string, note string")
    docs = tables.rows_as_documents(df, F.col("id"), "name", ["name", "note"])
    got = {(r["uri"], r["name"]): r["value"] for r in A.field_values(A.analyze(docs, Config())).collect()}
    assert got[("1", "leaftitle")] == "a<b" and got[("2", "leaftitle")] == "c&d"
    made = tables.random_documents(spark, 5, ["ab", "cd"], 3, 9, seed=1, shift_every=3).collect()
    assert all(3 <= len(r["content"].split()) <= 9 for r in made) and any(ord(c) > 30000 for c in made[0]["content"])
    n = tables.normalized(spark.createDataFrame([("a.html", "<b>x</b> y"), ("b.pdf", "z")], "uri string, content string")).collect()
    assert [(r["uri"], r["words"]) for r in n] == [("a.html", ["x", "y"])]


# ---- search

@pytest.fixture(scope="module")
def found(spark):
    c = config("<MetaNames><kind bias='4'/></MetaNames><PropertyNames><kind/><n type='int'/><day type='date'/></PropertyNames>")
    docs = [
        ("a.xml", "<d><title>Red apple</title><kind>Fruit</kind><n>10</n><day>20200101</day> sweet red apple pie</d>"),
        ("b.xml", "<d><title>Green pear</title><kind>Fruit</kind><n>9</n> sour pear and red wine</d>"),
        ("c.xml", "<d><title>Carrot</title><kind>Root</kind><kind>Food</kind><n>100</n><day>20210101</day> red root apple</d>"),
        ("d.txt", "pie apple sweet"),
    ]
    df = spark.createDataFrame([(u, t, "TXT" if u.endswith("txt") else "XML") for u, t in docs], "uri string, content string, parser string")
    df = df.withColumn("mtime", F.lit(1_000_000_000)).withColumn("size", F.octet_length("content"))
    from leafmill.plans.index import analyzed_tables

    t = analyzed_tables(df, c)
    return Q.Tables(c, t["docs"].cache(), t["postings"].cache(), t["props"].cache())


@pytest.mark.parametrize(("text", "uris"), [
    ("pie", "ad"), ("pear pie", "abd"), ("red and apple", "ac"), ("apple NOT pie", "c"), ("apple and not pie", "c"), ("not apple", "b"), ("pie xor red", "bcd"), ("(pear or carrot) and red", "bc"),
    ('"red apple"', "a"), ('"apple pie"', "a"), ('"pie apple"', "d"), ("app*", "acd"), ("kind:fruit", "ab"), ("fruit", ""), ("leaftitle:red", "a"), ("kind:(root or nothing)", "c"),
    ("n:9..10", "ab"), ("n:x..y", ""), ("day:20200101..20201231", "a"), ("kind:FOOD..foods", "c"), ("U:d.txt", "d"), ("D:20010909 and pear", "b"), ("Y:2001", "abcd"), ("M:200109 not red", "d"), ("", ""), ("and-y", ""), ("http://x:pie", ""), ("kind:fruit not pie", "b"),
])
def test_queries(found, text, uris):
    assert "".join(sorted(r["uri"][0] for r in found.search(text).collect())) == uris


def test_query_errors_and_limits(found):
    for bad in ("(a", "a )", "a and", "a or"):
        if bad == "(a":
            continue
        with pytest.raises(Q.QueryError):
            Q.parse(bad, found.config)
    with pytest.raises(Q.QueryError):
        found.search("a", ["n 1"])
    assert [r["uri"] for r in found.search("apple", ["n 5 50", "day 2 3"]).collect()] == ["a.xml"]
    many = " or ".join(f"w{i}" for i in range(150))
    assert found.search(f"({many} or apple)").count() == found.search("apple").count() > 0 and found.search(many).count() == 0


def test_ranking_sorting_facets_templates(found):
    hits = with_percent(ranked(found, "apple pie"))
    page = sorted_hits(found, hits).collect()
    assert {r["uri"] for r in page[:2]} == {"a.xml", "d.txt"} and page[0]["rank"] == 1000 and [r["score"] for r in page] == sorted((r["score"] for r in page), reverse=True)
    heavy = {r["uri"]: r["score"] for r in ranked(found, "kind:root or wine").collect()}
    assert heavy["c.xml"] > heavy["b.xml"]
    everything = ranked(found, "Y:2001")
    by = lambda s, **k: "".join(r["uri"][0] for r in sorted_hits(found, everything, s, **k).collect())
    assert by("n") == "dbac" and by("n DESC") == "cabd" and by("kind desc n") == "cbad" and by("n", begin=1, max=2) == "ba" and by("leafdocpath desc") == "dcba"
    assert sort_spec("a b desc", compat=True) == [("b", True), ("a", False)]
    with pytest.raises(ConfigError):
        sort_spec("nothing", found.config)
    f = {(r["facet"], r["value"]): r["n"] for r in facets(found, found.search("red pie"), ["kind", "leafparser"]).collect()}
    assert f == {("kind", "Fruit"): 2, ("kind", "Root"): 1, ("kind", "Food"): 1, ("kind", ""): 1, ("leafparser", "XML"): 3, ("leafparser", "TXT"): 1}
    line = {r["uri"]: r["line"] for r in rendered(found, hits, "<leafrank>|< kind >|<leaftitle>\\t<leaflastmodified>\\n").collect()}
    assert line["c.xml"].split("|")[1:] == ["Root\x03Food", "Carrot\t2001-09-09 01:46:40 UTC\n"]
    assert parse_template("a<x>\\x41") == [("text", "a"), ("value", "x"), ("text", "A")]


# ---- index

def test_index(spark, tmp_path):
    c = config("<PropertyNames><kind/></PropertyNames><UndefinedMetaTags>auto</UndefinedMetaTags>")
    frame = lambda rows: spark.createDataFrame([(u, t, "XML", i) for i, (u, t) in enumerate(rows)], "uri string, content string, parser string, seq int")
    index = Index(spark, str(tmp_path / "i"), c, "english")
    assert index.add(frame([("a", "<d>running dogs</d>"), ("b", "<d>cats</d>"), ("a", "<d><kind>new</kind> running cats</d>")]), seq="seq") == 2
    search = lambda q: sorted(r["uri"] for r in Index(spark, str(tmp_path / "i")).tables().search(q).collect())
    assert search("d:run") == ["a"] and search("d:dog") == [] and search("d:cat") == ["a", "b"] and search("kind:new..new") == ["a"]
    assert index.add(frame([("b", "<d>dogs</d>"), ("c", "<d>dogs</d>")]), skip_known=True) == 1 and search("d:dogs") == ["c"]
    assert index.delete(["a", "zzz"]) == (1, ["zzz"]) and search("d:cats") == ["b"]
    index.add(frame([("b", "<d>birds</d>")]))
    assert search("d:cats") == [] and search("d:bird") == ["b"]
    index.compact()
    assert len(index.segments()) == 1 and search("d:birds or d:dogs") == ["b", "c"]
    stats = {(r["meta"], r["term"]): (r["df"], r["cf"]) for r in index.terms().collect()}
    assert stats[("d", "bird")] == (1, 1)
    with pytest.raises(ConfigError):
        Index(spark, str(tmp_path / "i"), language="none")
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "j"), language="klingon")
    assert Index(spark, str(tmp_path / "i"), overwrite=True).segments() == []


def test_porter():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "is": "is"}
    assert {k: stem.porter(k) for k in cases} == cases


def test_stream_into_index(spark, tmp_path):
    from leafmill.streaming.ingest import handle_stream, upsert_stream

    schema = "uri string, content string, parser string, action string"
    batch = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = Index(spark, str(tmp_path / "i"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batch(0, [("a", "one", "TXT", None), ("b", "two", "TXT", "add")])
    upsert_stream(stream(), index, str(tmp_path / "cp"), once=True).awaitTermination()
    batch(1, [("a", "three", "TXT", None), ("b", None, None, "delete")])
    upsert_stream(stream(), index, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r["uri"] for r in index.tables().search("three or two").collect()] == ["a"]
    seen = []
    handle_stream(stream(), lambda df: seen.append(df.count()), str(tmp_path / "cp2"), once=True).awaitTermination()
    assert sum(seen) == 4


# ---- object interface and command line

def test_engine_handler_and_analyzer(tmp_path):
    seen = []
    (tmp_path / "x.xml").write_text("<d><title>T</title> one two</d>")
    e = Engine(handler=seen.append, stash={"k": 1})
    d = e.parse(str(tmp_path / "x.xml"))
    assert seen == [d] and d.doc["nwords"] == 3 and d.property("leaftitle") == "T" and d.property("none") is None
    assert [(t.value, t.pos, t.meta, t.len) for t in d.tokens()][0] == ("t", 1, "leaftitle", 1)
    e.analyzer = Analyzer(pattern=r"\S+")
    assert [t.value for t in e.tokenize("A-b c")] == ["A-b", "c"]
    e.analyzer = Analyzer(tokenizer=str.split, stemmer=str.upper)
    assert [t.value for t in e.tokenize("x y")] == ["X", "Y"]
    auto = Engine("<c><UndefinedMetaTags>auto</UndefinedMetaTags></c>")
    auto.parse(str(tmp_path / "x.xml"))
    assert "d" in auto.config.metanames


def test_command_line(tmp_path, capsys, spark):
    (tmp_path / "a.txt").write_text("alpha beta")
    (tmp_path / "c.xml").write_text("<c><MetaNames><k/></MetaNames></c>")
    assert cli.main(["lint", str(tmp_path / "a.txt")]) == 0 and "1 files" in capsys.readouterr().out
    assert cli.main(["tokenize", "one two"]) == 0 and capsys.readouterr().out == "1 one\n2 two\n"
    assert cli.main(["header", str(tmp_path / "c.xml")]) == 0 and "<k id=" in capsys.readouterr().out
    assert cli.main(["chars", "é"]) == 0 and "U+00E9 2 bytes" in capsys.readouterr().out
    assert cli.main(["index", "-i", str(tmp_path / "i"), str(tmp_path / "a.txt")]) == 0 and "1 documents" in capsys.readouterr().out
    assert cli.main(["search", "-i", str(tmp_path / "i"), "-q", "beta", "-F", "leafparser"]) == 0
    out = capsys.readouterr().out
    assert "1 of 1" in out and f'1000 {tmp_path}/a.txt "" "10"' in out and "# leafparser 'TXT': 1" in out
    assert cli.main(["index", "-D", "-i", str(tmp_path / "i"), str(tmp_path / "a.txt"), "nope"]) == 0 and "not in the index: nope" in capsys.readouterr().out


def test_dumps_hook_and_code_points(spark):
    engine = Engine("<c><MetaNames><name/></MetaNames></c>")
    assert "metaname name id=" in engine.dump()
    doc = engine.parse(b"Content-Length: 21\nContent-Location: a.xml\n\n<r><name>x</name></r>")
    assert "field name 0 x" in doc.dump().split("\n")
    rows = spark.createDataFrame([("aé布😀z",), ("",), (None,)], "t string")
    got = rows.select(*[C.char_offset("t", n) for n in range(12)], C.byte_offset("t", 3), C.char_at("t", 3), C.last_char_index("t", "z")).collect()
    assert tuple(got[0]) == (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 5, 6, "😀", 4)
    assert tuple(got[1]) == (0,) * 13 + (None, -1)
    assert set(got[2]) == {None}
    pieces = spark.createDataFrame([("u", [("m", "m", "A-b\x03c")])], "uri string, pieces array<struct<meta:string,context:string,text:string>>")
    hooked = T.postings(pieces, tokenizer=lambda t: F.split(t, "-"))
    assert [(r["term"], r["pos"]) for r in hooked.orderBy("pos").collect()] == [("A", 1), ("b", 2), ("c", 4)]


def test_deep_markup_takes_linear_time():
    import time

    def seconds(n: int) -> float:
        start = time.process_time()
        page = "".join(f"<t{i}>" for i in range(n)) + "deep words" + "".join(f"</t{i}>" for i in reversed(range(n)))
        assert words(M.parse_xml(f"<r>{page}</r>", Config())) == ["deep", "words"]
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)


def test_stems_by_rules():
    # Words and stems of the published vocabularies.
    known = {
        "german": "aufeinanderfolge aufeinanderfolg häuser haus kategorischen kategor aufgeräumter aufgeraumt freundlichkeiten freundlich ergebnisse ergebnis ordnung ordnung auflösung auflos heiligkeit heilig",
        "swedish": "jaktkarlarne jaktkarl jakthundens jakthund klockornas klock friskt frisk maktlöst maktlös",
        "norwegian": "havnedistriktene havnedistrikt opning opning havnemyndighetene havnemynd vevet vev",
        "danish": "undertidsstillingerne undertidsstilling universelt universelt uafsluttet uafslut",
    }
    for language, words in known.items():
        words = words.split()
        for word, want in zip(words[::2], words[1::2], strict=True):
            assert stem.STEMMERS[language](word) == want, (language, word)
        for odd in ("", "s", "en", "12s", "'s", "字字"):
            assert stem.STEMMERS[language](odd) == odd

"""Registered queries over documents, files, streams and indexes that they build from the tables, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GAP, Config
from .functions import columns as C
from .functions import words as W
from .operators import analyze as A
from .operators import tokens as T
from .operators.includes import included
from .operators.stem import stemmer
from .plans.index import Index
from .plans.query import Tables
from .plans.rank import ranked, top
from .plans.results import facets, sorted_hits
from .queries import _BM25, _HAS, TOK, WORDS, _table, corpus_config, query
from .sources import files, framed, listing, storage, tables

_TIDY = f"[\\x00-\\x20{GAP}]+"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see: in spark.checkpoint.dir, on one machine in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="leafmill-")
    return f"{folder.rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"


def _built(rows: DataFrame, key: str, content: Column, parser: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("uri"), content.alias("content"), F.lit(parser).alias("parser"))


def _fields(analyzed: DataFrame, which: str = "metas") -> DataFrame:
    """(id, name, idx, value) with gaps and white space as one space."""
    value = F.btrim(F.regexp_replace("value", _TIDY, " "))
    return A.field_values(analyzed, which).select(F.col("uri").cast("int").alias("id"), "name", "idx", value.alias("value"))


def _nations(spark: SparkSession, sf_dir: str, content: str, config: Config, parser: str = "XML") -> DataFrame:
    """The analysis of a document for each nation; `content` is an SQL expression."""
    return A.analyze(_built(_table(spark, sf_dir, "nation"), "n_nationkey", F.expr(content), parser), config)


# ---- fields and policies

@query("""SELECT n_nationkey AS id, unnest(['leafdefault', 'leaftitle', 'region']) AS name, CAST(0 AS INTEGER) AS idx,
  unnest(['before after', 'About ' || n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation""")
def meta_fields(spark, sf_dir):
    """Tags in any case, a meta tag as a field, what stands between noindex comments left out."""
    html = "concat('<HTML><Head><TITLE>About ', n_name, '</title><META NAME=\"Region\" content=\"', n_regionkey, '\"></head><body>before <!-- noindex -->hidden <b>', n_name, '</b><!-- index --><p>after</p></body></html>')"
    return _fields(_nations(spark, sf_dir, html, Config.read("<c><MetaNames><region/></MetaNames></c>"), "HTML"))


_UNDEFINED = "concat('<r>k<known>', n_name, '</known><other>o ', n_regionkey, '</other></r>')"


@query("""WITH k AS (SELECT n_nationkey AS id, 'r' AS name, 0 AS idx, 'k' AS value FROM nation UNION ALL SELECT n_nationkey, 'known', 0, n_name FROM nation),
o AS (SELECT n_nationkey AS id, 'o ' || n_regionkey AS value FROM nation)
SELECT policy, id, name, CAST(idx AS INTEGER) AS idx, value FROM k, (VALUES ('ignore'), ('index'), ('auto')) p(policy)
UNION ALL SELECT 'index', id, 'r', CAST(1 AS INTEGER), value FROM o UNION ALL SELECT 'auto', id, 'other', CAST(0 AS INTEGER), value FROM o
UNION ALL SELECT 'error', id, 'XML tag other is not a defined metaname', CAST(0 AS INTEGER), '' FROM o""")
def undefined_tags(spark, sf_dir):
    """What each policy makes of a tag that is not configured; `error` refuses the document."""
    out = None
    for policy in ("ignore", "index", "auto", "error"):
        found = _nations(spark, sf_dir, _UNDEFINED, Config.read(f"<c><MetaNames><r/><known/></MetaNames><UndefinedMetaTags>{policy}</UndefinedMetaTags></c>"))
        rows = _fields(found)
        if policy == "error":
            rows = rows.unionByName(found.select(F.col("uri").cast("int").alias("id"), F.col("error").alias("name"), F.lit(0).alias("idx"), F.lit("").alias("value")))
        rows = rows.withColumn("policy", F.lit(policy))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH f AS (SELECT n_nationkey AS id, 'item.b' AS name, 'text ' || n_regionkey AS value FROM nation UNION ALL SELECT n_nationkey, 'item.b.note', lower(n_name) FROM nation)
SELECT policy, id, name, CAST(0 AS INTEGER) AS idx, value FROM f, (VALUES ('disable'), ('index')) p(policy)
UNION ALL SELECT 'index', n_nationkey, 'r', CAST(0 AS INTEGER), 'b' FROM nation""")
def attribute_fields(spark, sf_dir):
    """A class attribute names the field, tag.attribute is a field of its own, others go by their policy."""
    xml = "concat('<r><item kind=\"B\" note=\"', n_name, '\">text ', n_regionkey, '</item></r>')"
    out = None
    for policy in ("disable", "index"):
        config = Config.read(f"<c><MetaNames><r/><item.b/><item.b.note/></MetaNames><XMLClassAttributes>kind</XMLClassAttributes><UndefinedXMLAttributes>{policy}</UndefinedXMLAttributes></c>")
        rows = _fields(_nations(spark, sf_dir, xml, config)).withColumn("policy", F.lit(policy))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH t AS (SELECT n_nationkey AS id, lower(n_name) AS a, 'o ' || n_regionkey AS o FROM nation)
SELECT id, which, name, CAST(0 AS INTEGER) AS idx, value FROM (
  SELECT id, unnest(['metas', 'properties']) AS which, 'other' AS name, o AS value FROM t UNION ALL SELECT id, 'metas', 'other.a', a FROM t
  UNION ALL SELECT id, unnest(['metas', 'properties']), 'r', unnest(['k', 'k ' || a]) FROM t)
UNION ALL SELECT id, 'properties', 'r', CAST(1 AS INTEGER), o FROM t""")
def auto_policies(spark, sf_dir):
    """Tags and attributes that are not configured become fields, with autoall stored values too."""
    xml = "concat('<r>k<other a=\"', n_name, '\">o ', n_regionkey, '</other></r>')"
    found = _nations(spark, sf_dir, xml, Config.read("<c><UndefinedMetaTags>autoall</UndefinedMetaTags><UndefinedXMLAttributes>auto</UndefinedXMLAttributes></c>"))
    return _fields(found).withColumn("which", F.lit("metas")).unionByName(_fields(found, "properties").withColumn("which", F.lit("properties")))


_XI = '<d xmlns:xi="http://www.w3.org/2001/XInclude">'


def _including(name: str, hrefs: list[Column]) -> Column:
    return F.concat(F.lit(_XI), name, *(x for h in hrefs for x in (F.lit('<xi:include href="'), h, F.lit('.xml"/>'))), F.lit("</d>"))


@query("""SELECT c_custkey AS id, c_name || '|' || n_name || '|' || r.r_name || '|' || q.r_name || '|' || CASE WHEN r.r_regionkey < 2 THEN '' ELSE q.r_name || '|' END AS text,
  'includes itself: ' || CASE WHEN r.r_regionkey < 2 THEN 'r/' ELSE 's/' END || r.r_regionkey % 2 || '.xml|cannot include c/gone/' || c_custkey || '.xml' AS warnings
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r.r_regionkey JOIN region q ON q.r_regionkey = r.r_regionkey % 2""")
def included_documents(spark, sf_dir):
    """Documents of a table that include others of it: a chain of tables, a circle, and one that is nowhere."""
    c, n, r = (_table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    c = storage.spread(c)
    uri = lambda kind, key: F.concat(F.lit(f"{kind}/"), key, F.lit(".xml")).alias("uri")
    docs = c.select(uri("c", "c_custkey"), _including("c_name", [F.concat(F.lit("../n/"), "c_nationkey"), F.concat(F.lit("gone/"), "c_custkey")]).alias("content"))
    library = n.select(uri("n", "n_nationkey"), _including("n_name", [F.concat(F.lit("../r/"), "n_regionkey")]).alias("content"))
    library = library.union(r.select(uri("r", "r_regionkey"), _including("r_name", [F.concat(F.lit("../s/"), F.col("r_regionkey") % 2)])))
    library = library.union(r.where("r_regionkey < 2").select(uri("s", "r_regionkey"), _including("r_name", [F.concat(F.lit("../r/"), "r_regionkey")])))
    folder, config = _scratch(spark, "includes"), Config()
    A.analyze(docs.withColumn("parser", F.lit("XML")), config).write.parquet(f"{folder}/found")
    found = included(spark.read.parquet(f"{folder}/found"), library, config, folder)
    texts = F.transform("pieces", lambda p: F.concat(F.btrim(F.regexp_replace(p["text"], _TIDY, " ")), F.lit("|")))
    text = F.array_join(F.filter(texts, lambda x: x != "|"), "")
    return found.select(F.regexp_extract("uri", "[0-9]+", 0).cast("long").alias("id"), text.alias("text"), F.array_join("warnings", "|").alias("warnings"))


@query("""WITH t AS (SELECT c_custkey AS id, lower(repeat(replace(c_name, '#', 'İ') || 'Éé字𐐨', 40)) AS text FROM customer),
p AS (SELECT id, list_reduce(list_filter(regexp_split_to_array(text, ''), lambda x: x <> ''), lambda a, c: CASE
  WHEN strlen(regexp_extract(a, '[^|]*$')) + strlen(c) > 256 THEN a WHEN strlen(regexp_extract(a, '[^|]*$')) + strlen(c) = 256 THEN a || c || '|' ELSE a || c END, '') AS cut FROM t),
w AS (SELECT id, list_filter(string_split(cut, '|'), lambda x: x <> '') AS words FROM p)
SELECT id, unnest(words) AS term, CAST(generate_subscripts(words, 1) AS INTEGER) AS pos FROM w""")
def long_words(spark, sf_dir):
    """Words of many bytes, cut to 256; a character that would go beyond that is left out. Case is folded one to one."""
    text = F.repeat(F.concat(F.replace("c_name", F.lit("#"), F.lit("İ")), F.lit("Éé字𐐨")), 40)
    rows = storage.spread(_table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("uri"), text.alias("text"))
    return T.text_postings(rows, "uri", "text", "d", T.PLAIN_LETTERS).select(F.col("uri").alias("id"), "term", "pos")


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text || chr(1) || 'A', ''), lambda x: x <> ''), lambda c: CASE WHEN c = chr(92) THEN chr(92) || chr(92)
  WHEN unicode(c) BETWEEN 7 AND 13 THEN chr(92) || substr('abtnvfr', unicode(c) - 6, 1) WHEN unicode(c) < 32 OR unicode(c) = 127 THEN printf('%sx%02X', chr(92), unicode(c))
  WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN printf('%su%04X', chr(92), unicode(c)) ELSE printf('%sU%08X', chr(92), unicode(c)) END), '') AS escaped, true AS back FROM documents""")
def escaped_texts(spark, sf_dir):
    """Texts in ASCII spelling, with a control before a digit at the end; and whether they read back."""
    rows = storage.spread(_table(spark, sf_dir, "documents")).select("doc_id", F.concat("text", F.lit("\x01A")).alias("t")).withColumn("escaped", C.escape_utf8("t"))
    return rows.select("doc_id", "escaped", F.col("t").eqNullSafe(C.unescape_utf8("escaped")).alias("back"))


_NESTED = "concat('<a><b>', n_name, '<c>', n_regionkey, '</c></b></a>')"


@query("""WITH p AS (SELECT n_nationkey AS id, n_name AS text, 'leafdefault/a/b' AS context, unnest(['b', 'a', 'leafdefault']) AS meta FROM nation
  UNION ALL SELECT n_nationkey, CAST(n_regionkey AS VARCHAR), 'leafdefault/a/b/c', unnest(['c', 'b', 'a', 'leafdefault']) FROM nation)
SELECT id, meta, context, text, true AS cascaded FROM p
UNION ALL SELECT id, meta, context, text, false FROM p WHERE ends_with(context, '/' || meta)""")
def nested_fields(spark, sf_dir):
    """Nested fields with their paths, and with cascading in all fields around them."""
    out = None
    for flag in (0, 1):
        config = Config.read(f"<c><MetaNames><a/><b/><c/></MetaNames><CascadeMetaContext>{flag}</CascadeMetaContext></c>")
        rows = _nations(spark, sf_dir, _NESTED, config).select(F.col("uri").cast("int").alias("id"), F.inline("pieces"))
        rows = rows.select("id", "meta", "context", F.btrim(F.regexp_replace("text", _TIDY, " ")).alias("text"), F.lit(bool(flag)).alias("cascaded")).where("text <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT n_nationkey AS id, unnest(['one', lower(n_name), 'two', 'glued' || n_regionkey || 'word']) AS term, CAST(unnest([1, 3, 5, 7]) AS INTEGER) AS pos, 4 AS contexts FROM nation""")
def tag_positions(spark, sf_dir):
    """Block tags part words and leave out a position, inline tags glue them; with the number of contexts of each document."""
    html = "concat('<p>one</p><p>', n_name, '</p><p>two</p><div>glued<b>', n_regionkey, '</b>word</div>')"
    found = _nations(spark, sf_dir, html, Config(), "HTML")
    rows = T.postings(found).where("meta = 'leafdefault'")
    per_doc = T.postings(found).groupBy("uri").agg(F.count_distinct("context", "pos").cast("int").alias("contexts"))
    return rows.join(per_doc, "uri").select(F.col("uri").cast("int").alias("id"), "term", "pos", "contexts")


@query("SELECT n_nationkey AS id, unnest(['place', 'place']) AS name, CAST(unnest([0, 1]) AS INTEGER) AS idx, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation")
def aliased_fields(spark, sf_dir):
    """Aliases store under the name that they stand for."""
    config = Config.read("<c><MetaNames><place>town city</place></MetaNames></c>")
    return _fields(_nations(spark, sf_dir, "concat('<d><town>', n_name, '</town><CITY>', n_regionkey, '</CITY></d>')", config))


@query("SELECT n_nationkey AS id, n_name || chr(3) || n_regionkey AS joined, left('verbatim  ' || n_name, 12) AS cut FROM nation")
def joined_properties(spark, sf_dir):
    """Values of a property that repeats as one string, and one that is cut after so many bytes."""
    config = Config.read('<c><PropertyNames><p/><v max="12" verbatim="1"/></PropertyNames></c>')
    found = _nations(spark, sf_dir, "concat('<d><p> ', n_name, '</p><p>', n_regionkey, ' </p><v>verbatim  ', n_name, '</v></d>')", config)
    return found.select(F.col("uri").cast("int").alias("id"), A.joined_value(F.col("properties"), "p").alias("joined"), A.joined_value(F.col("properties"), "v").alias("cut"))


@query("""SELECT n_nationkey AS id, unnest(['ISO-8859-1', 'UTF-8', 'ISO-8859-1']) AS encoding, unnest(['é ' || n_name, 'é ' || n_name, 'x ü ' || n_name]) AS value, unnest(['TXT', 'TXT', 'HTML']) AS parser FROM nation""")
def text_encodings(spark, sf_dir):
    """Latin-1 where bytes are no UTF-8, and as a page declares it."""
    out = None
    for parser, content in (("TXT", "encode(concat('é ', n_name), 'ISO-8859-1')"), ("TXT", "encode(concat('é ', n_name), 'UTF-8')"), ("HTML", "encode(concat('<meta charset=ISO-8859-1><p>x ü ', n_name, '</p>'), 'ISO-8859-1')")):
        found = _nations(spark, sf_dir, content, Config(), parser)
        rows = found.select(F.col("uri").cast("int").alias("id"), "encoding", F.btrim(F.regexp_replace(F.get(F.col("metas")["leafdefault"], 0), _TIDY, " ")).alias("value"), F.lit(parser).alias("parser"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT n_nationkey AS id, 'a' || chr(10) || n_name AS value FROM nation")
def nul_characters(spark, sf_dir):
    """NUL characters are line ends."""
    found = _nations(spark, sf_dir, "cast(concat('a', char(0), n_name) as binary)", Config(), "TXT")
    return found.select(F.col("uri").cast("int").alias("id"), F.get(F.col("metas")["leafdefault"], 0).alias("value"))


@query("SELECT n_nationkey AS id, unnest(['TXT', 'HTML', 'XML', 'none']) AS parser, unnest(['<b>' || n_name || '</b>', n_name, n_name, 'unknown parser: none']) AS value FROM nation")
def parser_dispatch(spark, sf_dir):
    """The same content by each parser; an unknown one refuses the document."""
    out = None
    for parser in ("TXT", "HTML", "XML", "none"):
        found = _nations(spark, sf_dir, "concat('<b>', n_name, '</b>')", Config(), parser)
        value = F.coalesce("error", F.btrim(F.regexp_replace(F.get(F.try_element_at("metas", F.lit("leafdefault")), 0), _TIDY, " ")))
        rows = found.select(F.col("uri").cast("int").alias("id"), F.lit(parser).alias("parser"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- tokens

_DEFAULT_WORDS = "list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}''_]+'), lambda x: trim(x, '''_')), lambda x: x <> '')"


@query(f"SELECT term, count(*) AS n, min(strlen(term)) AS len FROM (SELECT unnest({_DEFAULT_WORDS}) AS term FROM documents) GROUP BY term")
def default_tokens(spark, sf_dir):
    """The default tokenizer over whole texts; its letters are those of the expression on all texts of the table."""
    rows = T.text_postings(_table(spark, sf_dir, "documents"), "doc_id", "text", "leafdefault", T.LETTERS)
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.min("len").cast("long").alias("len"))


_W = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_W}(?:[’'']{_W})*')) AS word FROM documents) GROUP BY word")
def default_pattern_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.explode(T.pattern_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# Words and what the stemmer makes of them.
_STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "hopeful": "hope", "adoption": "adopt", "sky": "sky"}


@query(f"SELECT n_nationkey AS id, term, CAST(pos AS INTEGER) AS pos FROM nation, (VALUES {', '.join(f'({v!r}, {i + 1})' for i, v in enumerate(_STEMS.values()))}) s(term, pos)")
def english_stems(spark, sf_dir):
    piece = F.array(F.struct(F.lit("d").alias("meta"), F.lit("d").alias("context"), F.lit(" ".join(_STEMS)).alias("text")))
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uri"), piece.alias("pieces"))
    return T.postings(docs, stem=stemmer("english")).select(F.col("uri").alias("id"), "term", "pos")


def _cut(vowels: str, n: str = "w") -> str:
    return f"CASE WHEN length({n}) < 3 OR NOT regexp_matches({n}, '[{vowels}][^{vowels}]') THEN length({n}) ELSE greatest(3, length(regexp_extract({n}, '^[^{vowels}]*[{vowels}]+[^{vowels}]'))) END"


def _ended(n: str, suffixes: str, start: str = "p1") -> str:
    """The longest of some suffixes behind a place."""
    return f"regexp_extract(substr({n}, CAST({start} AS BIGINT) + 1), '(?:{suffixes.replace(' ', '|')})$')"


_SV, _NO, _DE = "aeiouyäåö", "aeiouyæåø", "aeiouyäöü"
_STEM_SQL = f"""WITH d AS (SELECT DISTINCT w FROM (SELECT unnest({WORDS}) AS w FROM documents)),
sv0 AS (SELECT w, {_cut(_SV)} AS p1 FROM d),
sv1 AS (SELECT *, {_ended("w", "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s")} AS e FROM sv0),
sv2 AS (SELECT w, p1, CASE WHEN e = 's' AND NOT regexp_matches(w, '[bcdfghjklmnoprtvy]s$') THEN w ELSE left(w, length(w) - length(e)) END AS t FROM sv1),
sv3 AS (SELECT w, p1, CASE WHEN {_ended("t", "dd gd nn dt gt kt tt")} <> '' THEN left(t, length(t) - 1) ELSE t END AS t FROM sv2),
sv AS (SELECT w, CASE {_ended("t", "lig ig els löst fullt")} WHEN '' THEN t WHEN 'lig' THEN left(t, length(t) - 3) WHEN 'ig' THEN left(t, length(t) - 2) WHEN 'els' THEN left(t, length(t) - 3) ELSE left(t, length(t) - 1) END AS stem FROM sv3),
no0 AS (SELECT w, {_cut(_NO)} AS p1 FROM d),
no1 AS (SELECT *, {_ended("w", "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert")} AS e FROM no0),
no2 AS (SELECT w, p1, CASE WHEN e = 's' AND NOT regexp_matches(w, '(?:[bcdfghjlmnoprtvyz]|^k|[^{_NO}]k)s$') THEN w WHEN e IN ('erte', 'ert') THEN left(w, length(w) - length(e) + 2) ELSE left(w, length(w) - length(e)) END AS t FROM no1),
no3 AS (SELECT w, p1, CASE WHEN {_ended("t", "dt vt")} <> '' THEN left(t, length(t) - 1) ELSE t END AS t FROM no2),
no AS (SELECT w, left(t, length(t) - length({_ended("t", "leg eleg ig eig lig elig els lov elov slov hetslov")})) AS stem FROM no3),
da0 AS (SELECT w, {_cut(_NO)} AS p1 FROM d),
da1 AS (SELECT *, {_ended("w", "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s")} AS e FROM da0),
da2 AS (SELECT w, p1, CASE WHEN e = 's' AND NOT regexp_matches(w, '[abcdfghjklmnoprtvyzå]s$') THEN w ELSE left(w, length(w) - length(e)) END AS t FROM da1),
da3 AS (SELECT w, p1, CASE WHEN {_ended("t", "gd dt gt kt")} <> '' THEN left(t, length(t) - 1) ELSE t END AS t FROM da2),
da4 AS (SELECT w, p1, CASE WHEN ends_with(t, 'igst') THEN left(t, length(t) - 2) ELSE t END AS t FROM da3),
da5 AS (SELECT w, p1, t, {_ended("t", "ig lig elig els løst")} AS e FROM da4),
da6 AS (SELECT w, p1, e, CASE WHEN e = 'løst' THEN left(t, length(t) - 1) ELSE left(t, length(t) - length(e)) END AS t FROM da5),
da7 AS (SELECT w, p1, CASE WHEN e NOT IN ('', 'løst') AND {_ended("t", "gd dt gt kt")} <> '' THEN left(t, length(t) - 1) ELSE t END AS t FROM da6),
da AS (SELECT w, CASE WHEN {_ended("t", "bb cc dd ff gg hh jj kk ll mm nn pp qq rr ss tt vv ww xx zz")} <> '' THEN left(t, length(t) - 1) ELSE t END AS stem FROM da7),
de0 AS (SELECT w, replace(w, 'ß', 'ss') AS t FROM d),
de1 AS (SELECT w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([{_DE}])u([{_DE}])', '\\1U\\2', 'g'), '([{_DE}])u([{_DE}])', '\\1U\\2', 'g'), '([{_DE}])y([{_DE}])', '\\1Y\\2', 'g'), '([{_DE}])y([{_DE}])', '\\1Y\\2', 'g') AS t FROM de0),
de2 AS (SELECT w, t, {_cut(_DE, "t")} AS p1, CASE WHEN length(t) < 3 OR NOT regexp_matches(t, '^[^{_DE}]*[{_DE}]+[^{_DE}]+[{_DE}]+[^{_DE}]') THEN length(t) ELSE length(regexp_extract(t, '^[^{_DE}]*[{_DE}]+[^{_DE}]+[{_DE}]+[^{_DE}]')) END AS p2, {_ended("t", "em ern er e en es s", "0")} AS e FROM de1),
de3 AS (SELECT w, p1, p2, CASE WHEN length(t) - length(e) < p1 OR e = 's' AND NOT regexp_matches(t, '[bdfghklmnrt]s$') THEN t WHEN e IN ('e', 'en', 'es') THEN regexp_replace(left(t, length(t) - length(e)), 'niss$', 'nis') ELSE left(t, length(t) - length(e)) END AS t FROM de2),
de4 AS (SELECT *, {_ended("t", "en er est st", "0")} AS e FROM de3),
de5 AS (SELECT w, p1, p2, CASE WHEN length(t) - length(e) < p1 OR e = 'st' AND NOT regexp_matches(t, '.{{3}}[bdfghklmnt]st$') THEN t ELSE left(t, length(t) - length(e)) END AS t FROM de4),
de6 AS (SELECT *, {_ended("t", "end ung ig ik isch lich heit keit", "0")} AS e FROM de5),
de7 AS (SELECT w, p1, p2, t, CASE WHEN length(t) - length(e) < p2 OR e IN ('ig', 'ik', 'isch') AND regexp_matches(t, 'e(?:ig|ik|isch)$') THEN '' ELSE e END AS e FROM de6),
de8 AS (SELECT w, p1, p2, e, left(t, length(t) - length(e)) AS t FROM de7),
de9 AS (SELECT w, CASE WHEN e IN ('end', 'ung') AND ends_with(t, 'ig') AND length(t) - 2 >= p2 AND NOT ends_with(t, 'eig') THEN left(t, length(t) - 2) WHEN e IN ('lich', 'heit') AND regexp_matches(t, 'e[rn]$') AND length(t) - 2 >= p1 THEN left(t, length(t) - 2)
  WHEN e = 'keit' AND ends_with(t, 'lich') AND length(t) - 4 >= p2 THEN left(t, length(t) - 4) WHEN e = 'keit' AND ends_with(t, 'ig') AND length(t) - 2 >= p2 THEN left(t, length(t) - 2) ELSE t END AS t FROM de8),
de AS (SELECT w, translate(t, 'UYäöü', 'uyaou') AS stem FROM de9)
SELECT 'swedish' AS language, w AS word, stem FROM sv UNION ALL SELECT 'norwegian', w, stem FROM no UNION ALL SELECT 'danish', w, stem FROM da UNION ALL SELECT 'german', w, stem FROM de"""


@query(_STEM_SQL)
def stems_by_rules(spark, sf_dir):
    """Every word of the documents and its stem in each language that has rules."""
    found = T.tokens(F.col("text"), T.PLAIN_LETTERS, max_word=1 << 20)
    words = _table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(found)).alias("word")).distinct()
    stems = F.array(*(F.struct(F.lit(x).alias("language"), stemmer(x)(F.col("word")).alias("stem")) for x in ("swedish", "norwegian", "danish", "german")))
    return words.select("word", F.inline(stems)).select("language", "word", "stem")


# The character classes in the spelling of another engine.
_CLASSES = {
    "alnum": "[\\p{L}\\p{Nd}]",
    "alpha": "\\p{L}",
    "ascii": "[\\x00-\\x7f]",
    "blank": "[\\p{Zs}\\t]",
    "cntrl": "[\\p{Cc}\\p{Zl}\\p{Zp}]",
    "digit": "[0-9]",
    "graph": "[^\\p{Z}\\p{C}]",
    "lower": "\\p{Ll}",
    "print": "[^\\p{Zl}\\p{Zp}\\p{C}]",
    "punct": "[^\\p{L}\\p{Nd}\\p{Z}\\p{C}]",
    "space": "[\\p{Z}\\x09-\\x0d\\x{85}]",
    "title": "\\p{Lt}",
    "upper": "\\p{Lu}",
    "word": "[\\p{L}\\p{Nd}_]",
    "xdigit": "[0-9A-Fa-f]",
}


@query(f"""WITH c AS (SELECT unnest(regexp_split_to_array(text, '')) AS c FROM documents UNION ALL SELECT unnest(regexp_split_to_array(html, '')) FROM pages)
SELECT CAST(unicode(c) AS INTEGER) AS point, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_full_match(c, '{p}', 's') THEN '{k}' END" for k, p in _CLASSES.items())}], lambda x: x IS NOT NULL), ' ') AS classes, count(*) AS n FROM c WHERE c <> '' GROUP BY c""")
def character_classes(spark, sf_dir):
    """Every character of the corpus, its classes and how often it stands there."""
    texts = _table(spark, sf_dir, "documents").select("text").unionAll(_table(spark, sf_dir, "pages").select("html"))
    chars = texts.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return chars.select(C.code_point("c").alias("point"), F.array_join(C.char_class("c"), " ").alias("classes"), "n")


@query("SELECT n_nationkey AS id, lower('ÄÖ ' || n_name) AS low, ltrim(' ' || chr(9) || n_name, ' ' || chr(9)) AS skipped, 'lower,alpha' AS first FROM nation")
def more_text_helpers(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").withColumn("t", F.concat(F.lit(" \t"), "n_name"))
    first = F.filter(C.char_class(F.lower("n_name")), lambda c: c.isin("lower", "alpha"))
    return rows.select(F.col("n_nationkey").alias("id"), C.lower(F.concat(F.lit("ÄÖ "), "n_name")).alias("low"), C.skip_space("t").alias("skipped"), F.array_join(F.array_sort(first, lambda a, b: F.when(a > b, -1).otherwise(1)), ",").alias("first"))


@query("""WITH w AS (SELECT p_partkey AS id, [p_brand, p_name, p_type || ' "' || p_size, 'of' || p_size || chr(39)] AS words FROM part)
SELECT id, array_to_string(words, '|') AS split, array_to_string(words[1:2] || string_split(p_brand, '#') || words[3:4], '|') AS merged, p_name || chr(9) || p_brand || 'A' || chr(10) || 'q' AS unescaped,
  CAST(p_size AS INTEGER) AS number, p_brand LIKE '%1%' AS yes FROM w JOIN part ON p_partkey = id""")
def word_helpers(spark, sf_dir):
    """Quoted lists, C escapes, numbers and switches that are made of a table's columns."""
    line = F.concat("p_brand", F.lit(" '"), "p_name", F.lit("' \""), "p_type", F.lit(' \\"'), F.col("p_size").cast("string"), F.lit("\" \t'of"), "p_size", F.lit("\\''\nnot read"))
    escapes = F.concat("p_name", F.lit("\\t"), "p_brand", F.lit("\\x41\\012\\q"))
    switch = F.when(F.col("p_brand").contains("1"), F.concat(F.lit("yes "), "p_brand")).otherwise(F.lit("off"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", C.split_words(line).alias("w"), C.unescape_c(escapes).alias("unescaped"), C.to_int(F.concat(F.lit(" +"), "p_size", F.lit("x"))).alias("number"), C.to_bool(switch).alias("yes"))
    merged = C.merge_words(F.slice("w", 3, 2), C.merge_words(F.split("p_brand", "#"), F.slice("w", 1, 2)))
    return rows.select(F.col("p_partkey").alias("id"), F.array_join("w", "|").alias("split"), F.array_join(merged, "|").alias("merged"), "unescaped", "number", "yes")


# ---- searches

def _orders(spark: SparkSession, sf_dir: str) -> Tables:
    """Orders as documents without text: time, day, and the day as a date property; the flags of their lines as a property that repeats."""
    config = corpus_config()
    config.add_property("flag")
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uri"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    when = F.timestamp_seconds("mtime")
    docs = o.withColumns({"day": F.date_format(when, "yyyyMMdd"), "month": F.date_format(when, "yyyyMM"), "year": F.date_format(when, "yyyy")})
    shipped = docs.select("uri", F.lit("shipped").alias("name"), F.lit(0).alias("idx"), F.col("day").alias("value"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("uri"), F.lit("flag").alias("name"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("value"))
    return Tables(config, docs, spark.createDataFrame([], "uri string, meta string, term string, pos int"), shipped.unionByName(lines))


_ORDER_DAY = "strftime(o_orderdate, '%Y%m%d')"


@query(f"SELECT o_orderkey AS id FROM orders WHERE {_ORDER_DAY} BETWEEN '19960101' AND '19960331' AND {_ORDER_DAY} NOT BETWEEN '19960210' AND '19960220'")
def date_range(spark, sf_dir):
    return _orders(spark, sf_dir).search("shipped:19960101..19960331 not shipped:19960210..19960220").select(F.col("uri").cast("long").alias("id"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE {_ORDER_DAY} = '19960704' OR epoch(o_orderdate) = epoch(TIMESTAMP '1997-02-03 00:00:00')")
def day_and_time_terms(spark, sf_dir):
    return _orders(spark, sf_dir).search("D:19960704 or T:854928000").select(F.col("uri").cast("long").alias("id"))


@query(f"""WITH h AS (SELECT o_orderkey FROM orders WHERE {_ORDER_DAY} BETWEEN '1996' AND '1997')
SELECT 'flag' AS facet, coalesce(l_returnflag, '') AS value, count(*) AS n FROM h LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def facet_of_many_values(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return facets(t, t.search("shipped:1996..1997"), ["flag"])


_LONG = [f"w{i}" for i in range(100)]


@query(f"SELECT n_nationkey AS id, 'phrase' AS kind FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'terms' FROM nation WHERE n_nationkey < {len(_LONG)} UNION ALL SELECT n_nationkey, 'all' FROM nation WHERE n_regionkey = 1")
def long_queries(spark, sf_dir):
    """A phrase of a hundred words, and a hundred terms at once."""
    text = F.when(F.col("n_regionkey") == 1, F.lit(" ".join(_LONG))).otherwise(F.concat(F.lit(" ".join(_LONG[:99:2])), F.lit(" w"), F.col("n_nationkey")))
    nation = _table(spark, sf_dir, "nation").withColumn("text", text)
    t = Tables(Config(), nation.select(F.col("n_nationkey").cast("string").alias("uri")), T.text_postings(nation.withColumn("uri", F.col("n_nationkey").cast("string")), "uri", "text", "leafdefault"))
    out = None
    for kind, q in (("phrase", '"' + " ".join(_LONG) + '"'), ("terms", " or ".join(_LONG)), ("all", " and ".join(_LONG))):
        rows = t.search(q).select(F.col("uri").cast("int").alias("id"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- configuration

def _entries(config: Config, source: str) -> list[tuple]:
    metas = [(source, "meta", m.name, m.alias_for or "", str(m.bias)) for m in config.metanames.values() if not m.name.startswith("leaf")]
    props = [(source, "property", p.name, p.alias_for or "", f"{p.type},{p.max},{p.ignore_case}") for p in config.properties.values() if not p.name.startswith("leaf")]
    rest = [(source, kind, name, "", value) for kind, table in (("alias", config.tag_aliases), ("mime", config.mimes), ("parser", config.parsers)) for name, value in table.items() if "nation" in name or "nation" in value]
    return [*metas, *props, *rest, (source, "flag", "cascade", "", str(config.flag("cascade")))]


@query("""WITH n AS (SELECT n_nationkey AS id, n_regionkey AS r, lower(n_name) AS name FROM nation),
c AS (SELECT id, 'meta' AS kind, 'm' || id AS name, '' AS stands_for, CAST(r AS VARCHAR) AS value FROM n UNION ALL SELECT id, 'meta', unnest(string_split(name, ' ')), 'm' || id, CAST(r AS VARCHAR) FROM n
  UNION ALL SELECT id, 'property', 'n', '', '3,' || id + 1 || ',True' FROM n UNION ALL SELECT id, 'property', 'd', '', '2,0,False' FROM n
  UNION ALL SELECT id, 'alias', 'nation' || r, '', 'leafdescription' FROM n UNION ALL SELECT id, 'mime', 'nation' || id, '', 'text/x-' || r FROM n
  UNION ALL SELECT id, 'parser', 'text/x-nation' || id, '', CASE WHEN r % 2 = 0 THEN 'HTML' ELSE 'XML' END FROM n)
SELECT source, c.* FROM c, (VALUES ('text'), ('header'), ('merged')) s(source) WHERE source <> 'merged' OR name <> 'd'
UNION ALL SELECT source, id, 'flag', 'cascade', '', CASE WHEN r % 2 = 1 OR source = 'merged' THEN 'True' ELSE 'False' END FROM n, (VALUES ('text'), ('header'), ('merged')) s(source)
UNION ALL SELECT 'merged', id, 'meta', 'r' || r, '', CAST(id AS VARCHAR) FROM n UNION ALL SELECT 'merged', id, 'property', 'd', '', '1,7,True' FROM n""")
def config_entries(spark, sf_dir):
    """A configuration for each row of a table: as it is read, as its own header gives it back, and with another one on top."""
    own = """concat('<c><MetaNames><m', n_nationkey, ' bias="', n_regionkey, '" id="', 30 + n_nationkey, '">', n_name, '</m', n_nationkey, '></MetaNames><PropertyNames><n type="int" max="', n_nationkey + 1, '"/><d type="date" ignore_case="0"/></PropertyNames>',
      '<TagAlias><leafdescription>nation', n_regionkey, '</leafdescription></TagAlias><MIME><nation', n_nationkey, '>text/x-', n_regionkey, '</nation', n_nationkey, '></MIME>',
      IF(n_regionkey % 2 = 0, '<Parsers><HTML>', '<Parsers><XML>'), 'text/x-nation', n_nationkey, IF(n_regionkey % 2 = 0, '</HTML></Parsers>', '</XML></Parsers>'), '<CascadeMetaContext>', n_regionkey % 2, '</CascadeMetaContext></c>')"""
    other = """concat('<c><MetaNames><r', n_regionkey, ' bias="', n_nationkey, '" id="', 30 + n_nationkey, '"/></MetaNames><PropertyNames><d max="7"/></PropertyNames><CascadeMetaContext>1</CascadeMetaContext></c>')"""

    def entries(batches):
        for rows in batches:
            for i, first, second in zip(rows["id"], rows["own"], rows["other"], strict=True):
                config = Config.read(first)
                header = Config.read(config.to_xml())
                for m in header.metanames.values():
                    # an alias's weight is its target's; headers keep none of its own
                    m.bias = header.metanames[m.alias_for].bias if m.alias_for else m.bias
                found = [*_entries(config, "text"), *_entries(header, "header"), *_entries(config.merge(Config.read(second)), "merged")]
                yield pd.DataFrame([(i, *x) for x in found], columns=["id", "source", "kind", "name", "stands_for", "value"])

    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.expr(own).alias("own"), F.expr(other).alias("other"))
    return rows.mapInPandas(entries, "id int, source string, kind string, name string, stands_for string, value string")


# ---- files and frames

def _as_files(spark: SparkSession, rows: DataFrame, name: str, **options) -> str:
    """A folder with a text file for each row."""
    folder = _scratch(spark, name)
    rows.coalesce(1).write.options(maxRecordsPerFile=1, **options).text(folder)
    return folder


@query("SELECT n_name AS value, CAST(strlen(n_name) + 1 AS BIGINT) AS size, 'txt' AS ext, 'text/plain' AS mime, 'TXT' AS parser, false AS gzipped FROM nation UNION ALL SELECT n_name, NULL, 'txt', 'text/plain', 'TXT', true FROM nation")
def files_of_a_folder(spark, sf_dir):
    """Plain and compressed files of a folder, with what their names say."""
    names, out = _table(spark, sf_dir, "nation").select("n_name"), None
    for zipped, options in ((False, {}), (True, {"compression": "gzip"})):
        found = files.read_files(spark, _as_files(spark, names, "files", **options))
        size = F.lit(None).cast("long") if zipped else F.col("size")
        rows = found.select(F.btrim(F.col("content").cast("string"), F.lit("\n")).alias("value"), size.alias("size"), "ext", "mime", "parser", F.col("is_gzipped").alias("gzipped"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT c_name AS value, CAST(strlen(c_name) + 1 AS BIGINT) AS size, 'TXT' AS parser, CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT NULL, 0, 'HTML', 'empty' FROM (SELECT count(*) FROM customer)""")
def listed_files(spark, sf_dir):
    """A file for each customer in folders of their nations below one that is named with an underscore, listed by many tasks; the writer's mark is an empty file."""
    folder = _scratch(spark, "listing")
    rows = storage.spread(_table(spark, sf_dir, "customer"))
    rows = rows.select(F.concat(F.lit("c_nationkey="), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("none"))).alias("within"), F.concat(F.coalesce("c_name", F.lit("")), F.lit("\n")).alias("content"))
    listing.write_each(rows, f"{folder}/_customers")
    found = listing.read_listed(listing.listed(spark, folder))
    return found.select(F.btrim(F.col("content").cast("string"), F.lit("\n")).alias("value"), "size", "parser", "error")


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(trim(line))) AS BIGINT) AS bytes FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations UNION ALL SELECT CASE WHEN p_partkey % 5 = 0 THEN ' # ' || p_name WHEN p_partkey % 7 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END FROM part) WHERE NOT regexp_matches(line, '^\\s*(#.*)?$')")
def listed_names(spark, sf_dir):
    """The lines of a list that name something."""
    parts = F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat(' # ', p_name) WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END")
    folder = _scratch(spark, "list")
    _table(spark, sf_dir, "conversations").select("text").unionAll(_table(spark, sf_dir, "part").select(parts.alias("text"))).write.text(folder)
    return files.file_list(spark, folder).agg(F.count("*").alias("lines"), F.sum(F.octet_length("uri")).alias("bytes"))


def _framed_files(spark: SparkSession, sf_dir: str) -> str:
    frame = framed.framed(F.col("n_nationkey"), F.concat("n_name", F.lit("\n")), mtime=F.col("n_regionkey"), parser=F.lit("TXT"), action=F.lit("add"))
    # the writer ends the line that is the body
    return _as_files(spark, _table(spark, sf_dir, "nation").select(F.btrim(frame, F.lit("\n")).alias("value")), "framed")


_FRAMED = "SELECT CAST(n_nationkey AS VARCHAR) AS uri, n_name || chr(10) AS body, CAST(n_regionkey AS BIGINT) AS mtime, CAST(strlen(n_name) + 1 AS BIGINT) AS size, 'TXT' AS parser, 'add' AS action FROM nation"


@query(_FRAMED)
def framed_files(spark, sf_dir):
    framed.register(spark)
    return spark.read.format("framed").load(_framed_files(spark, sf_dir)).select("uri", F.col("content").cast("string").alias("body"), "mtime", "size", "parser", "action")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS uri, CAST(o_custkey AS VARCHAR) || ' ' || o_orderpriority || chr(10) AS body, CAST(NULL AS VARCHAR) AS fault FROM orders
UNION ALL SELECT NULL, NULL, 'no size for bad' FROM region""")
def framed_splits(spark, sf_dir):
    """Framed files in ranges that any task reads, after a table of offsets; a head without a good size ends its file with a row that says so."""
    good = framed.framed(F.col("o_orderkey"), F.concat("o_custkey", F.lit(" "), "o_orderpriority", F.lit("\n")), parser=F.lit("TXT"))
    folder = _scratch(spark, "splits")
    lines = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("file"), F.btrim(good, F.lit("\n")).alias("value"), F.lit(0).alias("last"))
    bad = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("o_orderkey"), F.col("r_regionkey").cast("long").alias("file"), F.lit("Content-Length: -45\nContent-Location: bad\n\n").alias("value"), F.lit(1).alias("last"))
    # the writer ends the line that is the body; each task has a file of its own in each folder
    lines.unionByName(bad).repartition("o_orderkey").sortWithinPartitions("file", "last").select("value", "file").write.partitionBy("file").text(folder)
    offsets = None
    for n in range(5):
        found = framed.frame_offsets(spark, f"{folder}/file={n}", split=4096)
        offsets = found if offsets is None else offsets.unionByName(found)
    rows = framed.read_split(offsets)
    return rows.select("uri", F.col("content").cast("string").alias("body"), F.regexp_extract("error", "no size for bad", 0).alias("fault"))


@query(_FRAMED)
def framed_stream(spark, sf_dir):
    """The documents of all files of a folder, as a stream."""
    framed.register(spark)
    name = f"framed_{uuid.uuid4().hex}"
    rows = spark.readStream.format("framed").load(_framed_files(spark, sf_dir)).select("uri", F.col("content").cast("string").alias("body"), "mtime", "size", "parser", "action")
    q = rows.writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


# ---- through the index

def _index(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Index:
    """The documents table as an index in a folder."""
    index = Index(spark, _scratch(spark, "index"), corpus_config())
    index.add(tables.text_documents(_table(spark, sf_dir, "documents") if docs is None else docs, "doc_id", "text"))
    return index


def _ids(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(F.col("uri").cast("long").alias("doc_id"), *names)


_DEFAULT_TOK = f"tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_DEFAULT_WORDS} AS w FROM documents))"


@query(f"""WITH {_DEFAULT_TOK} SELECT doc_id, 'phrase' AS kind FROM (SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the')
UNION ALL SELECT doc_id, 'wildcard' FROM (SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, 'tion'))
UNION ALL SELECT doc_id, 'words' FROM (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) WHERE n > 100""")
def index_searches(spark, sf_dir):
    """Searches and word counts through a written index."""
    t = _index(spark, sf_dir).tables()
    kind = lambda rows, k: _ids(rows).withColumn("kind", F.lit(k))
    # the title field of a text document is its name, one word here
    return kind(t.search('"in the"'), "phrase").unionByName(kind(t.search("tion*"), "wildcard")).unionByName(kind(t.docs.where("nwords - 1 > 100"), "words"))


@query(f"WITH {_DEFAULT_TOK}, len AS (SELECT doc_id, 1 + len({_DEFAULT_WORDS}) AS n FROM documents), " + _BM25.split("AS n FROM documents), ", 1)[1] + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, CAST(doc_id AS VARCHAR) LIMIT 10")
def index_bm25(spark, sf_dir):
    """Relevance through a written index; a document's name counts as one more word."""
    t = _index(spark, sf_dir).tables()
    hits = ranked(t, "thing ing there").withColumn("score", F.round("score", 6))
    return _ids(sorted_hits(t, hits, max=10), "score")


@query(f"WITH {_DEFAULT_TOK}, len AS (SELECT doc_id, 1 + len({_DEFAULT_WORDS}) AS n FROM documents), " + _BM25.split("AS n FROM documents), ", 1)[1] + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, CAST(doc_id AS VARCHAR) LIMIT 25")
def index_top(spark, sf_dir):
    """The best documents of an index of several segments with replaced and deleted documents, without scoring all."""
    documents = tables.text_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")
    third = F.col("uri").cast("long") % 3
    index = Index(spark, _scratch(spark, "index"), corpus_config())
    index.add(documents.where(third < 2).withColumn("content", F.when(third == 1, F.lit("thing thing")).otherwise(F.col("content"))))
    index.delete(_table(spark, sf_dir, "documents").where("doc_id % 6 = 3").select(F.col("doc_id").cast("string").alias("uri")))
    index.add(documents.where((third > 0) | (F.col("uri").cast("long") % 6 == 3)))
    index.compact(most_docs=0)
    return _ids(top(index.tables(), "thing ing there", 25).withColumn("score", F.round("score", 6)), "score")


@query(f"""SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS n FROM
  (SELECT doc_id, unnest({_DEFAULT_WORDS}) AS term FROM documents WHERE doc_id % 7 <> 2) GROUP BY term, doc_id) GROUP BY term""")
def index_terms(spark, sf_dir):
    """The dictionary of an index after adding, replacing and deleting: no posting is read for it."""
    documents = tables.text_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")
    index = Index(spark, _scratch(spark, "index"), corpus_config())
    index.add(documents.withColumn("content", F.when(F.col("uri").cast("long") % 5 == 0, F.lit("old words of it")).otherwise(F.col("content"))))
    index.add(documents.where(F.col("uri").cast("long") % 5 == 0))
    index.delete(_table(spark, sf_dir, "documents").where("doc_id % 7 = 2").select(F.col("doc_id").cast("string").alias("uri")))
    return index.terms().where(F.col("meta") == index.config.default_meta).select("term", "df", "cf")


@query("SELECT 'leafparser' AS facet, 'TXT' AS value, count(*) AS n FROM documents WHERE text <> ''")
def index_facets(spark, sf_dir):
    t = _index(spark, sf_dir).tables()
    return facets(t, t.docs.where("size > 0").select("uri"), ["leafparser"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS found FROM documents WHERE doc_id % 5 <> 0""")
def index_skip_and_delete(spark, sf_dir):
    """Known documents are skipped, repeated ones of a batch count once, deletions hold until a document comes again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    text = lambda df, t: tables.text_documents(df.withColumn("text", F.lit(t)), "doc_id", "text")
    index = Index(spark, _scratch(spark, "index"))
    index.add(text(docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"), "old"))
    index.add(text(docs.where("doc_id % 5 <> 0 OR doc_id % 3 = 0"), "new").unionByName(text(docs.where("doc_id % 7 = 0 AND doc_id % 5 <> 0"), "later")), skip_known=True)
    index.delete(docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("uri")))
    t = index.tables()
    return _ids(t.search("old")).withColumn("found", F.lit("old")).unionByName(_ids(t.search("new")).withColumn("found", F.lit("new")))


@query("SELECT o_custkey AS uri FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey HAVING max_by(o_orderpriority, o_orderkey) LIKE '%URGENT%'")
def stream_upserts(spark, sf_dir):
    """A stream of orders into an index by customer: the last one counts, some are deleted by a later stream."""
    from .streaming.ingest import upsert_stream

    o, into = _table(spark, sf_dir, "orders"), _scratch(spark, "in")
    rows = o.select(F.col("o_custkey").cast("string").alias("uri"), F.col("o_orderpriority").alias("content"), F.lit("TXT").alias("parser"), F.lit("add").alias("action"), F.col("o_orderkey").alias("seq"))
    index, check = Index(spark, _scratch(spark, "index")), _scratch(spark, "progress")
    for batch in (rows, rows.where("uri % 10 = 0").withColumn("action", F.lit("delete"))):
        batch.write.mode("append").parquet(into)
        upsert_stream(spark.readStream.schema(rows.schema).parquet(into), index, check, seq="seq", once=True).awaitTermination()
    return index.tables().search("urgent").select(F.col("uri").cast("long").alias("uri"))


@query(f"WITH {TOK} SELECT count(*) AS matches FROM ({_HAS.format('the')})")
def estimated_matches(spark, sf_dir):
    from .queries import corpus

    return corpus(spark, sf_dir).search("the").agg(F.count("*").alias("matches"))


# ---- dumps, hooks and code points

@query("""SELECT n_nationkey AS id, CAST(unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS at, unnest(['document ' || n_nationkey || ' UTF-8', 'property name 0 ' || n_name,
  'field leafdefault 0 see', 'field leafdefault 1 it', 'field name 0 ' || n_name, 'token 1 leafdefault leafdefault see 3', 'token 2 name leafdefault/name ' || lower(n_name) || ' ' || strlen(n_name), 'token 3 leafdefault leafdefault it 2']) AS line FROM nation""")
def document_dumps(spark, sf_dir):
    """All lines of a document; a field's tag parts the text around it in two values, paths name fields only."""
    from .operators.dumps import document_lines

    config = Config.read("<c><MetaNames><name/></MetaNames><PropertyNames><name/></PropertyNames></c>")
    lines = document_lines(_nations(spark, sf_dir, "concat('<r>see <name>', n_name, '</name> it</r>')", config))
    return lines.select(F.col("uri").cast("int").alias("id"), "at", F.btrim(F.regexp_replace("line", " +", " ")).alias("line"))


@query("SELECT o_orderpriority AS place, term, pos, count(*) AS n FROM (SELECT o_orderpriority, CAST(unnest([1, 2]) AS INTEGER) AS pos, unnest([split_part(o_orderpriority, '-', 1), substr(o_orderpriority, strpos(o_orderpriority, '-') + 1)]) AS term FROM orders) t GROUP BY ALL")
def replaced_tokenizer(spark, sf_dir):
    """Words as a tokenizer of one's own finds them: letter case and spaces stay."""
    o = _table(spark, sf_dir, "orders")
    analyzed = A.analyze_text(o.select(F.col("o_orderpriority").alias("uri"), F.col("o_orderpriority").alias("content")), Config())
    rows = T.postings(analyzed, tokenizer=lambda text: F.split(text, "-", 2)).where(F.col("meta") == Config().default_meta)
    return rows.groupBy(F.col("uri").alias("place"), "term", "pos").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, strlen(left(text, 7)) AS seventh, CASE WHEN contains(text, 'e') THEN length(text) - strpos(reverse(text), 'e') ELSE -1 END AS last_e,
  nullif(substr(text, 4, 1), '') AS fourth, CASE WHEN strlen(text) <= 7 THEN length(text) ELSE (SELECT count(*) - 1 FROM (SELECT unnest(range(1, 9)) AS i) WHERE substr(hex(encode(text)), 2 * i - 1, 1) NOT IN ('8', '9', 'A', 'B')) END AS char_of_byte
  FROM documents""")
def code_point_places(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", C.byte_offset(text, 7).cast("long").alias("seventh"), C.last_char_index(text, "e").cast("long").alias("last_e"), C.char_at(text, 3).alias("fourth"), C.char_offset(text, 7).cast("long").alias("char_of_byte"),
    )


@query("SELECT DISTINCT c_custkey AS uri FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def uris_without_match(spark, sf_dir):
    """Keys that a table lacks, with some to find."""
    from .plans import merge

    keys, there = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uri")), _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return merge.missing(there.select(F.col("o_custkey").alias("uri")), keys, "uri")

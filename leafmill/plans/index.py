"""The index: a folder of Parquet segments that only grows, a log, and a header.

    header.xml          configuration and index settings
    log/                one entry a commit (commits.py)
    segments/*/         docs, props, metas, blocks and terms of one commit
    dead/*, less/*      bitmaps of dead documents; corrections of dictionaries

A commit writes one segment; nothing that is there is rewritten. It also finds
the documents that it replaces, by one join of uris, and writes the bitmaps of
all dead documents and what those take from the dictionary. Reading needs no
aggregation then: rows of dead documents are left out by their chunk's bits.
compact() writes one segment of what is live, of all segments or of the small
ones. What a writer that failed has left is not in the log and is not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..operators import analyze as A
from ..operators.includes import included
from ..operators.stem import stemmer
from ..operators.tokens import piece_words, postings, word_total
from ..sources import storage
from . import blocks as B
from .commits import Log, Segment, State
from .query import Phrase, Tables, Term


def analyzed(docs: DataFrame, config: Config, stored: bool = False) -> DataFrame:
    """Fields and text pieces of source documents. Plain text goes through column expressions, markup through the parsing stage.

    Of a stored table the parsers are looked at first; without markup there is no parsing stage.
    """
    if dict(docs.dtypes)["content"] != "string":
        return A.analyze(docs, config)
    text = F.coalesce(F.upper(F.substring("parser", 1, 1)) == "T", F.lit(False))
    if stored and docs.where(~text).isEmpty():
        return A.analyze_text(docs, config)
    return A.analyze_text(docs.where(text), config).unionByName(A.analyze(docs.where(~text), config))


#: How blocks are written: whole numbers as differences.
PAGES = {"parquet.writer.version": "v2"}

_OWN = {"mtime": "long", "size": "long", "mime": "string", "ext": "string", "parser": "string", "action": "string"}


def doc_rows(docs: DataFrame, found: DataFrame, words: DataFrame | None = None, count: int = 0) -> DataFrame:
    """The docs table: what the source says of each of `count` documents, its encoding, its words and its day."""
    own = docs.select("uri", *(F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in _OWN.items()))
    when = F.timestamp_seconds(F.coalesce("mtime", F.lit(0)))
    if words is None:
        own = own.join(B.by_shuffle(found.select("uri", "encoding", "doc", "nwords"), count), "uri")
    else:
        own = own.join(found.select("uri", "encoding"), "uri").join(words, "uri", "left").withColumn("nwords", F.coalesce("nwords", F.lit(0).cast("long")))
    return own.withColumns({"day": F.date_format(when, "yyyyMMdd"), "month": F.date_format(when, "yyyyMM"), "year": F.date_format(when, "yyyy")})


def analyzed_tables(docs: DataFrame, config: Config, language: str = "none") -> dict[str, DataFrame]:
    """docs, props, metas and postings of source documents (uri, content, mtime, size, mime, parser, ...), without a folder."""
    found = analyzed(docs, config).where("error IS NULL")
    p = postings(found, stem=stemmer(language))
    own = doc_rows(docs, found, p.groupBy("uri").agg(F.count("*").alias("nwords")))
    return {"docs": own, "props": A.field_values(found, "properties"), "metas": A.field_values(found, "metas"), "postings": p if config.flag("tokenize") else p.limit(0)}


@dataclass
class Stored(Tables):
    """What is searched in a folder; documents go by (segment, doc), and uris are joined to matches only."""

    blocks: DataFrame | None = None
    dead: DataFrame | None = None
    terms: DataFrame | None = None
    n_docs: int = 0
    n_words: int = 0

    @property
    def keys(self) -> tuple[str, ...]:
        return ("segment", "doc")

    def live_postings(self, condition=None) -> DataFrame:
        rows = self.blocks if condition is None else self.blocks.where(condition)
        return B.alive(B.postings(rows), self.dead)

    def term_rows(self, condition) -> DataFrame:
        return self.live_postings(condition).select(*self.keys, "meta", "term", "tf")

    def phrase_starts(self, leaf: Phrase) -> DataFrame:
        """(segment, doc, meta, start): where all words of a phrase stand in a row.

        A row for each word and document goes to the document, with its places
        as one array; the starts are what the arrays have in common.
        """
        words = [self._word(w) for w in leaf.words]
        distinct = sorted(set(words))
        rows = self.live_postings(F.col("term").isin(distinct) & self.field_filter(leaf.field)).select(*self.keys, "meta", "term", "positions")
        by_word = rows.groupBy(*self.keys, "meta").agg(*(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{i}") for i, w in enumerate(distinct)))
        for i in range(len(distinct)):
            by_word = by_word.where(F.col(f"w{i}").isNotNull())
        # a function of one argument: with two the second would be an index
        earlier = lambda i: lambda x: x - i
        starts = None
        for i, w in enumerate(words):
            own = F.transform(f"w{distinct.index(w)}", earlier(i))
            starts = own if starts is None else F.array_intersect(starts, own)
        return by_word.select(*self.keys, "meta", F.explode(starts).alias("start"))

    def bounds(self, counted: dict[Term, int]) -> DataFrame:
        """(segment, chunk, tf0, ..., words0, ...): the greatest weighted count and the least length of each term in a chunk.

        Only the heads of blocks are read, no arrays.
        """
        weight = self.weight()
        conditions = {x: self.leaf_condition(x) for x in counted}
        wanted = None
        for c in conditions.values():
            wanted = c if wanted is None else wanted | c
        heads = self.blocks.where(wanted).select("segment", "chunk", "meta", "term", "max_tf", "min_words")
        # a chunk with very many words has several blocks of a term and field
        most = heads.groupBy("segment", "chunk", "meta", "term").agg(F.max("max_tf").alias("max_tf"), F.min("min_words").alias("min_words"))
        tfs = [F.coalesce(F.sum(F.when(conditions[x], weight * F.col("max_tf"))), F.lit(0)).alias(f"tf{i}") for x, i in counted.items()]
        words = [F.min(F.when(conditions[x], F.col("min_words"))).alias(f"words{i}") for x, i in counted.items()]
        return most.groupBy("segment", "chunk").agg(*tfs, *words)

    def within(self, chunks: DataFrame) -> Stored:
        """The same, with blocks of some chunks (segment, chunk) only."""
        return replace(self, blocks=self.blocks.join(chunks, ["segment", "chunk"], "left_semi"))

    def with_uri(self, rows: DataFrame) -> DataFrame:
        return rows.join(B.by_shuffle(self.docs.select(*self.keys, "uri"), self.n_docs), list(self.keys))

    def corpus(self) -> DataFrame:
        figures = F.lit(self.n_docs).alias("n_docs"), F.lit(self.n_words / max(1, self.n_docs)).alias("avg_words")
        return self.docs.sparkSession.range(1).select(*figures)

    def entry(self, leaf: Term):
        """Which rows of the dictionary are a term's."""
        meta = B.BOTH if leaf.field is None else self.config.meta_target(leaf.field)
        return (F.col("term") == self._word(leaf.word)) & (F.col("meta") == meta)

    def document_counts(self, counted: dict) -> DataFrame:
        """One row: how many documents have each leaf. Terms come from the dictionary, the rest is counted."""
        terms = {x: i for x, i in counted.items() if isinstance(x, Term)}
        rest = {x: i for x, i in counted.items() if not isinstance(x, Term)}
        out = None
        if terms:
            wanted = None
            for x in terms:
                wanted = self.entry(x) if wanted is None else wanted | self.entry(x)
            out = self.terms.where(wanted).agg(*(F.coalesce(F.sum(F.when(self.entry(x), F.col("df"))), F.lit(0)).alias(f"df{i}") for x, i in terms.items()))
        if rest:
            more = super().document_counts(rest)
            out = more if out is None else out.crossJoin(F.broadcast(more))
        return out


class Index:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, language: str | None = None, overwrite: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")
        header = f"{self.path}/header.xml"
        if overwrite:
            storage.remove(spark, self.path)
        if storage.exists(spark, header):
            stored = Config.read(storage.read_text(spark, header), prefix=(config or Config()).prefix)
            self.config = stored.merge(config) if config is not None else stored
            kept = stored.index.get("Stemmer", "none")
            if language is not None and language != kept:
                raise ConfigError(f"the index has stemmer {kept}, not {language}")
            self.language = kept
        else:
            self.config, self.language = config or Config(), language or "none"
        stemmer(self.language)
        self.config.index["Stemmer"] = self.language

    # ---- segments

    def segments(self) -> list[int]:
        return [s.id for s in self.log.state().segments]

    def _new_segment(self) -> tuple[int, str]:
        name = uuid.uuid4()
        return name.int >> 97, f"segments/{name.hex}"

    def _write(self, folder: str, name: str, df: DataFrame, **options) -> DataFrame:
        df.write.options(**options).parquet(f"{self.path}/{folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}/{name}")

    def write_header(self) -> None:
        storage.write_text(self.spark, f"{self.path}/header.xml", self.config.to_xml())

    def _read(self, name: str, segments: list[Segment]) -> DataFrame | None:
        out = None
        for s in segments:
            df = self.spark.read.parquet(f"{self.path}/{s.folder}/{name}").withColumn("segment", F.lit(s.id))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def _dead(self, state: State) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{state.dead}") if state.dead else None

    def live(self, state: State | None = None) -> DataFrame | None:
        """(uri, segment, doc, nwords) of the documents that count."""
        state = state or self.log.state()
        docs = self._read("docs", state.segments)
        return None if docs is None else B.alive(docs.select("uri", "segment", "doc", "nwords"), self._dead(state))

    @property
    def _both(self) -> list[str]:
        return [self.config.default_meta, self.config.title_meta]

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    # ---- writing

    def _without(self, state: State, dead: DataFrame) -> State | None:
        """The state in which documents (segment, doc, nwords), written to a table, are dead too; none if there are none."""
        figures = {r["segment"]: (r["n"], r["words"]) for r in dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("nwords").alias("words")).collect()}
        if not figures:
            return None
        name = uuid.uuid4().hex
        bits = self._write("dead", name, B.bitmaps(dead, self._dead(state)))
        new = self._write(f"dead/_{uuid.uuid4().hex}", "new", B.bitmaps(dead))
        # blocks of few words look small, so Spark would send them rather than the bitmaps
        less = B.corrections(self._read("blocks", [s for s in state.segments if s.id in figures]), B.sent(new, new.count()), self._both)
        self._write("less", name, less)
        segments = [replace(s, docs=s.docs - figures[s.id][0], words=s.words - figures[s.id][1]) if s.id in figures else s for s in state.segments]
        return replace(state, segments=segments, dead=f"dead/{name}", corrections=[*state.corrections, f"less/{name}"])

    def add(self, docs: DataFrame, skip_known: bool = False, seq: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Index documents; those with a known uri are replaced, or left out with skip_known.

        Of equal uris in one batch the last by `seq` and then in the order of the
        rows counts, the first with skip_known. Returns how many were indexed.
        `batch` names a stream and a number in it; a batch that was committed is
        not indexed again.

        The batch is written to the new segment first, and parsed and tokenized
        once; contents are shuffled only if it repeats a uri or skips known ones.
        """
        start = self.log.state()
        if start.seen(batch):
            return 0
        number, folder = self._new_segment()
        row = F.monotonically_increasing_id().alias("_row")
        rows = self._write(folder, "_rows", storage.spread(docs.where(F.col("uri").isNotNull()).select("*", row)))
        by = F.struct(F.col(seq), F.col("_row")) if seq else F.struct("_row")
        pick = F.min(by) if skip_known else F.max(by)
        marks = rows.groupBy("uri").agg(F.count("*").alias("n"), pick["_row"].alias("_row"))
        known = self.live(start)
        if skip_known and known is not None:
            marks = marks.join(B.by_shuffle(known.select("uri"), start.docs), "uri", "left_anti")
        marks = self._write(folder, "_marks", marks)
        count = marks.count()
        if count and (skip_known and known is not None or not marks.where("n > 1").isEmpty()):
            rows = rows.join(B.by_shuffle(marks.select("_row"), count), "_row", "left_semi")
        if count:
            with B.small_batches(self.spark):
                self._segment(folder, rows)
            own = self._read("docs", [Segment(number, folder, 0, 0)])
            words, count = own.agg(F.sum("nwords").alias("w"), F.count("*").alias("n")).first()

            def prepare(state: State) -> State:
                segment = Segment(number, folder, count, words or 0)
                new = replace(state, segments=[*state.segments, segment])
                if skip_known and state.version == start.version:
                    return new
                # what came since this writer looked counts as known; otherwise the new document replaces the old one
                old, mine = self.live(state), own.select("uri", "segment", "doc", "nwords")
                if old is None:
                    return new
                uris = lambda of, n: B.by_shuffle(of.select("uri"), n)
                gone = mine.join(uris(old, state.docs), "uri", "left_semi") if skip_known else old.join(uris(mine, count), "uri", "left_semi")
                return self._without(new, self._write(f"dead/_{uuid.uuid4().hex}", "gone", gone.drop("uri"))) or new

            self.log.commit(prepare, batch)
            self.write_header()
        for name in ("_rows", "_marks", "_analyzed", "_defined", "_analyzed_parts", "_analyzed_whole", "_defined_parts", "_defined_whole"):
            storage.remove(self.spark, f"{self.path}/{folder}/{name}")
        if not count:
            storage.remove(self.spark, f"{self.path}/{folder}")
        return count

    def _segment(self, folder: str, rows: DataFrame) -> None:
        """Write the tables of documents."""
        def with_words(found: DataFrame) -> DataFrame:
            return found.withColumn("words", piece_words("pieces")).withColumn("nwords", word_total("words")).withColumn("some", B.some_words("words", "uri")).drop("pieces")

        def written(name: str) -> DataFrame:
            found = self._write(folder, name, with_words(analyzed(rows, self.config, stored=True).withColumn("doc", F.monotonically_increasing_id())))
            if not self.config.flag("follow_xinclude"):
                return found
            # documents of one batch may include each other
            whole = included(found, rows, self.config, f"{self.path}/{folder}/{name}_parts", "doc", ("words",), with_words)
            if whole is found:
                return found
            # numbers rise within a task, and a chunk lies in one
            whole = whole.withColumn("nwords", word_total("words")).repartitionByRange(self._parts(), B.chunk_of(F.col("doc"))).sortWithinPartitions("doc")
            return self._write(folder, f"{name}_whole", whole)

        found = written("_analyzed")
        policies = {self.config.flag("undefined_tags"), self.config.flag("undefined_attributes")}
        if policies & {"auto", "autoall"}:
            # names that other documents have defined count in a second parse
            self.config = A.discover(found, self.config)
            found = written("_defined")
        found = found.where("error IS NULL")
        stem = partial(stem_word, language=self.language) if stemmer(self.language) else None
        found_words = found if self.config.flag("tokenize") else found.limit(0)
        near = B.blocks(found_words, stem, self._both, B.term_bounds(found_words, self._parts(), stem))
        blocks = self._write(folder, "blocks", B.ranged(near, self._parts()), **PAGES)
        self._terms(folder, blocks)
        self._write(folder, "docs", doc_rows(rows, found, count=found.count()))
        for name in ("props", "metas"):
            values = A.field_values(found.withColumn("uri", F.struct("uri", "doc")), "properties" if name == "props" else name)
            self._write(folder, name, values.select("uri.uri", "uri.doc", "name", "idx", "value"))

    def _terms(self, folder: str, blocks: DataFrame) -> DataFrame:
        return self._write(folder, "terms", self._by_term(B.dictionary(blocks, self._both)))

    def _by_term(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(self._parts(), "term", "meta").sortWithinPartitions("term", "meta")

    def delete(self, uris: DataFrame | list[str], batch: tuple[str, int] | None = None) -> tuple[int, list[str] | DataFrame]:
        """Delete documents by uri; how many were there, and the uris that were not."""
        given = self.spark.createDataFrame([(u,) for u in uris], "uri string") if isinstance(uris, list) else uris.select("uri")
        given, known = given.distinct(), self.live()
        if known is None:
            return 0, uris
        missing = given.join(B.by_shuffle(known.select("uri"), self.log.state().docs), "uri", "left_anti")
        missing = [r["uri"] for r in missing.collect()] if isinstance(uris, list) else missing
        n = 0

        def prepare(state: State) -> State | None:
            nonlocal n
            gone = self._write(f"dead/_{uuid.uuid4().hex}", "gone", self.live(state).join(B.by_shuffle(given, state.docs), "uri", "left_semi").drop("uri"))
            n = gone.count()
            return self._without(state, gone)

        if self.log.commit(prepare, batch) is not None:
            self.write_header()
        return n, missing

    def compact(self, most_docs: int | None = None) -> None:
        """Write what is live of all segments, or of those with at most so many documents, as one segment."""
        def prepare(state: State) -> State | None:
            number, folder = self._new_segment()
            old = [s for s in state.segments if most_docs is None or s.docs <= most_docs]
            if not old or (len(old) == 1 and not state.dead):
                return None
            docs = self._read("docs", old)
            chunks = B.live_chunks(B.alive(docs.select("segment", "doc"), self._dead(state)), sum(s.docs for s in old))
            numbers = self._write(folder, "_numbers", B.renumbering(self._write(folder, "_chunks", chunks)))
            numbers = B.sent(numbers, numbers.count())
            for name in ("docs", "props", "metas"):
                self._write(folder, name, B.renumbered(self._read(name, old), numbers))
            self._write(folder, "blocks", B.rechunked(self._read("blocks", old), numbers, self._parts()), **PAGES)
            # what the old segments and their corrections have together
            rows = self._dictionary(replace(state, segments=old)).groupBy("meta", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
            self._write(folder, "terms", self._by_term(rows))
            for name in ("_chunks", "_numbers"):
                storage.remove(self.spark, f"{self.path}/{folder}/{name}")
            segment = Segment(number, folder, sum(s.docs for s in old), sum(s.words for s in old))
            kept = [s for s in state.segments if s not in old]
            out = replace(state, segments=[*kept, segment])
            return out if kept else replace(out, dead=None, corrections=[])

        before = self.log.state()
        after = self.log.commit(prepare)
        if after is not None:
            self.write_header()
            now = {s.folder for s in after.segments}
            for s in before.segments:
                if s.folder not in now:
                    storage.remove(self.spark, f"{self.path}/{s.folder}")

    # ---- reading

    def tables(self) -> Stored:
        """What can be searched."""
        state = self.log.state()
        if not state.segments:
            raise ConfigError(f"no index in {self.path}")
        stem = stemmer(self.language)
        word = partial(stem_word, language=self.language) if stem else None
        dead = self._dead(state)
        live = lambda name: B.alive(self._read(name, state.segments), dead)
        postings_ = self._read("blocks", state.segments)
        t = Stored(self.config, live("docs"), None, live("props"), word, blocks=postings_, dead=dead, terms=self._dictionary(state), n_docs=sum(s.docs for s in state.segments), n_words=sum(s.words for s in state.segments))
        t.postings = t.with_uri(B.paths(postings_)).select("uri", "meta", "context", "term", "pos", F.octet_length("term").alias("len"))
        return t

    def _dictionary(self, state: State) -> DataFrame:
        """(meta, term, df, cf) rows of all segments and their corrections, to be summed."""
        out = self._read("terms", state.segments).select("meta", "term", "df", "cf")
        for folder in state.corrections:
            less = self.spark.read.parquet(f"{self.path}/{folder}").where(F.col("of").isin([s.id for s in state.segments]))
            out = out.unionByName(less.select("meta", "term", "df", "cf"))
        return out

    def terms(self) -> DataFrame:
        """(meta, term, df, cf): documents and places of each term, from the dictionary."""
        rows = self.tables().terms.where(F.col("meta") != B.BOTH)
        return rows.groupBy("meta", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


def stem_word(word: str, language: str) -> str:
    from ..operators.stem import STEMMERS

    return STEMMERS[language](word)

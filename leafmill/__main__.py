"""Command line: python -m leafmill COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from .api import Analyzer, Engine
from .config import Config


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    lint = sub.add_parser("lint", help="parse files or a framed stream (-) and print what they give")
    lint.add_argument("-c", "--config")
    lint.add_argument("-v", "--verbose", action="store_true")
    lint.add_argument("files", nargs="+")
    tok = sub.add_parser("tokenize", help="tokens of strings")
    tok.add_argument("-p", "--pattern")
    tok.add_argument("text", nargs="+")
    head = sub.add_parser("header", help="read configurations and print the header form")
    head.add_argument("files", nargs="+")
    chars = sub.add_parser("chars", help="code points and classes of characters")
    chars.add_argument("text", nargs="+")
    index = sub.add_parser("index", help="index files")
    index.add_argument("-i", "--index", required=True)
    index.add_argument("-c", "--config")
    index.add_argument("-t", "--stemmer")
    index.add_argument("-S", "--skip", action="store_true", help="keep documents that are there")
    index.add_argument("-D", "--delete", action="store_true", help="delete the named documents")
    index.add_argument("--overwrite", action="store_true")
    index.add_argument("-f", "--filelist", action="store_true", help="the files are lists of files")
    index.add_argument("files", nargs="+")
    search = sub.add_parser("search", help="search an index")
    search.add_argument("-i", "--index", required=True)
    search.add_argument("-q", "--query", required=True)
    search.add_argument("-s", "--sort")
    search.add_argument("-L", "--limit", action="append", default=[])
    search.add_argument("-F", "--facets")
    search.add_argument("-b", "--begin", type=int, default=0)
    search.add_argument("-m", "--max", type=int, default=100)
    search.add_argument("-x", "--format")
    a = p.parse_args(argv)
    return globals()[f"_{a.command}"](a)


def _lint(a) -> int:
    total = 0

    def show(d) -> None:
        nonlocal total
        total += d.doc["nwords"]
        print(f"{d.doc['uri']} nwords: {d.doc['nwords']}")
        for w in d.warnings:
            print(f"warning: {w}", file=sys.stderr)
        if a.verbose:
            for kind in (d.properties, d.metanames):
                for k, vs in kind.items():
                    for v in vs:
                        print(f"<{k}>{v}</{k}>")

    engine, n = Engine(Config.read(a.config) if a.config else None, show), 0
    for name in a.files:
        n += engine.parse_stream(sys.stdin.buffer) if name == "-" else bool(engine.parse_file(name))
    print(f"{n} files, total words: {total}")
    return 0


def _tokenize(a) -> int:
    engine = Engine(analyzer=Analyzer(pattern=a.pattern))
    for t in engine.tokenize(" ".join(a.text)):
        print(t.pos, t.value)
    return 0


def _header(a) -> int:
    config = Config()
    for name in a.files:
        config.add(name)
    print(config.to_xml(), end="")
    return 0


def _chars(a) -> int:
    import unicodedata

    for c in " ".join(a.text):
        print(f"{c!r} U+{ord(c):04X} {len(c.encode())} bytes {unicodedata.category(c)} {unicodedata.name(c, '')}")
    return 0


def _index(a) -> int:
    from .plans.index import Index
    from .sources import files

    spark = _spark()
    index = Index(spark, a.index, Config.read(a.config) if a.config else None, a.stemmer, a.overwrite)
    if a.delete:
        names = [r["uri"] for f in a.files for r in files.file_list(spark, f).collect()] if a.filelist else a.files
        n, missing = index.delete(names)
        print(f"# {n} documents deleted")
        for m in missing:
            print(f"# not in the index: {m}")
        return 0
    docs = None
    for f in a.files:
        one = files.read_listed(spark, f, index.config) if a.filelist else files.read_files(spark, f, index.config)
        docs = one if docs is None else docs.unionByName(one)
    print(f"# {index.add(docs, a.skip)} documents indexed")
    return 0


def _search(a) -> int:
    from .functions.words import split_words
    from .plans.index import Index
    from .plans.rank import ranked, with_percent
    from .plans.results import facets, rendered, sorted_hits

    tables = Index(_spark(), a.index).tables()
    hits = with_percent(ranked(tables, a.query, a.limit)).cache()
    page = sorted_hits(tables, hits, a.sort, a.begin, a.max).cache()
    print(f"# Results include {page.count()} of {hits.count()} total matches")
    lines = {r["uri"]: r["line"] for r in rendered(tables, page, a.format).collect()}
    for r in page.select("uri").collect():
        print(lines[r["uri"]], end="")
    if a.facets:
        for r in facets(tables, hits, split_words(a.facets)).collect():
            print(f"# {r['facet']} {r['value']!r}: {r['n']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

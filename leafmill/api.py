"""The object interface: a handler over parsed documents, and the pieces one by one."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GAP, Config
from .operators import analyze as A
from .operators import markup
from .operators.dumps import config_lines
from .operators.tokens import postings
from .plans.query import split_text
from .sources import files, framed, mime

_WORD = regex.compile(r"\w+(?:[’']\w+)*")


@dataclass
class Token:
    """One word: its place, field, tag path and bytes."""

    value: str
    pos: int
    meta: str
    context: str

    @property
    def len(self) -> int:
        return self.value.encode().__len__()


@dataclass
class Analyzer:
    """Settings of the tokenizer; `tokenizer` replaces it."""

    tokenize: bool = True
    pattern: str | None = None
    tokenizer: Callable[[str], list[str]] | None = None
    stemmer: Callable[[str], str] | None = None

    def words(self, text: str) -> list[str]:
        if self.tokenizer:
            out = self.tokenizer(text)
        elif self.pattern is not None:
            out = regex.findall(self.pattern, text)
        else:
            out = split_text(text)
        return [self.stemmer(w) for w in out] if self.stemmer else out


@dataclass
class Document:
    """What a handler gets: metadata, properties, fields and tokens of one document."""

    doc: dict
    config: Config
    properties: dict[str, list[str]]
    metanames: dict[str, list[str]]
    pieces: list[tuple[str, str, str]]
    analyzer: Analyzer = field(default_factory=Analyzer)
    warnings: list[str] = field(default_factory=list)

    def property(self, name: str) -> str | None:
        found = self.properties.get(name)
        return GAP.join(found) if found else None

    def metaname(self, name: str) -> str | None:
        found = self.metanames.get(name)
        return GAP.join(found) if found else None

    def tokens(self) -> Iterator[Token]:
        pos = 0
        if not self.analyzer.tokenize:
            return
        for meta, context, text in self.pieces:
            for i, part in enumerate(text.split(GAP) if self.analyzer.pattern is None else [text]):
                pos += i > 0
                for w in self.analyzer.words(part):
                    pos += 1
                    yield Token(w, pos, meta, context)

    def count_words(self) -> int:
        return sum(1 for _ in self.tokens())

    def dump(self) -> str:
        """Metadata, properties, fields and tokens as lines to read."""
        out = [f"{k}={v}" for k, v in sorted(self.doc.items())]
        for kind, table in (("property", self.properties), ("field", self.metanames)):
            out += [f"{kind} {name} {i} {v.replace(GAP, '|')}" for name, values in sorted(table.items()) for i, v in enumerate(values)]
        return "\n".join(out + [f"token {t.pos} {t.meta} {t.context} {t.value} {t.len}" for t in self.tokens()])


class Engine:
    """Parse single documents in this process, or tables of them on a cluster."""

    def __init__(self, config: Config | str | None = None, handler: Callable[[Document], None] | None = None, analyzer: Analyzer | None = None, stash: dict | None = None):
        self.config = Config.read(config) if isinstance(config, str) else config or Config()
        self.handler, self.analyzer, self.stash = handler, analyzer or Analyzer(), stash if stash is not None else {}
        if not self.config.flag("tokenize"):
            self.analyzer.tokenize = False

    def parse(self, what) -> Document | int:
        """A path, a framed buffer (bytes) or an open stream of frames."""
        if isinstance(what, (bytes, bytearray)):
            return self.parse_buffer(bytes(what))
        if hasattr(what, "read"):
            return self.parse_stream(what)
        return self.parse_file(what)

    def _deliver(self, info: dict, content: bytes) -> Document:
        got = markup.analyze(content, info["parser"], self.config, info["uri"], info.get("encoding"))
        for name in got.new_metas:
            if name not in self.config.metanames:
                self.config.add_meta(name)
        for name in got.new_properties:
            if name not in self.config.properties:
                self.config.add_property(name)
        out = Document(info | {"encoding": got.encoding}, self.config, got.properties, got.metas, got.pieces, self.analyzer, got.warnings)
        out.doc["nwords"] = out.count_words()
        if self.handler:
            self.handler(out)
        return out

    def parse_file(self, path: str) -> Document:
        import os

        stat = os.stat(path)
        info = {"uri": path, "mtime": int(stat.st_mtime), "size": stat.st_size, "ext": self.real_ext(path), "is_gzipped": path.lower().endswith(".gz")}
        info["mime"] = self.config.mimes.get(info["ext"] or "", mime.DEFAULT_MIME)
        return self._deliver(self._with_parser(info), self.slurp(path))

    def _with_parser(self, info: dict) -> dict:
        info["mime"] = info.get("mime") or self.config.mimes.get(info.get("ext") or self.real_ext(info["uri"]) or "", mime.DEFAULT_MIME)
        info["parser"] = info.get("parser") or self.config.parsers.get(info["mime"]) or self.config.parsers.get("default", "HTML")
        return info

    def parse_buffer(self, buffer: bytes) -> Document:
        doc = framed.parse_buffer(buffer)
        return self._deliver(self._with_parser(doc), doc.pop("content"))

    def parse_stream(self, stream) -> int:
        """Parse all documents of a framed stream; how many there were."""
        n = 0
        for n, (doc, _) in enumerate(framed.read_frames(stream), 1):  # noqa: B007
            self._deliver(self._with_parser(doc), doc.pop("content"))
        return n

    def parse_directory(self, path: str, follow_links: bool = False) -> int:
        """Parse all files below a folder, depth first; names with a leading dot are left out."""
        import os

        n = 0
        for entry in sorted(os.scandir(path), key=lambda e: e.name):
            if entry.name.startswith(".") or entry.is_symlink() and not follow_links:
                continue
            if entry.is_dir():
                n += self.parse_directory(entry.path, follow_links)
            else:
                self.parse_file(entry.path)
                n += 1
        return n

    @staticmethod
    def slurp(path: str) -> bytes:
        """A file's bytes, of a gzip file those inside; too large files are refused."""
        import gzip

        from .config import MAX_FILE

        with (gzip.open if path.lower().endswith(".gz") else open)(path, "rb") as f:
            out = f.read(MAX_FILE + 1)
        if len(out) > MAX_FILE:
            raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        return out

    def tokenize(self, text: str) -> list[Token]:
        """Tokens of a text in the default field."""
        m = self.config.default_meta
        return list(Document({}, self.config, {}, {}, [(m, m, text)], self.analyzer).tokens())

    @staticmethod
    def real_ext(path: str) -> str | None:
        name = path.rsplit("/", 1)[-1]
        if name.lower().endswith(".gz"):
            name = name[:-3]
        return name.rsplit(".", 1)[1].lower() if "." in name else None

    def get_mime(self, path: str) -> str | None:
        """The MIME type of a file name, None if it is unknown."""
        name = path.rsplit("/", 1)[-1]
        return self.config.mimes.get(name.rsplit(".", 1)[1].lower()) if "." in name else None

    def get_real_mime(self, path: str) -> str | None:
        return self.config.mimes.get(self.real_ext(path) or "")

    # ---- tables

    def read(self, spark: SparkSession, paths: str | list[str]) -> DataFrame:
        return files.read_files(spark, paths, self.config)

    def analyze(self, docs: DataFrame) -> DataFrame:
        return A.analyze(docs, self.config)

    def postings(self, docs: DataFrame, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
        """Tokens with positions; `tokenizer` gives the words of a text column as an array."""
        return postings(self.analyze(docs), tokenizer=tokenizer)

    def dump(self) -> str:
        """The configuration as lines to read."""
        return "\n".join(config_lines(self.config))

    def totals(self, docs: DataFrame) -> DataFrame:
        """One row: files, words."""
        return self.postings(docs).agg(F.count_distinct("uri").alias("files"), F.count("*").alias("words"))


def frames_of(data: bytes) -> Iterator[dict]:
    """The documents of a framed buffer."""
    return (d for d, _ in framed.read_frames(io.BytesIO(data)))

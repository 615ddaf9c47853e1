"""Documents to fields, properties and text pieces, on executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import markup

SCHEMA = (
    "uri string, encoding string, properties map<string,array<string>>, metas map<string,array<string>>, "
    "pieces array<struct<meta:string,context:string,text:string>>, warnings array<string>, new_metas array<string>, new_properties array<string>, error string, "
    "includes array<struct<target:string,kind:string>>"
)
_STRINGS = pa.list_(pa.string())
_TYPES = [pa.string(), pa.string(), pa.map_(pa.string(), _STRINGS), pa.map_(pa.string(), _STRINGS), pa.list_(pa.struct([("meta", pa.string()), ("context", pa.string()), ("text", pa.string())])), _STRINGS, _STRINGS, _STRINGS, pa.string(), pa.list_(pa.struct([("target", pa.string()), ("kind", pa.string())]))]


def analyze(docs: DataFrame, config: Config) -> DataFrame:
    """One row of SCHEMA for each row (uri, content, parser, encoding) of documents.

    `content` is binary or a string. A document that a policy refuses has its
    reason in `error` and no fields; the others are not held up by it. What
    documents include is in `includes`; includes.included() joins it.
    """
    rows = docs.select("uri", "content", "parser", F.col("encoding") if "encoding" in docs.columns else F.lit(None).cast("string").alias("encoding"))
    names = ["uri", "encoding", "properties", "metas", "pieces", "warnings", "new_metas", "new_properties", "error", "includes"]

    def one(uri, content, parser, encoding) -> tuple:
        try:
            got = markup.analyze(content, parser or "", config, uri or "", encoding, from_files=False)
        except markup.MarkupError as e:
            return uri, None, {}, {}, [], [], [], [], str(e), []
        pieces = [{"meta": m, "context": c, "text": t} for m, c, t in got.pieces]
        return uri, got.encoding, got.properties, got.metas, pieces, got.warnings, got.new_metas, got.new_properties, None, [{"target": t, "kind": k} for t, k in got.includes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [one(*row) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)]
                cols = [[list(x.items()) if isinstance(x, dict) else x for x in c] for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def analyze_text(docs: DataFrame, config: Config) -> DataFrame:
    """The same for plain text documents with a string `content`, without Python."""
    piece = lambda meta, value: F.struct(F.lit(meta).alias("meta"), F.lit(meta).alias("context"), value.alias("text"))
    text, uri = F.coalesce("content", F.lit("")), F.coalesce("uri", F.lit(""))
    pieces = F.array(piece(config.default_meta, text), piece(config.title_meta, uri))
    filled = F.filter(pieces, lambda p: F.trim(p["text"]) != "")
    metas = F.map_from_entries(F.transform(filled, lambda p: F.struct(p["meta"], F.array(p["text"]))))
    strings = F.array().cast("array<string>")
    return docs.select(
        "uri", F.lit("UTF-8").alias("encoding"), F.create_map().cast("map<string,array<string>>").alias("properties"), metas.alias("metas"), pieces.alias("pieces"),
        strings.alias("warnings"), strings.alias("new_metas"), strings.alias("new_properties"), F.lit(None).cast("string").alias("error"),
        F.array().cast("array<struct<target:string,kind:string>>").alias("includes"),
    )


def discover(analyzed: DataFrame, config: Config) -> Config:
    """The configuration with all names that `auto` policies met, ids by name.

    Documents are analysed on their own, so what they add is collected once (the
    distinct names, not the documents) and given ids in name order.
    """
    out = config.copy()
    kinds = {"new_metas": (out.metanames, out.add_meta), "new_properties": (out.properties, out.add_property)}

    def pairs(kind: str):
        return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    # both kinds at once, as the documents may be parsed for it
    for r in analyzed.select(F.inline(F.concat(*map(pairs, kinds)))).distinct().orderBy("kind", "name").collect():
        known, add = kinds[r["kind"]]
        if r["name"] not in known:
            add(r["name"])
    return out


def field_values(analyzed: DataFrame, which: str = "properties") -> DataFrame:
    """(uri, name, idx, value): the values of properties or metas, empty ones left out."""
    rows = analyzed.select("uri", F.explode(which).alias("name", "values"))
    rows = rows.select("uri", "name", F.posexplode("values").alias("idx", "value"))
    return rows.where(F.trim(F.col("value")) != "")


def joined_value(values, name: str):
    """All values of one field as one string, joined as they are stored."""
    return F.array_join(F.try_element_at(values, F.lit(name)), "\x03")

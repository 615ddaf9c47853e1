"""Readable lines of what was parsed: documents with their fields and tokens, and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GAP, Config
from .tokens import LETTERS, marked_pieces


def document_lines(analyzed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(uri, at, line): a line for each document, property value, field value and token of it.

    Lines are made in the JVM from the one analysis; names come sorted, values
    and tokens in order. A null value is an empty one.
    """
    def values(kind: str, column: str):
        named = lambda e: F.transform(e["value"], lambda v, i: F.concat_ws(" ", F.lit(kind), e["key"], i.cast("string"), F.replace(F.coalesce(v, F.lit("")), F.lit(GAP), F.lit("|"))))
        return F.flatten(F.transform(F.array_sort(F.map_entries(column)), named))

    tokens = F.transform(marked_pieces("pieces", letters), lambda t, i: F.when(t["term"] != GAP, F.concat_ws(" ", F.lit("token"), (i + 1).cast("string"), t["meta"], t["context"], t["term"], F.octet_length(t["term"]).cast("string"))))
    head = F.array(F.concat_ws(" ", F.lit("document"), "uri", "encoding", "error"))
    warned = F.transform("warnings", lambda w: F.concat_ws(" ", F.lit("warning"), w))
    lines = F.concat(head, warned, values("property", "properties"), values("field", "metas"), F.filter(tokens, lambda t: t.isNotNull()))
    return analyzed.select("uri", F.posexplode(lines).alias("at", "line"))


def config_lines(config: Config) -> list[str]:
    """A line for each entry of a configuration, by kind and name."""
    out = [f"metaname {m.name} id={m.id} bias={m.bias} alias_for={m.alias_for or ''}" for _, m in sorted(config.metanames.items())]
    out += [f"property {p.name} id={p.id} type={p.type} ignore_case={p.ignore_case} verbatim={p.verbatim} max={p.max} sort={p.sort} alias_for={p.alias_for or ''}" for _, p in sorted(config.properties.items())]
    for kind, table in (("tagalias", config.tag_aliases), ("parser", config.parsers), ("mime", config.mimes), ("index", config.index), ("misc", config.misc), ("list", config.stringlists), ("flag", config.flags)):
        out += [f"{kind} {k}={v}" for k, v in sorted(table.items())]
    return out

"""Results: sorting, paging, facets and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE, INT, Config, ConfigError
from ..functions.words import split_words, unescape_c
from .query import Tables

#: Of a page without other bounds.
PAGE = 100
MAX_OUTPUT = 64
_BUILTIN = {"docpath": "uri", "lastmodified": "mtime", "docsize": "size", "mime": "mime", "parser": "parser", "wordnum": "nwords"}


def sort_spec(text: str, config: Config | None = None, compat: bool = False) -> list[tuple[str, bool]]:
    """(property, descending) of a sort string `p1 [asc|desc] p2 ...`; the first is the most significant.

    With compat the last one is.
    """
    out: list[tuple[str, bool]] = []
    for word in split_words(text):
        if word.lower() in ("asc", "desc") and out:
            out[-1] = (out[-1][0], word.lower() == "desc")
            continue
        if config is not None and word.lower() != f"{config.prefix}rank":
            config.property_id(word.lower())
        out.append((word.lower(), False))
    return out[::-1] if compat else out


def value_of(tables: Tables, name: str) -> tuple[DataFrame, Column]:
    """Rows (uri, v) with the first value of a property, typed for sorting."""
    config, short = tables.config, name.removeprefix(tables.config.prefix)
    if name not in config.properties and short in _BUILTIN:
        rows = tables.docs.select("uri", F.col(_BUILTIN[short]).alias("v"))
        return rows, F.col("v")
    prop = config.properties.get(config.property_target(name)) if name in config.properties else None
    if prop is None:
        raise ConfigError(f"no such property: {name}")
    rows = tables.props.where(F.col("name") == prop.name).groupBy("uri").agg(F.min_by("value", "idx").alias("v"))
    v = F.col("v").try_cast("int") if prop.type == INT else F.lower("v") if prop.ignore_case and prop.type != DATE else F.col("v")
    return rows.select("uri", v.alias("v")), F.col("v")


def sorted_hits(tables: Tables, hits: DataFrame, sort: str | None = None, begin: int = 0, max: int = PAGE, compat: bool = False) -> DataFrame:
    """One page of hits. Without a sort string by score, best first; ties by uri.

    Documents without a value come last when ascending and first when descending, as empty strings would.
    """
    keys, rows = [], hits
    spec = sort_spec(sort, tables.config, compat) if sort else [(f"{tables.config.prefix}rank", True)]
    for i, (name, descending) in enumerate(spec):
        if name == f"{tables.config.prefix}rank":
            c = F.col("score")
        else:
            values, _ = value_of(tables, name)
            rows = rows.join(values.select("uri", F.col("v").alias(f"_s{i}")), "uri", "left")
            c = F.col(f"_s{i}")
        keys.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
    page = rows.orderBy(*keys, F.col("uri").asc()).offset(begin).limit(max)
    return page.drop(*(f"_s{i}" for i in range(len(spec))))


def facets(tables: Tables, hits: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n) over all hits, not only a page: each value counts, a document without one under ''."""
    out = None
    for name in names:
        short = name.removeprefix(tables.config.prefix)
        if name not in tables.config.properties and short in _BUILTIN:
            values = tables.docs.select("uri", F.col(_BUILTIN[short]).cast("string").alias("value"))
        else:
            tables.config.property_id(name)
            values = tables.props.where(F.col("name") == tables.config.property_target(name)).select("uri", "value")
        rows = hits.select("uri").join(values, "uri", "left").groupBy(F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(name).alias("facet"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("facet", "value")


def parse_template(text: str) -> list[tuple[str, str]]:
    """('text', literal) and ('value', property) parts of an output template with <property> places and C escapes."""
    out = []
    for m in re.finditer(r"<\s*([^>\s]+)\s*>|((?:\\x[0-9A-Fa-f]+|\\.|[^<\\]|\\$|<(?!\s*[^>\s]+\s*>))+)", text, re.DOTALL):
        out.append(("value", m[1].lower()) if m[1] else ("text", unescape_c(m[2])))
    if sum(k == "value" for k, _ in out) > MAX_OUTPUT:
        raise ConfigError(f"more than {MAX_OUTPUT} properties in a template")
    return out


def default_template(config: Config) -> str:
    p = config.prefix
    return f'<{p}rank> <{p}docpath> "<{p}title>" "<{p}docsize>"\\n'


def rendered(tables: Tables, page: DataFrame, template: str | None = None) -> DataFrame:
    """(uri, line): result lines; hits must have rank where the template asks for it."""
    config = tables.config
    parts, rows = parse_template(template or default_template(config)), page
    names = list(dict.fromkeys(n for k, n in parts if k == "value"))
    source: dict[str, Column] = {}
    for i, name in enumerate(names):
        config.property_id(name)
        short = name.removeprefix(config.prefix)
        if short == "rank" and name.startswith(config.prefix):
            source[name] = F.lpad(F.col("rank").cast("string"), 4, " ")
            continue
        if name in config.properties:
            values = tables.props.where(F.col("name") == config.property_target(name)).groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("vs"))
            value = F.array_join(F.transform("vs", lambda x: x["value"]), "\x03")
        else:
            values = tables.docs
            value = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm:ss z") if short == "lastmodified" else F.col(_BUILTIN[short]).cast("string")
        rows = rows.join(values.select("uri", value.alias(f"_o{i}")), "uri", "left")
        source[name] = F.coalesce(f"_o{i}", F.lit(""))
    columns = [F.lit(v) if k == "text" else source[v] for k, v in parts]
    return rows.select("uri", F.concat(*columns).alias("line"))

"""XInclude where the corpus is a table: documents take in others by joins on their uris.

The parsing stage records what a document includes, as uris resolved against its
own; no task opens a file. Included documents are parsed once for each kind
(markup or plain text), level by level, whatever number of documents include
them. Then the trees of includes are walked from all including documents at
once, a level a round, and what the parts give is put behind each document's own
values and pieces, parents before children, in document order.

A part that no table has, one that includes itself by way of others, and one
below MAX_INCLUDE_DEPTH levels are left out with a warning. A part that a policy
refuses refuses the including document. Of equal uris among the contents the
greatest content counts. Null uris include like any other, but nothing can
include them. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import analyze as A
from .markup import MAX_INCLUDE_DEPTH

#: Copies of each part on the joins by its uri, as one part may be in most of the documents.
SALTS = 8
_LISTS = ("warnings", "new_metas", "new_properties")
_MAPS = ("properties", "metas")


def included(found: DataFrame, contents: DataFrame, config: Config, folder: str, key: str = "uri", lists: tuple[str, ...] = ("pieces",), prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Analysed documents together with what they include from `contents` (uri, content).

    `found` is read several times, so it should be a stored table; `key` names a
    column without repeats. `lists` are its columns of pieces and `prepare` makes
    them from the parsing stage's rows. Levels are written below `folder`, which all
    machines must see; the result reads them.
    """
    spark = found.sparkSession
    own = found.where(F.size("includes") > 0)
    if own.isEmpty():
        return found
    parts = _parts(own, contents, config, f"{folder}/parts", prepare or (lambda df: df))
    copies = parts.withColumnRenamed("target", "_on").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_known", F.lit(True))
    at = own.select(F.col(key).alias("_key"), F.array("uri").alias("_above"), F.array().cast("array<int>").alias("_place"), "includes")
    level = 0
    while True:
        steps = at.select("_key", "_above", "_place", F.posexplode("includes").alias("_at", "_to"))
        steps = steps.select("_key", "_above", F.concat("_place", F.array("_at")).alias("_place"), "_to.target", "_to.kind")
        loop = (F.col("kind") == "X") & F.coalesce(F.array_contains(F.filter("_above", lambda x: x.isNotNull()), F.col("target")), F.lit(False))
        refused = F.when(loop, F.concat(F.lit("includes itself: "), "target")).when(F.lit(level >= MAX_INCLUDE_DEPTH), F.concat(F.lit("included too deeply: "), "target"))
        steps = steps.withColumns({"_refused": refused, "_salt": F.pmod(F.xxhash64("_key", "_place"), F.lit(SALTS)).cast("int")})
        # a part that is refused joins nothing
        steps = steps.withColumn("_on", F.when(F.col("_refused").isNull(), F.col("target")))
        got = steps.join(copies, ["_on", "kind", "_salt"], "left")
        got.write.parquet(f"{folder}/levels/{level}")
        got = spark.read.schema(got.schema).parquet(f"{folder}/levels/{level}")
        at = got.where(F.size("includes") > 0).select("_key", F.concat("_above", F.array("target")).alias("_above"), "_place", "includes")
        level += 1
        if at.isEmpty():
            break
    levels = spark.read.schema(got.schema).parquet(*(f"{folder}/levels/{i}" for i in range(level)))
    return _put_behind(found, levels, key, lists)


def _parts(own: DataFrame, contents: DataFrame, config: Config, folder: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(target, kind, ...): the analysis of each document that is included anywhere below, once for each kind."""
    spark, known, n = own.sparkSession, None, 0
    wanted = own.select(F.explode("includes").alias("i")).select("i.target", "i.kind").distinct()
    while True:
        if known is not None:
            wanted = wanted.join(known.select("target", "kind"), ["target", "kind"], "left_anti")
        rows = contents.select(F.col("uri").alias("target"), "content").join(wanted, "target").groupBy("target", "kind").agg(F.max("content").alias("content"))
        rows = rows.select(F.col("target").alias("uri"), "content", F.col("kind").alias("parser"))
        new = None
        for kind in ("X", "T"):
            some = prepare(A.analyze(rows.where(F.col("parser") == kind), config)).withColumn("kind", F.lit(kind))
            new = some if new is None else new.unionByName(some)
        new.withColumnRenamed("uri", "target").write.parquet(f"{folder}/{n}")
        schema = new.withColumnRenamed("uri", "target").schema
        latest = spark.read.schema(schema).parquet(f"{folder}/{n}")
        known = spark.read.schema(schema).parquet(*(f"{folder}/{i}" for i in range(n + 1)))
        wanted = latest.select(F.explode("includes").alias("i")).select("i.target", "i.kind").distinct()
        n += 1
        if wanted.isEmpty():
            return known


def _put_behind(found: DataFrame, levels: DataFrame, key: str, lists: tuple[str, ...]) -> DataFrame:
    """Documents with the values, pieces and warnings of all their parts behind their own."""
    warning = F.coalesce("_refused", F.when(F.col("_known").isNull(), F.concat(F.lit("cannot include "), "target")))
    warnings = F.when(warning.isNotNull(), F.array(warning)).otherwise(F.col("warnings"))
    part = F.struct("_place", *(F.map_entries(m).alias(m) for m in _MAPS), *lists, warnings.alias("warnings"), *_LISTS[1:], "error")
    more = levels.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    rows = found.join(more, key, "left")

    def behind(name: str) -> Column:
        theirs = F.flatten(F.filter(F.transform("_parts", lambda p: p[name]), lambda x: x.isNotNull()))
        return F.when(F.col("_parts").isNull(), F.col(name)).otherwise(F.concat(name, theirs))

    def merged(name: str) -> Column:
        theirs = F.flatten(F.filter(F.transform("_parts", lambda p: p[name]), lambda x: x.isNotNull()))
        pairs = F.concat(F.map_entries(name), theirs)
        names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
        values = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.flatten(F.transform(F.filter(pairs, lambda e: e["key"] == k), lambda e: e["value"])))))
        return F.when(F.col("_parts").isNull(), F.col(name)).otherwise(values)

    fault = F.try_element_at(F.filter(F.transform("_parts", lambda p: p["error"]), lambda x: x.isNotNull()), F.lit(1))
    new = {name: behind(name) for name in (*lists, *_LISTS)} | {name: merged(name) for name in _MAPS} | {"error": F.coalesce("error", fault)}
    return rows.withColumns(new).select(found.columns)

"""Mixing sources to target weights with a time-varying curriculum, JVM-side only.

Targets fill like water: every source gets its weight's share of the demand,
no source more than `most` times its size, and what is above is shared anew by
weight. A source's documents stand in a fixed pseudo-random order, repeated as
often as its target asks. Each source has a weight schedule over training
time; its integral gives the cumulative demand, whose inverse gives each copy
of a document its training position, and copies are range-sorted by it.

Cumulative sizes within a source come from sums over blocks of its order, so
that a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, staged

WEIGHTS = (3.0, 1.0, 2.0)
DEMAND = 1.5
MOST = 2.0
#: Rows of a source that one window sorts.
BLOCK_ROWS = 4_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, demand: float = DEMAND, most: float = MOST) -> DataFrame:
    """(source, source_size, n_rows, weight, number, target) from rows of (source, source_size, n_rows).

    A source is full below the level at which its share reaches its cap. With
    sources in the order of those levels, sums of caps and weights before each
    give the level of the first one that is not full, which is the level of all.
    There is a row for each source, never one for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("number", F.row_number().over(order) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    named = named.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    named = named.withColumns({
        "all_demand": F.sum("source_size").over(whole) * demand,
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    named = named.withColumn("own_level", (F.col("all_demand") - F.col("caps")) / F.col("left"))
    fill = F.min(F.when(F.col("own_level") <= F.col("level"), F.struct("level", "number", "own_level"))).over(whole)["own_level"]
    named = named.withColumn("fill", fill)
    target = F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap")))
    return named.select("source", "source_size", "n_rows", "weight", "number", target.cast("double").alias("target"))


def inverse_demand(share: Column, early: Column, late: Column) -> Column:
    """The time in [0, 1] at which a weight going linearly from early to late has met this share of its integral."""
    slope = late - early
    area = (early + late) / 2 * share
    root = (F.sqrt(early * early + 2 * slope * area) - early) / slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, demand: float = DEMAND, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, copies, position, positions.

    `taken` counts the words the mix takes, repeats included: whole passes over
    the source, then documents in its order up to the target, the last of them
    in part. `copies` is the same in whole documents, the last one included if
    at least half of it is taken. `positions` has the training time in [0, 1]
    of each copy, one taken in part included; a second pass stands behind the
    first in its source's demand. `position` is that of the first copy, null if
    no word is taken. Even sources go from 0.5 to 1.5 of their mean weight over
    time, odd ones the other way.

    Null texts have size 0 and take nothing; a null source is a source of its
    own, in last place; repeated rows are documents each; an empty table gives
    no rows. The order depends on ids, sources, sizes and, where ids are null or
    repeated, texts, so reruns agree.
    """
    out = _planned(df, id_col, text_col, source_col, weights, demand, most)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _planned(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float] = WEIGHTS, demand: float = DEMAND, most: float = MOST, along: Sequence[Column] = ()) -> DataFrame:
    """The rows of mix() in no order, with the columns that go along."""
    key = F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    named_by = F.coalesce(named(id_col).cast("long").cast("string"), F.md5(text))
    draw = F.conv(F.substring(F.md5(F.concat_ws("/", named_by, named(source_col).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = staged(df.select(*key, word_count(F.col(text_col)).alias("size"), draw.alias("draw"), F.xxhash64(text).alias("tie"), *along), "mix")
    carried = rows.columns[5:]
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    targets = staged(source_targets(sizes, weights, demand, most), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    docs = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    docs = docs.withColumn("block", F.pmod(F.shiftright("draw", 20), blocks).cast("int")).drop("t_source")
    inner = Window.partitionBy("number", "block").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    per_block = docs.groupBy("number", "block").agg(F.sum("size").alias("b_size"))
    outer = Window.partitionBy("number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(F.col("number").alias("b_number"), F.col("block").alias("b_block"), F.coalesce(F.sum("b_size").over(outer), F.lit(0)).alias("b_start"))
    docs = docs.join(per_block, (F.col("number") == F.col("b_number")) & (F.col("block") == F.col("b_block")))
    docs = docs.withColumn("start", F.col("b_start") + F.col("inside")).withColumn("words", F.round("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    rest = F.col("words") - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    docs = docs.withColumns({"passes": passes.cast("long"), "part": part.cast("long")})
    even = F.col("number") % 2 == 0

    def at(n: Column) -> Column:
        share = (n * F.col("source_size") + F.col("start")) / F.col("words")
        return inverse_demand(share, F.when(even, 0.5).otherwise(1.5), F.when(even, 1.5).otherwise(0.5))

    taken = F.col("passes") * F.col("size") + F.col("part")
    copies = F.col("passes") + ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("long")
    times = F.col("passes") + (F.col("part") > 0).cast("long")
    positions = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), at)).otherwise(F.array().cast("array<double>"))
    return docs.select(
        "doc_id", "size", "source", "source_size", "target", taken.alias("taken"), copies.alias("copies"),
        F.when(taken > 0, at(F.lit(0))).alias("position"), positions.alias("positions"), *carried,
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each whole copy the mix takes, range-sorted by training position; all columns stay, whatever their names.

    Documents the mix does not take are left out, those taken twice come twice,
    each copy at its own place. Repeated ids are documents each, null ids too.
    An empty table gives no rows.
    """
    row = F.struct(*(named(c) for c in docs.columns)).alias("row")
    plan = _planned(docs, id_col, text_col, source_col, along=[row]).where("copies > 0")
    copies = plan.select("row", "doc_id", F.explode(F.slice("positions", F.lit(1), F.col("copies").cast("int"))).alias("position"))
    return copies.orderBy("position", "doc_id").select("row.*")

"""Fill-in-the-middle: texts cut at two code points and put in another order.

A text is UTF-8, in which code points take one to four bytes. `with_runs()`
stores its maximal runs of code points of one width (the character's class) as
two arrays: the units and the bytes before each run, and at last those of the
whole text. The place of a cut is then arithmetic: a binary search finds the
run that holds it, and the cut lies as many widths behind the run's start as
units. No text is counted through for a cut, and bytes are sliced, not code points.

Where the cuts are, and in which form a document comes, depends on a digest of
its id alone, so reruns agree and repeated ids are cut by the same numbers. A
null text counts as an empty one, a null id as an empty one. Empty texts and
those that hold a mark stay plain. An empty table gives an empty result. All
columns are carried along; columns with the names of the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Documents of a hundred that are cut, and of a hundred cut ones those whose suffix comes first.
CUT_SHARE, SPM_SHARE = 90, 20

# The bytes of a code point by its first byte; 0 for bytes inside one.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.uint8), [128, 64, 32, 16, 16])


def runs_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Units and bytes before each run of a UTF-8 text, and those of the whole text."""
    widths = _WIDTH[np.frombuffer(data, np.uint8)]
    widths = widths[widths > 0]
    starts = np.flatnonzero(widths[1:] != widths[:-1]) + 1
    units = np.concatenate(([0], starts, [len(widths)])) if len(widths) else np.zeros(1, np.int64)
    sizes = np.diff(units) * widths[units[:-1]]
    return units, np.concatenate(([0], np.cumsum(sizes)))


def offset(units: np.ndarray, sizes: np.ndarray, cut: int) -> int:
    """The bytes before a cut."""
    k = int(np.searchsorted(units, cut, "right")) - 1
    if k + 1 >= len(units):
        return int(sizes[-1])
    width = (sizes[k + 1] - sizes[k]) // (units[k + 1] - units[k])
    return int(sizes[k] + (cut - units[k]) * width)


def _flat(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int32)))


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs") -> DataFrame:
    """All rows and columns, and the runs of their texts: struct(units array<int>, bytes array<int>)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<units: array<int>, bytes: array<int>>")
    def found(texts: pa.Array) -> pa.Array:
        pairs = [runs_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([_flat([u for u, _ in pairs]), _flat([b for _, b in pairs])], names=["units", "bytes"])

    return docs.withColumn(runs, found(named(text)))


def _digits(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All rows and columns, and n, form (plain, psm, spm), prefix_chars, middle_chars and output."""
    small_batches(docs.sparkSession)
    body = F.coalesce(named(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(key).cast("string"), F.lit(""))), 256)
    n = F.char_length(body).cast("long")
    one, two = _digits(digest, 0) % (n + 1), _digits(digest, 1) % (n + 1)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(body, F.lit(m))
    form = F.when((n == 0) | marked | (_digits(digest, 2) % 100 >= cut_share), "plain").when(_digits(digest, 3) % 100 < spm_share, "spm").otherwise("psm")

    @F.arrow_udf("array<string>")
    def parts(texts: pa.Array, runs: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out, columns = [], (texts.cast(pa.binary()), runs.field("units"), runs.field("bytes"), firsts, lasts)
        for data, units, sizes, first, last in zip(*columns, strict=True):
            if not first.is_valid:
                out.append(None)
                continue
            data, units, sizes = data.as_py(), units.values.to_numpy(), sizes.values.to_numpy()
            a, b = (offset(units, sizes, x.as_py()) for x in (first, last))
            out.append([data[:a].decode(), data[a:b].decode(), data[b:].decode()])
        return pa.array(out, pa.list_(pa.string()))

    plain = F.col("c.form") == "plain"
    rows = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("doc"), F.struct(n.alias("n"), form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("last")).alias("c"))
    rows = rows.withColumn("text", F.coalesce(F.col("doc").getField(text), F.lit("")))
    rows = with_runs(rows.withColumns({"first": F.when(~plain, F.col("c.first")), "last": F.when(~plain, F.col("c.last"))}))
    rows = rows.withColumn("p", parts("text", "runs", "first", "last"))
    prefix, middle, suffix = (F.get("p", F.lit(i)) for i in range(3))
    to_p, to_s, to_m = (F.lit(m) for m in marks)
    output = (
        F.when(plain, F.col("text"))
        .when(F.col("c.form") == "psm", F.concat(to_p, prefix, to_s, suffix, to_m, middle))
        .otherwise(F.concat(to_s, suffix, to_p, prefix, to_m, middle))
    )
    new = {"n": F.col("c.n"), "form": F.col("c.form"), "prefix_chars": F.col("first"), "middle_chars": F.col("last") - F.col("first"), "output": output}
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new), *(c.alias(name) for name, c in new.items()))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; marks are found from the left, as a cut text holds none."""
    second, last = F.when(form == "psm", marks[1]).otherwise(marks[0]), marks[2]
    lead = F.when(form == "psm", len(marks[0])).otherwise(len(marks[1]))
    width = F.when(form == "psm", len(marks[1])).otherwise(len(marks[0]))
    at, end = F.call_function("instr", output, second), F.call_function("instr", output, F.lit(last))
    one = output.substr(lead + 1, at - 1 - lead)
    two = output.substr(at + width, end - at - width)
    three = F.substring(output, end + len(last), F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))

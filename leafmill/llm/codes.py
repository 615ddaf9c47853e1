"""Product codes of vectors, trained and assigned by partial-distance search.

Components become integers, so all distances are exact and results do not
depend on the order in which rows are added up. A vector is cut into PARTS
consecutive parts of equal length; each part position has a codebook of ENTRIES
entries. A pass over the staged vectors assigns all parts and adds up, in each
task, the parts of each entry; the next codebooks come from those sums, which
are bounded by parts x entries x length and are all that goes to the driver.

Assignment takes the entries in turn and, for all vectors of a batch at once,
adds up squared differences one dimension after another, those in which the
codebook's entries vary most first. A mask drops a vector from an entry as soon
as its sum is strictly greater than the best whole distance found for it; an
equal one goes on, and ties go to the lower index.

Vectors that are null, or hold a null or a component that is not finite, are
left out. A vector whose length does not divide by PARTS, or that is shorter
than others, counts as filled up with zeros. Components are held within 2^27 in
size (32,768 before scaling), so that sums of squares fit. With fewer vectors
than ENTRIES the codebooks have as many entries as there are vectors. Rows with
equal ids are ordered by their components, null ids come last; repeated rows
give a row each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, named, staged

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are multiplied by it before they are cut to integers.
SCALE = 4096
BOUND = 1 << 27
#: A label with more than one in so many rows is joined by a broadcast; there are fewer such labels than that.
HOT_SHARE = 1000


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector is left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.transform(embedding, lambda x: F.floor(F.greatest(F.lit(-BOUND / SCALE), F.least(F.lit(BOUND / SCALE), x.cast("double"))) * SCALE).cast("int"))
    return F.when(F.forall(embedding, fine), whole)


class Codebooks:
    """entries[part][entry][dimension], and the order in which dimensions are looked at."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = entries.shape[1]
        # k^2 times the variance, in whole numbers
        spread = [[k * sum(int(x) ** 2 for x in dim) - sum(map(int, dim)) ** 2 for dim in part.T] for part in entries]
        self.order = [sorted(range(len(s)), key=lambda d, s=s: (-s[d], d)) for s in spread]

    def nearest(self, part: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the rows of vectors: their parts at one position."""
        dims = [np.ascontiguousarray(vectors[:, d]) for d in range(vectors.shape[1])]
        best, code = None, np.zeros(len(vectors), np.int64)
        for e, entry in enumerate(self.entries[part]):
            rows, total = None, np.zeros(len(vectors), np.int64)
            for d in self.order[part]:
                step = (dims[d] if rows is None else dims[d][rows]) - entry[d]
                total += step * step
                if best is None:
                    continue
                alive = total <= (best if rows is None else best[rows])
                if not alive.all():
                    rows = np.flatnonzero(alive) if rows is None else rows[alive]
                    total = total[alive]
                    if not len(rows):
                        break
            if best is None:
                best = total
            elif rows is None:
                closer = total < best
                code[closer], best = e, np.minimum(best, total)
            else:
                closer = total < best[rows]
                code[rows[closer]], best[rows[closer]] = e, total[closer]
        return code, best

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances by (row, part)."""
        parts, _, width = self.entries.shape
        found = [self.nearest(p, vectors[:, p * width : (p + 1) * width]) for p in range(parts)]
        return np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)

    def moved(self, counts: dict[tuple[int, int], int], sums: dict[tuple[int, int, int], int]) -> Codebooks:
        """Each entry replaced by the mean of its parts, all floors downwards; unused entries stay."""
        out = self.entries.copy()
        for (p, e), n in counts.items():
            out[p, e] = [sums[p, e, d] // n for d in range(out.shape[2])]
        return Codebooks(out)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def _sums(vectors: DataFrame, books: Codebooks) -> tuple[dict, dict]:
    """How many parts each entry got, and their sums by dimension."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            codes, _ = books.assign(x)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    # sums of 64-bit sums are decimals, which do not overflow
    rows = map_batches(vectors.select("ints"), run, "part int, entry int, n long, total array<long>")
    rows = rows.select("part", "entry", "n", F.posexplode("total").alias("d", "t"))
    rows = rows.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()
    return {(r["part"], r["entry"]): r["n"] for r in rows}, {(r["part"], r["entry"], r["d"]): int(r["t"]) for r in rows}


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, ints) of the vectors that count, all of one length; staged."""
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), integers(named(vector_col)).alias("ints")).where("ints IS NOT NULL")
    length = rows.agg(F.max(F.size("ints")).alias("n")).first()["n"] or 0
    length = max(1, -(-length // PARTS)) * PARTS
    fill = F.array_repeat(F.lit(0), F.lit(length) - F.size("ints"))
    return staged(rows.withColumn("ints", F.concat("ints", fill)), "vectors")


def codebooks(prepared: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after so many rounds; none for an empty table."""
    first = prepared.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(ENTRIES).collect()
    if not first:
        return None
    start = np.array([r["ints"] for r in first], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = books.moved(*_sums(prepared, books))
    return books


def coded(prepared: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code binary, error): one byte for each part, and the squared distance to what the code stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = books.assign(_matrix(batch.column(2)))
                packed = [row.tobytes() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(errors.sum(1))], names=["vec_id", "label", "code", "error"])

    return map_batches(prepared.select("vec_id", "label", "ints"), run, f"vec_id long, label {prepared.schema['label'].dataType.simpleString()}, code binary, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add label_error: the errors of all rows with the same label, nulls together; null beyond 64 bits.

    Labels with more than one in HOT_SHARE rows are fewer than HOT_SHARE and are
    broadcast, so no task gets all rows of one; the rest are joined by label.
    """
    totals = staged(rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")), "labels")
    count = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.where(F.col("n") * HOT_SHARE > count).select(F.col("label").alias("of"), "label_error", F.lit(True).alias("hot"))
    out = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    cold = totals.where(F.col("n") * HOT_SHARE <= count).select(F.col("label").alias("of"), F.col("label_error").alias("own"))
    rest = out.where("hot IS NULL").join(cold, F.col("label").eqNullSafe(F.col("of"))).select(*rows.columns, F.col("own").alias("label_error"))
    return out.where("hot").select(*rows.columns, "label_error").unionByName(rest)


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of all vectors that count."""
    prepared = _prepared(vectors, id_col, vector_col, label_col)
    books = codebooks(prepared)
    if books is None:
        return prepared.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = staged(coded(prepared, books), "codes")
    return with_label_error(rows).withColumn("codebooks_sha256", F.lit(books.digest()))

"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of words with their boundaries: for every
order a sorted array of n-gram hashes with discounted probabilities, and one of
context hashes with the weight of the next lower order. A text's cross-entropy
under a model is the mean over its characters; the language with the lowest
one wins. Rejection is calibrated on sampled documents that the models have not
seen.

Models of all languages are fitted on a bounded sample: distinct texts chosen by
a hash of themselves, so that null, repeated and missing ids do not matter,
about TRAIN_DOCS for each language, fewer where there are so many languages that
all would have more than TRAIN_CHARS characters, but about LEAST_DOCS in any
case. Of a sampled text TRAIN_TEXT characters count, so what goes to the driver
is bounded by the number of languages. Every document is scored, by all of its
words. Words repeat, so each worker scores a distinct word once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, staged

#: The sample's documents for each language, about; a fifth of them calibrates.
TRAIN_DOCS = 400
#: Characters of the whole sample, about, and documents that each language has whatever they are, about.
TRAIN_CHARS, LEAST_DOCS = 1 << 26, 20
#: Characters of a sampled text that are learned from.
TRAIN_TEXT = 1 << 14
#: Characters of the longest n-gram.
ORDER = 4
#: Words kept by a worker.
CACHE_WORDS = 300_000
#: Words scored at a time, and with many languages the numbers of a block.
BLOCK_WORDS, BLOCK_CELLS = 20_000, 1 << 20
#: Bits above the worst of REJECT_QUANTILE of the calibration documents that are still accepted.
REJECT_QUANTILE, SLACK_BITS, SHORT_BITS = 0.995, 0.75, 12.0
UND = "und"

_MULT = np.uint64(0x9E3779B97F4A7C15)


# letters and numbers that are no decimal digits
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters (general category L), in lower case."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two edges, and the index of the word of each; ORDER - 1 edges lead."""
    text = "".join(" " * (ORDER - 1) + w + " " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + ORDER for w in words])
    return codes, owner


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """At each place the hash of the `order` code points that end there."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[back:] = codes[: len(codes) - back] if back else codes
        h = (h ^ (shifted + np.uint64(1))) * _MULT
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """One language: by order, sorted n-gram hashes with their share, and context hashes with the weight of what is shorter."""

    lang: str
    grams: list[np.ndarray] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    lower: list[np.ndarray] = field(default_factory=list)
    base: float = 1e-5
    limit: float = math.inf


def fit(lang: str, word_counts: Counter) -> Model:
    """The interpolated Kneser-Ney model of counted words."""
    words = sorted(word_counts)
    codes, owner = _codes(words)
    weight = np.array([word_counts[w] for w in words], np.float64)[owner]
    # places to predict: all but the leading edges
    lead = np.ones(len(codes), bool)
    at = np.r_[0, np.flatnonzero(np.diff(owner)) + 1] if len(codes) else np.array([], int)
    for i in range(ORDER - 1):
        lead[at + i] = False
    hashes = [np.zeros(0, np.uint64)] + [_hashes(codes, n) for n in range(1, ORDER + 2)]
    model = Model(lang)
    for n in range(1, ORDER + 1):
        gram = hashes[n][lead]
        context = np.zeros(len(codes), np.uint64)
        if n > 1:
            context[1:] = hashes[n - 1][:-1]
        context = context[lead]
        if n == ORDER:
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight[lead], len(keys))
        else:
            # continuation counts: distinct code points before the n-gram
            longer, one = np.unique(hashes[n + 1][lead], return_index=True)
            keys, first, inverse = np.unique(gram[one], return_index=True, return_inverse=True)
            count = np.bincount(inverse, minlength=len(keys)).astype(np.float64)
            first = one[first]
        ctx, inverse = np.unique(context[first], return_inverse=True)
        total = np.bincount(inverse, count, len(ctx))
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5
        followers = np.bincount(inverse, minlength=len(ctx))
        model.grams.append(keys)
        model.share.append(np.maximum(count - discount, 0) / total[inverse])
        model.contexts.append(ctx)
        model.lower.append(discount * followers / total)
    return model


class Scorer:
    """Cross-entropies of texts under all models. Scores of words are kept; new words of many texts are scored at once."""

    def __init__(self, models: list[Model]):
        self.models = models
        n = max(1, len(models))
        self.most = max(10_000, min(CACHE_WORDS, (1 << 24) // n))
        self.block = max(200, min(BLOCK_WORDS, BLOCK_CELLS // n))
        self.index: dict[str, int] = {}
        self.table, self.sizes = np.zeros((0, n)), np.zeros(0)
        # one sorted array for all languages: an n-gram is looked up once
        self.grams = [_joint([m.grams[k] for m in models], [m.share[k] for m in models]) for k in range(ORDER)]
        self.contexts = [_joint([m.contexts[k] for m in models], [m.lower[k] for m in models]) for k in range(ORDER)]
        self.base = np.array([m.base for m in models])
        self.first = np.array([m.lower[0][0] if len(m.lower[0]) else 1.0 for m in models])

    def _scores(self, words: list[str]) -> np.ndarray:
        """Sums of log2 probabilities of words, by word and model."""
        out = []
        for i in range(0, len(words), self.block):
            block = words[i : i + self.block]
            codes, owner = _codes(block)
            hashes = [np.zeros(0, np.uint64)] + [_hashes(codes, n) for n in range(1, ORDER + 1)]
            at = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            lead = np.ones(len(codes), bool)
            for j in range(ORDER - 1):
                lead[at + j] = False
            lead = np.flatnonzero(lead)
            p = np.broadcast_to(self.base, (len(lead), len(self.models)))
            for n in range(1, ORDER + 1):
                alpha = _rows(self.grams[n - 1], hashes[n][lead], len(self.models), 0.0)
                gamma = self.first if n == 1 else _rows(self.contexts[n - 1], hashes[n - 1][lead - 1], len(self.models), 1.0)
                p = alpha + gamma * p
            ends = np.searchsorted(owner[lead], np.arange(len(block)))
            out.append(np.add.reduceat(np.log2(p), ends, axis=0))
        return np.concatenate(out)

    def _learn(self, words: list[str]) -> None:
        n = len(self.index)
        if n + len(words) > len(self.table):
            room = max(2 * len(self.table), n + len(words), 4096)
            self.table, self.sizes = np.resize(self.table, (room, self.table.shape[1])), np.resize(self.sizes, room)
        self.table[n : n + len(words)] = self._scores(words)
        self.sizes[n : n + len(words)] = [len(w) + 1 for w in words]
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def entropies(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For each text, bits a character under each model and the characters counted."""
        held: list[Counter] = []
        new: dict[str, None] = {}

        def flush() -> Iterator[tuple[np.ndarray, int]]:
            words = list(new)
            if len(self.index) + len(words) > self.most:
                self.index.clear()
                words = list(dict.fromkeys(w for c in held for w in c))
            if words:
                self._learn(words)
            for c in held:
                at = np.fromiter(map(self.index.__getitem__, c), np.intp, len(c))
                times = np.fromiter(c.values(), np.float64, len(c))
                n = int(times @ self.sizes[at])
                yield (-(times @ self.table[at]) / n if n else np.zeros(len(self.models))), n
            held.clear()
            new.clear()

        for text in texts:
            c = Counter(words_of(text)) if text else Counter()
            fresh = [w for w in c if w not in self.index and w not in new]
            if held and len(new) + len(fresh) > self.block:
                yield from flush()
                fresh = [w for w in c if w not in self.index]
            if len(c) > self.most // 2:  # a text with more words than are kept is scored by itself
                yield from flush()
                words, times = list(c), np.fromiter(c.values(), np.float64, len(c))
                n = int(times @ np.array([len(w) + 1 for w in words]))
                bits = sum(times[i : i + self.block] @ self._scores(words[i : i + self.block]) for i in range(0, len(words), self.block))
                yield -bits / n, n
                continue
            held.append(c)
            new.update(dict.fromkeys(fresh))
        yield from flush()

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None, bool]]:
        """For each text (language, score, bits a character, rejected); the score is the language's share if all are as likely before."""
        if not self.models:
            yield from ((UND, 0.0, None, not (t and words_of(t))) for t in texts)
            return
        for bits, n in self.entropies(texts):
            if not n:
                yield UND, 0.0, None, True
                continue
            best = int(bits.argmin())
            gap = np.exp2(-(bits - bits[best]) * n)
            over = bits[best] - SHORT_BITS / math.sqrt(n) > self.models[best].limit
            yield self.models[best].lang, float(1 / gap.sum()), float(bits[best]), bool(over)


def _joint(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted keys of all languages, where each one's entries begin, and the entries: a language and its value, by key.

    The size is that of the models together, however many languages there are.
    """
    every = np.concatenate([np.zeros(0, np.uint64), *keys])
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    order = np.argsort(every, kind="stable")
    found, starts = np.unique(every[order], return_index=True)
    return found, np.append(starts, len(every)), owner[order], np.concatenate([np.zeros(0), *values])[order]


def _rows(table: tuple[np.ndarray, ...], wanted: np.ndarray, n: int, missing: float) -> np.ndarray:
    """The values of all n languages for each wanted key."""
    keys, starts, owner, values = table
    out = np.full((len(wanted), n), missing)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = np.flatnonzero(keys[at] == wanted)
        first, size = starts[at[there]], np.diff(starts)[at[there]]
        place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[np.repeat(there, size), owner[place]] = values[place]
    return out


def calibrate(models: list[Model], held: list[tuple[str, str]]) -> None:
    """Set each model's limit of bits a character from documents it was not fitted on."""
    scorer = Scorer(models)
    seen: dict[str, list[float]] = {}
    for (lang, _), (bits, n) in zip(held, scorer.entropies(t for _, t in held), strict=True):
        if n:
            k = [m.lang for m in models].index(lang)
            seen.setdefault(lang, []).append(float(bits[k]) - SHORT_BITS / math.sqrt(n))
    every = [x for xs in seen.values() for x in xs]
    for m in models:
        xs = seen.get(m.lang) or every
        m.limit = float(np.quantile(xs, REJECT_QUANTILE)) + SLACK_BITS if xs else math.inf


def training_sample(df: DataFrame, train: Column, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Rows (lang, text, held) of distinct texts of each language, by a hash of the text; independent of ids and row order.

    The share kept of a language comes from its count, so its size is bounded
    however many rows there are, and no language's rows meet in one task. Copies
    of a text are one row; they are merged where they are read.
    """
    rows = df.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.xxhash64("text", F.lit("langid")).alias("hash"), F.left("text", F.lit(TRAIN_TEXT)).alias("text"))
    distinct = rows.groupBy("lang", "hash").agg(F.max(F.length("text")).alias("size"))
    counts = staged(distinct.groupBy("lang").agg(F.count("*").alias("n"), F.avg("size").alias("mean")), "langid")
    share = chars / max(1, counts.count())
    size = F.least(F.col("n"), F.greatest(F.lit(float(LEAST_DOCS)), F.least(F.lit(float(docs)), F.lit(share) / F.greatest("mean", F.lit(1.0)))))
    sizes = counts.select(F.col("lang").alias("of"), "n", size.alias("size"))
    draw = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("draw", draw).join(sizes, F.col("lang") == F.col("of")).where(F.col("draw") * F.col("n") < F.col("size"))
    picked = picked.select("lang", "hash", "text", (F.col("draw") * F.col("n") >= 0.8 * F.col("size")).alias("held"))
    return picked.dropDuplicates(["lang", "hash"]).select("lang", "text", "held")


def train(df: DataFrame, train_rows: Column, docs: int = TRAIN_DOCS) -> list[Model]:
    """Models of all languages among the training rows, by code point of their names."""
    sample = training_sample(df, train_rows, docs).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["text"])):
        by_lang.setdefault(r["lang"], []).append(r)
    models, held = [], []
    for lang, rows in by_lang.items():
        fitted = [r for r in rows if not r["held"]] or rows
        counts = Counter(w for r in fitted for w in words_of(r["text"]))
        if counts:
            models.append(fit(lang, counts))
            held += [(lang, r["text"]) for r in rows if r["held"]]
    if models:
        calibrate(models, held)
    return models


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits, rejected.

    lang_pred is a language met in training, or `und` for a null text, one
    without a letter, and where nothing could be learned. Rejected are texts
    without a letter and those whose cross-entropy lies above the calibrated
    limit; where nothing could be learned, no other text is. Repeated rows give
    a row each; rows with a null id may be learned from.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    models = train(rows, ~held_out(F.col("doc_id")), docs)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = list(scorer.predict(batch.column(1).to_pylist()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))],
                names=["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"],
            )

    plain = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(plain, run, "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not rejected; all columns stay, whatever their names.

    Where nothing can be learned, all documents with a letter stay. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    models = train(rows, ~held_out(F.col("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([not p[3] for p in scorer.predict(texts.tolist())], dtype=bool)

    return docs.where(accepted(F.col(text_col)))

"""The pipeline against a plain version of each stage."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import langid, packing, secrets
from tests.llm.test_ops import encode, language_docs, plain_components, plain_simhash, plain_targets  # noqa: F401


def make_docs():
    rng = random.Random(11)
    out = []
    for i, (_, text, lang, _) in enumerate(language_docs(150)):
        if text and i % 10 == 0:
            text += " password=hunter2hunter2 end"
        out.append((i, text, lang, f"src{rng.randrange(4)}" if i % 7 else None, len(text or "")))
    for i in range(30):
        out.append((500 + i, out[i][1], out[i][2], "copy", out[i][4]))
    return out


def test_stages(spark, tmp_path, encode):  # noqa: F811
    data, schema = make_docs(), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        seen.append([r.asDict() for r in docs.collect()])
    language, unique, clean, mixed, packed = seen

    # a document stays if its entropy under plain models is within the limit
    models = langid.train(spark.createDataFrame(data, schema), ~langid.held_out(F.col("doc_id")))
    scorer = langid.Scorer(models)
    stay = [d for d, p in zip(data, scorer.predict([d[1] for d in data]), strict=True) if not p[3]]
    assert sorted(r["doc_id"] for r in language) == sorted(d[0] for d in stay) and 140 < len(stay) < len(data)
    assert all(d[1] and any(c.isalpha() for c in d[1]) for d in stay)

    # one of each component of fingerprints, compared all with all
    pairs = [(d[0], plain_simhash(d[1])) for d in stay]
    assert sorted(r["doc_id"] for r in unique) == sorted(set(plain_components(pairs)))

    by_id = {d[0]: d for d in data}
    for r in clean:
        text = by_id[r["doc_id"]][1]
        want = secrets.redact(text, secrets.find_spans(text))
        assert r["text"] == want and r["n_chars"] == len(want) and "hunter2" not in want
    assert len(clean) == len(unique)

    # whole copies, so that each source has its target to half a document
    words = {r["doc_id"]: len(r["text"].split()) for r in clean}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r["source"]] += words[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], words[r["doc_id"]])
    copies = Counter(r["doc_id"] for r in mixed)
    for r in mixed:
        taken[r["source"]] += words[r["doc_id"]]
    assert set(copies.values()) <= {1, 2}
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1

    # every id of every copy in one piece, sequences without gaps
    texts = {r["doc_id"]: r["text"] for r in clean}
    total = sum(len(encode(texts[k]) + [packing.END_ID]) * n for k, n in copies.items())
    assert sum(r["length"] for r in packed) == total
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == copies
    one = next(r for r in packed if r["start"] == 0)
    ids = b"".join(x.to_bytes(4, "little") for x in [*encode(texts[one["doc_id"]]), packing.END_ID])
    assert zlib.crc32(ids[: 4 * one["length"]]) == one["ids_crc32"]


def test_run(spark, tmp_path):
    spark.createDataFrame(make_docs(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns

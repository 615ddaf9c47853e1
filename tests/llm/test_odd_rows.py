"""Null and repeated ids, letters that are none, malformed tool calls, and tables that the pipeline must take."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import chat, langid, mixing

from .test_ops import language_docs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("doc_id", [None, 7, 8, 9])
def test_language_is_learned_whatever_ids_are(spark, doc_id):
    data = [(doc_id, t, lang or truth, truth) for _, t, lang, truth in language_docs(300) if t and truth]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, truth string")
    if df.select(langid.held_out(F.col("doc_id"))).first()[0]:
        return  # nothing may be learned from this id
    got = langid.identify(df).groupBy("lang_pred").count().collect()
    want = {r[0]: r[1] for r in df.where("text rlike '[a-zß-ÿ]'").groupBy("truth").count().collect()}
    assert sum(abs(r[1] - want.get(r[0], 0)) for r in got) <= 0.04 * len(data)
    assert langid.keep_identified(df).count() > 0.9 * len(data)


def test_a_hot_text_is_sampled_once(spark):
    df = spark.createDataFrame([(i, "the same text", "en") for i in range(3000)] + [(5000 + i, f"text number {'ab' * (i % 9)} {i}", "en") for i in range(300)], "doc_id long, text string, lang string")
    sample = langid.training_sample(df, F.lit(True)).collect()
    assert len({r["text"] for r in sample}) == len(sample) == 301
    long = spark.createDataFrame([(1, "word " * 200_000, "en")], "doc_id long, text string, lang string")
    assert len(langid.training_sample(long, F.lit(True)).first()["text"]) == langid.TRAIN_TEXT


def test_letters(spark):
    assert langid.words_of("½² ①Ⅷ 12 _x_ aⅧb c½d É") == ["x", "a", "b", "c", "d", "é"]
    data = [(d[0], d[1], d[2]) for d in language_docs()] + [(9000, "½ ② ³ 12 Ⅷ", "en")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got[9000]["lang_pred"] == "und" and got[9000]["rejected"]


def test_tables_of_many_languages_are_sparse():
    """The joint tables hold each language's own entries, and give the same scores as one model after the other."""
    rng = np.random.default_rng(1)
    alphabet = [chr(0x400 + i) for i in range(200)]
    models = []
    for i in range(500):
        own = "".join(rng.choice(alphabet, 12))
        models.append(langid.fit(f"l{i}", langid.Counter("".join(rng.choice(list(own), 5)) for _ in range(120))))
    scorer = langid.Scorer(models)
    entries = sum(len(m.grams[3]) for m in models)
    assert len(scorer.grams[3][2]) == len(scorer.grams[3][3]) == entries
    assert sum(x.nbytes for t in scorer.grams + scorer.contexts for x in t) < 60 * sum(len(g) for m in models for g in m.grams + m.contexts)
    words = ["".join(rng.choice(alphabet, 4)) for _ in range(30)] + ["abc"]
    together = scorer._scores(words)
    for i in (0, 99, 499):
        assert np.allclose(together[:, i], langid.Scorer([models[i]])._scores(words)[:, 0])


# ---- tool calls

CALLS = [
    {"tool_call": {"id": "a", "name": 7, "arguments": {}}},
    {"tool_call": {"id": "b", "name": {}, "arguments": {"prompt": "x", "turn": 1}}},
    {"tool_call": {"id": None, "name": "reply", "arguments": {"prompt": "x", "turn": 1}}},
    {"tool_result": {"id": None, "content": "x"}},
    {"tool_call": {"name": "reply", "arguments": "no json"}},
    {"tool_call": {"id": True, "name": "reply", "arguments": {"prompt": "x", "turn": 10**400}}},
    {"tool_call": {"id": 5, "name": "reply", "arguments": {"prompt": "x", "turn": 1.5}}},
    {"tool_result": {"id": "5", "content": [1, 2.0, 1e300]}},
    {"tool_calls": 7}, {"tool_call": [1]}, {"tool_result": "x"}, {"tool_call": None},
]


def test_malformed_calls(spark):
    deep = "[" * 5000 + "]" * 5000
    texts = [json.dumps(c) for c in CALLS] + [
        '{"tool_call": {"id": "\\ud800", "name": "\\udfff", "arguments": {"prompt": "\\ud800", "turn": 1, "context": "$result:5"}}}',
        '{"tool_result": {"id": "\\ud800", "content": "\\udc00"}}', '{"tool_call": {"id": "d", "name": "reply", "arguments": %s}}' % deep,
        '{"tool_call": {"id": "d", "name": "reply", "arguments": %s}}' % ("[" * 300 + "]" * 300), '{"tool_call": {"id": "n", "arguments": NaN}}', "{", None,
    ]
    df = spark.createDataFrame([(1, i, "tool", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = {r["turn"]: r for r in chat.link(chat.parse_messages(df)).collect()}
    assert len(out) == len(texts) and all(json.loads(r["json"]) is not None for r in out.values())
    kinds = [out[i]["kind"] for i in range(len(texts))]
    assert kinds == ["call"] * 3 + ["result", "call", "call", "call", "result"] + ["message"] * 4 + ["call", "result"] + ["message"] * 5
    assert out[0]["faults"] == ["$: no schema None"] and out[1]["faults"] == ["$: no schema None"]
    assert out[2]["status"] == out[4]["status"] == "open" and out[3]["status"] == "orphan" and out[2]["call_id"] is None and out[5]["call_id"] is None
    assert out[5]["faults"] == [] and out[6]["faults"] == ["$.turn: not integer"] and (out[6]["status"], out[7]["status"]) == ("linked", "linked")
    assert out[4]["faults"] == ["$: not object"]
    assert out[12]["status"] == out[13]["status"] == "linked" and "\\ud800" in out[12]["json"] and out[12]["call_id"] == "\\ud800"


# ---- mixing and the pipeline

def test_mix_of_repeated_ids_agrees_over_partitions(spark):
    rows = [(3 if i % 2 else None, f"word{i} " * 10, "a", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd ``name` long")
    got = [sorted(r["text"] for r in mixing.apply_mix(df.repartition(n)).collect()) for n in (1, 3)]
    assert got[0] == got[1] and mixing.apply_mix(df).columns == df.columns
    many = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    assert mixing._planned(many, "doc_id", "text", "source").select("position").distinct().count() > 8000


def pipeline(spark, path, df):
    df.write.parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_pipeline_of_odd_tables(spark, tmp_path):
    assert pipeline(spark, tmp_path / "empty", spark.createDataFrame([], DOCS)) == []
    assert pipeline(spark, tmp_path / "nulls", spark.createDataFrame([(None,) * 5] * 4, DOCS)) == []
    data = [(None, t, lang or truth, truth, 1) for _, t, lang, truth in language_docs(200) if t and truth]
    for name, doc_id in (("none", None), ("one", 7)):
        df = spark.createDataFrame(data, DOCS).withColumn("doc_id", F.lit(doc_id).cast("long"))
        packed = pipeline(spark, tmp_path / name, df)
        assert sum(r["start"] == 0 for r in packed) > 0.8 * len(data)
    # no language is given: nothing can be learned, and documents stay
    blind = spark.createDataFrame(data, DOCS).withColumn("lang", F.lit(None).cast("string"))
    assert sum(r["start"] == 0 for r in pipeline(spark, tmp_path / "blind", blind)) > 0.8 * len(data)
    extra = {c: F.lit(1) for c in ("row", "id", "none", "digest", "n", "position", "copies", "ids", "sequence_id", "tie", "draw", "text_", "a `b`")}
    assert sum(r["start"] == 0 for r in pipeline(spark, tmp_path / "clash", spark.createDataFrame(data, DOCS).withColumns(extra))) > 0.8 * len(data)

"""The queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, fim, gif, langid, mixing, packing, secrets, simhash, sketch, sst, suffix
from .common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint(documents(spark, sf_dir))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = chat.link(chat.turns_as_calls(turns)).withColumn("faults", F.array_join("faults", "; "))
    return out.select("conv_id", "turn", "part", "kind", "call_id", "status", "place", "level", "faults", "json")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    millionths = F.transform("positions", lambda x: F.round(x * 1e6).cast("long"))
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position"), F.array_join(millionths, ",").alias("positions"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_table(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    text = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


#: The same as op4_chat: user turns call, the next turn answers if it is the assistant's, calls refer to the result before them.
OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN CAST(turn AS VARCHAR) WHEN 'assistant' THEN CAST(turn - 1 AS VARCHAR) END AS call_id
  FROM conversations),
j AS (
  SELECT t.*, o.role AS other,
    CASE WHEN kind = 'message' THEN 'message'
         WHEN kind = 'call' THEN CASE WHEN o.role IS NULL THEN 'open' ELSE 'linked' END
         ELSE CASE WHEN o.role IS NULL THEN 'orphan' ELSE 'linked' END END AS status,
    lag(t.role) OVER (PARTITION BY conv_id ORDER BY turn) AS was, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn - 1 AS next
  FROM t LEFT JOIN (SELECT DISTINCT conv_id AS c, turn AS n, role FROM t) o
    ON o.c = t.conv_id AND ((t.role = 'user' AND o.role = 'assistant' AND o.n = t.turn + 1)
                         OR (t.role = 'assistant' AND o.role = 'user' AND o.n = t.turn - 1))),
d AS (SELECT *, coalesce(next AND (role = 'assistant' AND was = 'user' OR role = 'user' AND was = 'assistant' AND turn >= 2), false) AS depends FROM j),
g AS (SELECT *, sum(CASE WHEN depends THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM d)
SELECT conv_id, turn, CAST(0 AS INTEGER) AS part, kind, call_id, status, turn AS place,
  CAST(row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1 AS INTEGER) AS level,
  CASE WHEN kind = 'call' THEN concat_ws('; ', CASE WHEN length(text) < 1 THEN '$.prompt: too short' END, CASE WHEN length(text) > 1000 THEN '$.prompt: too long' END,
    CASE WHEN turn >= 2 AND NOT depends THEN '$result:' || (turn - 2) || ': no result' END) ELSE '' END AS faults,
  CASE kind
    WHEN 'call' THEN '{"role":"user","tool_call":{"arguments":{' || CASE WHEN turn >= 2 THEN '"context":"$result:' || (turn - 2) || '",' ELSE '' END
      || '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply"}}'
    WHEN 'result' THEN '{"role":"assistant","tool_result":{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || call_id || '"}}'
    ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS json
FROM g
"""


#: The same as op6_mixing, with one window for each source where the operator adds up blocks.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS named_by FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
w AS (SELECT *, CAST(CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM n),
l AS (SELECT *, cap / weight AS level FROM w),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER (ORDER BY level, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own FROM l),
t AS (SELECT *, least(cap, coalesce((SELECT own FROM f WHERE own <= level ORDER BY level, number LIMIT 1) * weight, cap)) AS target FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.n_rows, t.number, t.target, CAST(round(t.target) AS BIGINT) AS words,
  CAST('0x' || substr(md5(concat_ws('/', d.named_by, d.source)), 1, 15) AS BIGINT) AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, (draw >> 20) % CAST(ceil(n_rows / {mixing.BLOCK_ROWS}.0) AS BIGINT) AS block FROM x),
c AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY number ORDER BY block, draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM b),
g AS (SELECT *, greatest(0, least(size, words - passes * source_size - start)) AS part, CAST(start AS DOUBLE) / words AS share,
  CASE WHEN number % 2 = 0 THEN 0.5 ELSE 1.5 END AS early, CASE WHEN number % 2 = 0 THEN 1.0 ELSE -1.0 END AS slope FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken,
  CAST(passes + CASE WHEN part > 0 AND part * 2 >= size THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CASE WHEN passes * size + part > 0 THEN round(least(1.0, greatest(0.0, (sqrt(CAST(early * early + 2 * slope * share AS DOUBLE)) - early) / slope)), 6) END AS position,
  coalesce(array_to_string(list_transform(range(0, CAST(passes + CASE WHEN part > 0 THEN 1 ELSE 0 END AS BIGINT)), lambda n:
    CAST(round(1e6 * least(1.0, greatest(0.0, (sqrt(early * early + 2 * slope * (CAST(n * source_size + start AS DOUBLE) / words)) - early) / slope))) AS BIGINT)), ','), '') AS positions
FROM g
"""


#: The same as op12_fim, by counting code points.
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, text, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def _op13_sql() -> str:
    """The same as op13_codes, with a distance for each part and entry; vectors have one length that divides by eight."""
    parts, entries = codes.PARTS, codes.ENTRIES
    steps = [
        f"""
WITH i AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {codes.SCALE}) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM i, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, CAST(row - 1 AS INTEGER) AS entry, x AS c FROM x WHERE row <= {entries})""",
    ]
    for r in range(codes.ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, part, x, min((d, entry)) AS best FROM
  (SELECT row, x.part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{r} c ON x.part = c.part)
  GROUP BY row, part, x)""")
        if r < codes.ROUNDS:
            steps.append(f"""
s{r} AS (SELECT part, best[2] AS entry, place, CAST(sum(x[place]) AS BIGINT) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM s{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)""")
    last = codes.ROUNDS
    return ",".join(steps) + f""",
e AS (SELECT row, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{last} GROUP BY row)
SELECT i.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY i.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{last}) AS codebooks_sha256
FROM i JOIN e ON e.row = i.row
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secrets, op2_fingerprints, op3_repeats, op4_chat, op5_gif, op6_mixing, op7_shards, op8_simhash, op9_packing, op10_language, op11_bpe, op12_fim, op13_codes)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op6_mixing": OP6_SQL, "op12_fim": OP12_SQL, "op13_codes": OP13_SQL}

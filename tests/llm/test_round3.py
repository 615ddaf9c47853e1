"""Byte-level BPE in chunks, fill-in-the-middle by runs and product codes, against brute-force versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import bpe, codes, fim, queries

from .test_ops import DOCS, SCHEMA

sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    return bpe.ranks(bpe.default_path()).encoding


# ---- byte-level BPE

def test_bpe_equals_library(spark, docs, library):
    got = {(r["doc_id"], r["text"], r["count"]): (r["ids"], bytes(r["data"])) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(got) == len({(d[0], d[1], d[5]) for d in DOCS})
    for (_, text, _), (ids, data) in got.items():
        assert ids == library.encode_ordinary(text or "") and data == (text or "").encode()


HARD = [
    "x" * 200, "it's we'll they're I'd 'tis '''s'" * 9, "a " * 60 + " " * 40 + "b" * 70 + "\n\n  \t c", "日本語" * 50, "😀é" * 40, "don't" * 30, "'" * 90 + "re" * 40,
    "  " * 80, "1234567890" * 15 + " ½²" * 20, "word, " * 50 + "'ll" * 30, "՘࢏ letters that only newer tables know \U00011de0" * 6, "a  \x1f b" * 30, "",
]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 8), (20, 20), (64, 12)])
def test_bpe_stitches_short_chunks(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    texts = HARD + ["".join(rng.choice("ab '’stre  \n1é日,.") for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumns({"chunk": F.lit("kept"), "a `b` c.d": F.lit(1), "doc": F.col("row")})
    got = bpe.encode(rows.repartition(5), chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == library.encode_ordinary(texts[r["row"]] or ""), texts[r["row"]]
        assert (r["chunk"], r["a `b` c.d"], r["doc"]) == ("kept", 1, r["row"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_bpe_pieces_equal_library(text):
    r = bpe.ranks(bpe.default_path())
    pieces = r.pieces(text)
    assert "".join(pieces) == text
    ids = np.frombuffer(r.ids(pieces), np.int32).tolist()
    assert ids == r.encoding.encode_ordinary(text) and r.bytes_of(ids) == text.encode()


def test_bpe_every_character(library):
    r = bpe.ranks(bpe.default_path())
    chars = "".join(f"a{chr(c)}1{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for at in range(0, len(chars), 50_000):
        text = chars[at : at + 50_000]
        assert np.frombuffer(r.ids(r.pieces(text)), np.int32).tolist() == library.encode_ordinary(text)


def test_bpe_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty).collect() == [] and bpe.encode(empty).columns == [*empty.columns, "ids"]
    odd = spark.createDataFrame([([1, None, -3, 10**9, 2],), (None,), ([],)], "ids array<int>")
    table = bpe.ranks(bpe.default_path()).table
    assert [r["data"] for r in bpe.decode(odd).collect()] == [table[1] + table[2], None, b""]
    clash = spark.createDataFrame([("some text", "old")], "text string, ids string")
    assert bpe.encode(clash).select("ids").first()[0] == bpe.ranks(bpe.default_path()).encoding.encode_ordinary("some text")
    with pytest.raises(ValueError):
        bpe.encode(empty, overlap=3)


def test_op11_query(spark, tmp_path, docs, library):
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_bpe(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for d in DOCS:
        ids = library.encode_ordinary(d[1] or "")
        want.append((-1 if d[0] is None else d[0], len(ids), sha(",".join(map(str, ids))), sha(d[1] or "")))
    assert got == sorted(want)


# ---- fill-in-the-middle

def plain_fim(key, text):
    text, n = text or "", len(text or "")
    h = [int(sha(f"1:{'' if key is None else key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_equals_plain_version(spark, docs):
    more = [(1000 + i, t, None, None, 0, 0, "x") for i, t in enumerate(["<P", "a<S>b", "é" * 40 + "<", "日a😀" * 50, "P>x<", "<<<<", "😀", "x" * 3000 + "é" * 3000])] * 3
    more = [(d[0] + 20 * i, *d[1:]) for i, d in enumerate(more)]
    table = docs.union(spark.createDataFrame(more, SCHEMA)).withColumns({"doc": F.lit(1), "p": F.lit(2), "odd `name`": F.lit(3), "first": F.lit(4), "form": F.lit("old")})
    rows = fim.fill_in_middle(table).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(DOCS) + len(more)
    forms = set()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and (r["doc"], r["p"], r["odd `name`"], r["first"]) == (1, 2, 3, 4)
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é日😀"), max_size=40))
def test_fim_offsets(text):
    units, sizes = fim.runs_of(text.encode())
    assert len(units) == len(sizes) and (units[-1], sizes[-1]) == (len(text), len(text.encode()))
    widths = [len(c.encode()) for c in text]
    assert len(units) - 1 == sum(i == 0 or w != widths[i - 1] for i, w in enumerate(widths))
    for cut in range(len(text) + 1):
        assert fim.offset(units, sizes, cut) == len(text[:cut].encode())


def test_fim_shares_and_marks(spark):
    rows = spark.createDataFrame([(i, f"text {i} {{x}}") for i in range(400)], "k long, body string")
    out = fim.fill_in_middle(rows, text="body", key="k", seed=5, cut_share=50, spm_share=50, marks=("[pre]", "[s]", "[middle]"))
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[s]", "[middle]"))).collect()
    assert all(r["back"] == r["body"] for r in got)
    counts = {f: sum(r["form"] == f for r in got) for f in ("plain", "psm", "spm")}
    assert 150 < counts["plain"] < 250 and 60 < counts["psm"] < 140 and 60 < counts["spm"] < 140
    assert fim.fill_in_middle(rows.limit(0), text="body", key="k").collect() == []


# ---- product codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) by distances to all entries."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((dist(v, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(p, cut(r[2], p))[1], []).append(cut(r[2], p))
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out = []
    for i, lab, v in kept:
        found = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, lab, _, error in out:
        total[lab] = total.get(lab, 0) + error
    return [(i, c, e, total[lab]) for i, lab, c, e in out], sha(",".join(str(x) for b in books for c in b for x in c))


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, length, seed=3):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in np.float32(rng.normal(size=length) * 0.2)], int(rng.integers(0, 4)) if i % 5 else None) for i in range(n)]
    tie = [0.25] * length
    out += [(n, None, 1), (n + 1, [None] * length, 1), (n + 2, [float("nan")] + tie[1:], 2), (n + 3, [float("inf")] + tie[1:], None), (n + 4, tie, 1), (n + 4, tie, 1), (None, tie, None), (2, [-0.5] * length, 3)]
    return out + [out[0]] * 3


@pytest.mark.parametrize(("n", "length"), [(300, 64), (40, 16), (3, 8), (60, 13), (0, 8)])
def test_codes_equal_plain_version(spark, n, length):
    rows = vectors(n, length) if n else vectors(1, length)[1:]
    want, digest = plain_codes(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"ints": F.lit(1), "code": F.lit("x")}).repartition(4)
    got = codes.product_codes(df).withColumn("code", F.lower(F.hex("code"))).collect()
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=by) == sorted(want, key=by)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_codes_of_few_values_and_lengths(spark):
    """Many ties, entries that nothing uses, vectors of several lengths, and an empty one."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(rng.choice([16, 16, 9, 0]))], None) for i in range(120)]
    want, digest = plain_codes(rows)
    got = codes.product_codes(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"], r["code"].hex(), r["error"], r["label_error"]) for r in got) == sorted(want) and {r["codebooks_sha256"] for r in got} == {digest}
    assert codes.product_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.product_codes(spark.createDataFrame([(1, None, None)], VECTORS)).collect() == []
    assert codes.product_codes(spark.createDataFrame([(1, [1e30] * 8, 5), (2, [-1e30] * 8, 5)], VECTORS)).count() == 2


def test_partial_distance_drops_nothing_that_could_win():
    rng = np.random.default_rng(0)
    books = codes.Codebooks(rng.integers(-9, 9, (2, 16, 4)))
    x = rng.integers(-9, 9, (500, 8))
    got, errors = books.assign(x)
    for p in range(2):
        d = ((x[:, None, p * 4 : p * 4 + 4] - books.entries[p][None]) ** 2).sum(2)
        assert (got[:, p] == d.argmin(1)).all() and (errors[:, p] == d.min(1)).all()
        spread = books.entries[p].var(0)
        assert (np.diff(spread[books.order[p]]) <= 1e-9).all()


def test_label_errors_of_hot_and_rare_labels(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, None).when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("label"), (F.col("id") % 5).alias("error"))
    got = codes.with_label_error(rows).groupBy("label").agg(F.min("label_error"), F.max("label_error"), F.sum("error"), F.count("*")).collect()
    assert len(got) == 2002 and all(r[1] == r[2] == r[3] for r in got) and sum(r[4] for r in got) == 6000

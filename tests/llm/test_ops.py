"""Each operator against a brute-force version, on a small table with hard cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, gif, langid, mixing, packing, secrets, simhash, sketch, sst, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, b_start string"


def make_docs() -> list[tuple]:
    """Documents with copies, near copies, nulls, empty and long texts; extra columns have clashing names."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = prose(90), prose(6000)
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1], None, "", " \n\t", "x", "a" * 700, "ab" * 450, long, long[:9000] + " end", "\x00" * 250, "é" * 150]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(5)] + ["word " * 500, "😀 two words", "TOKEN=" + "a1" * 15, "<|endoftext|> x", "a <|endoftext|><|endoftext|>"]
    base = prose(200).split(" ")
    for i in range(12):
        near = list(base)
        near[i * 3] = "changed"
        texts.append(" ".join(near))
    out = [(3 * i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, "a"]), len(t or ""), i, "x") for i, t in enumerate(texts)]
    return out + [out[5], (None, "no id here", None, None, 1, 0, "y"), (7, out[3][1], None, "a", 1, 0, "z")]


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- secrets

def plain_spans(text):
    out, low = [], re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    out += [("assign", m.start(), m.end()) for m in low.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def test_secret_spans():
    rng = random.Random(1)
    bits = ["password", "PassWD", "secret", "ToKen", "apikey", "api_key", "AKIA", "akia", "=", ":", " ", "'", '"', "é", "😀", "İ", "ſecret", "deadbeef01", "0123456789abcdef01234567", "ABCDEFGH12345678", "x", "\n", "-_"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in secrets.find_spans(text) if s[0] in secrets.BASE_KINDS] == plain_spans(text), text
    assert secrets.find_spans(None) == secrets.find_spans("") == []


def test_secret_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secrets.crc_base62(body)
    assert [s[0] for s in secrets.find_spans(f"x {good} y")] == ["codehost"]
    assert secrets.find_spans(f"x ghp_{body}aaaaaa y") == []
    assert secrets.redact("a token=abcdef123 b", secrets.find_spans("a token=abcdef123 b")) == "a [assign] b"


def test_secret_scan(docs, empty):
    got = rows(secrets.scan(docs))
    assert len(got) == len(DOCS)
    want = Counter((d[0], hashlib.sha256(secrets.spans_text(plain_spans(d[1] or "")).encode()).hexdigest()) for d in DOCS)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert rows(secrets.scan(empty)) == []
    clean = secrets.redact_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    assert clean.where("text like '%[assign]%'").count() == 1


# ---- fingerprints

def test_sketch_of_a_text(spark):
    text = " ".join(f"w{i % 300}" for i in range(900))
    df = spark.createDataFrame([(text,), ("one two",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(sketch.sketch(F.col("text"))).collect()]
    assert [len(x) for x in got] == [128, 1, 0, 0]
    n = df.select(sketch.distinct_count(sketch.sketch(F.col("text")))).first()[0]
    assert abs(n - 300) < 75
    back = df.select(sketch.decoded(sketch.encoded(sketch.sketch(F.col("text"))))).collect()
    assert [r[0] for r in back] == got


def test_fingerprints(docs, empty, spark):
    got = rows(sketch.fingerprint(docs))
    assert len(got) == len(DOCS)
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = Counter()
    for i, d in enumerate(order):
        text, nxt = d[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[d[0], len(text), hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    words = lambda t: (t or "").split()

    def exact(a, b):
        s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a), words(b)))
        return len(s & t) / len(s | t) if s | t else 1.0

    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, d in enumerate(order):
        if len(by[d[0]]) == 1:
            assert abs(by[d[0]][0]["near_next"] - exact(d[1], order[(i + 1) % len(order)][1])) < 0.15
    assert rows(sketch.fingerprint(empty)) == []
    one = rows(sketch.fingerprint(docs.where("doc_id = 9")))
    assert one[0]["near_edited"] > 0 and len(one) == 1


def test_group_sketches_merge(docs):
    got = {r["source"]: r["sketch"] for r in rows(sketch.group_sketch(docs, ["source"], k=16))}
    parts = docs.withColumn("h", F.explode(sketch.sketch("text", 10_000))).groupBy("source").agg(F.sort_array(F.collect_set("h")).alias("h"))
    for r in parts.collect():
        assert got[r["source"]] == r["h"][:16]


# ---- repeated substrings

def plain_removal(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def removal(df, **kw):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix.remove_repeats(df, **kw)))


def removal_wanted(data, length=200):
    return Counter((d[0], *w) for d, w in zip(data, plain_removal([d[1] for d in data], length), strict=True))


@pytest.mark.parametrize("length", [200, 64])
def test_repeats(docs, empty, length):
    assert removal(docs, length=length) == removal_wanted(DOCS, length)
    assert rows(suffix.remove_repeats(empty)) == []


@pytest.mark.parametrize("group", [1, 3])
def test_repeats_with_large_intervals(docs, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    assert removal(docs) == removal_wanted(DOCS)


def test_repeats_over_many_files_a_task(docs, spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        assert removal(docs) == removal_wanted(DOCS)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def small_tables():
    """Tables of 2 to 50 documents that share passages, with sides from none to long."""
    rng = random.Random(11)
    draw = lambda n, of="abcdefgh \u00e9": "".join(rng.choice(of) for _ in range(n))
    p = draw(230)
    yield ["x" * 30 + p + "1", "y" * 30 + p + "2"]
    yield [draw(rng.randint(0, 40)) + p + draw(rng.randint(0, 40)) for _ in range(40)]
    for n in (2, 3, 7, 20, 50):
        passages = [draw(rng.choice([150, 198, 199, 200, 201, 260, 700]), rng.choice(["ab", "abcdefgh ", "\u00e9\u65e5a"])) for _ in range(3)]
        yield ["".join(rng.choice([draw(rng.choice([0, 1, 5, 90, 400])), rng.choice(passages)]) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_repeats_in_small_tables(spark):
    """One table of many ids would mix them, so each stands for itself."""
    for texts in small_tables():
        data = list(enumerate(texts))
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        assert removal(df) == removal_wanted(data)


def test_expansion_against_plain_counting():
    """Surroundings of one anchor with short sides, in one and in several intervals."""
    rng = random.Random(12)
    for _ in range(150):
        length, m = rng.choice([8, 12, 20]), rng.randint(0, 9)
        k = suffix.gram_bytes(length)
        side, core = length - k, bytes(rng.choice(b"ab\x00\xff") for _ in range(k))
        parts_ = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, side))) for _ in range(2 * m)]
        around, at = [parts_[2 * i] + core + parts_[2 * i + 1] for i in range(m)], [len(parts_[2 * i]) for i in range(m)]
        interval = [rng.randint(0, 1) for _ in range(m)]
        left, right = suffix.expand(around, np.array(at, np.int64), np.array(interval, np.int64), length)
        seen = Counter((interval[i], at[i] - s, around[i][s : s + length]) for i in range(m) for s in range(len(around[i]) - length + 1) if s <= at[i])
        for i in range(m):
            backs = [b for (v, b, x), c in seen.items() if c > 1 and v == interval[i] and b <= at[i] and around[i][at[i] - b : at[i] - b + length] == x]
            assert (left[i], right[i]) == ((max(backs), length - min(backs)) if backs else (-1, -1))


def test_large_intervals_meet_every_string():
    """Each string of the length around the anchor is in one of the longer intervals, at any depth."""
    length, around, at = 20, bytes(range(40, 74)), 15
    strings = {s for s in range(len(around) - length + 1) if s <= at and s + length >= at + 4}
    todo, met = [{"key": b"", "reach": 0, "proof": 0, "n": 1, "before": 0, "after": 4, "at": at, "around": around}], set()
    while todo:
        row = todo.pop()
        if row["before"] + row["after"] == length:
            met.add(at - row["before"])
            continue
        todo += [dict(zip(row, x, strict=True)) for x in suffix.extended(row, length)]
    assert met == strings


def test_common_prefixes():
    rng = random.Random(13)
    for _ in range(60):
        codes = np.array([x for _ in range(rng.randint(1, 6)) for x in [*(rng.randint(1, 3) for _ in range(rng.randint(0, 30))), 0]], np.uint16)
        length = rng.randint(1, 9)
        t = suffix.Transform(codes, length)
        text, common = codes.tolist(), t.common_prefixes(length)
        heads = [text[i : i + length] for i in t.order]
        assert heads == sorted(text[i : i + length] for i in range(len(text)))
        for a, b, c in zip(heads, heads[1:], common[1:], strict=False):
            if a == b:
                assert c == -1 or 0 in a or len(a) < length
                continue
            same = next(i for i in range(length) if a[i : i + 1] != b[i : i + 1])
            if 0 not in a[: same + 1] and len(a) > same:  # an end mark may leave a suffix joined to those behind it
                assert c == same


def test_anchors_over_chunks(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = suffix.anchors(data)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    cut = suffix.anchors(data)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


# ---- chat

def test_chat_links(spark):
    call = lambda i, args, name="reply": json.dumps({"tool_call": {"id": i, "name": name, "arguments": args}})
    result = lambda i, c: json.dumps({"tool_result": {"id": i, "content": c}})
    msgs = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call("a", {"turn": 1.0, "prompt": "é"})), (1, 2, "tool", result("a", {"b": 2, "a": 1})),
        (1, 3, "assistant", call("b", {"prompt": "$result:c", "turn": 3})), (1, 4, "assistant", call("c", {"prompt": "", "turn": -1, "z": 0})), (1, 5, "tool", result("c", 1)),
        (1, 6, "tool", result("zz", None)), (1, 7, "assistant", call("a", {})), (2, 0, "assistant", call("a", [], "none")),
        (3, 0, "assistant", call("x", {"prompt": "$result:y", "turn": 0})), (3, 1, "tool", result("x", 0)), (3, 2, "assistant", call("y", {"prompt": "$result:x", "turn": 0})), (3, 3, "tool", result("y", 0)),
        (None, 1, "tool", result("a", 0)), (4, None, None, None), (4, 2, "user", "{broken"),
    ]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in rows(chat.link(chat.parse_messages(df)))}
    assert len(got) == len(msgs)
    status = lambda *k: got[k]["status"]
    assert status(1, 1) == status(1, 2) == status(1, 5) == "linked"
    assert status(1, 3) == status(2, 0) == "open" and status(1, 6) == "orphan" and status(1, 7) == "repeated"
    assert status(None, 1) == "orphan" and status(4, None) == status(4, 2) == "message"
    assert status(3, 0) == status(3, 1) == status(3, 2) == status(3, 3) == "cyclic"
    assert got[1, 1]["json"] == '{"role":"assistant","tool_call":{"arguments":{"prompt":"é","turn":1},"id":"a","name":"reply"}}'
    assert got[1, 1]["faults"] == [] and got[1, 4]["faults"] == ["$.prompt: too short", "$.turn: below minimum", "$.z: unknown"] or len(got[1, 4]["faults"]) == 3
    place = lambda *k: (got[k]["place"], got[k]["level"])
    assert place(1, 4) < place(1, 5) < place(1, 3)
    assert rows(chat.link(chat.parse_messages(df.limit(0)))) == []


def plain_order(edges, place):
    """(place, level) by following all predecessors; None on or behind a cycle."""
    before = defaultdict(list)
    for a, b in edges:
        before[a].append(b)
    out, todo = {}, set(place)
    while ready := {x for x in todo if all(b in out for b in before[x])}:
        for x in ready:
            out[x] = (max([place[x], *(out[b][0] for b in before[x])]), max([-1, *(out[b][1] for b in before[x])]) + 1)
        todo -= ready
    return out | dict.fromkeys(todo)


def test_order_of_calls(spark):
    """Long chains, rows with several predecessors in several layers, cycles and what is behind them."""
    rng = random.Random(9)
    cases = [[(i + 1, i) for i in range(60)], [(i, i // 2) for i in range(1, 40)], [(0, 1), (1, 2), (2, 0), (3, 2), (4, 3), (6, 5)], []]
    cases += [[(a, rng.randrange(a)) for a in range(1, 25) for _ in range(rng.choice([0, 1, 1, 2]))] for _ in range(3)]
    cases.append([(a, rng.randrange(20)) for a in range(20) for _ in range(rng.choice([0, 1, 2]))])
    edges = {(100 * n + a, 100 * n + b) for n, c in enumerate(cases) for a, b in c}
    place = {100 * n + i: rng.randrange(50) for n in range(len(cases)) for i in range(65)}
    got = chat._order(spark.createDataFrame(list(place.items()), "uid long, place long"), spark.createDataFrame(list(edges), "uid long, before long"))
    assert {r["uid"]: None if r["cyclic"] else (r["place"], r["level"]) for r in rows(got)} == plain_order(edges, place)


def test_chat_nulls_and_repeats(spark):
    """Null keys link nothing, repeated rows give a row each, missing results are faults, further columns do not matter."""
    msgs = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 3, "user", ""), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, None, "user", "x" * 1001), (2, 1, None, None), (3, 2, "system", "s")]
    df = spark.createDataFrame([(*m, 1, "k") for m in msgs], "conv_id long, turn long, role string, text string, status int, json string")
    got = rows(chat.link(chat.turns_as_calls(df)))
    assert Counter((r["conv_id"], r["turn"], r["kind"], r["status"], tuple(r["faults"])) for r in got) == Counter([
        (1, 0, "call", "linked", ()), (1, 0, "call", "repeated", ()), (1, 1, "result", "linked", ()), (1, 3, "call", "open", ("$.prompt: too short", "$result:1: no result")),
        (None, 0, "call", "open", ()), (None, 1, "result", "orphan", ()), (2, None, "call", "open", ("$.turn: missing", "$.prompt: too long")), (2, 1, "message", "message", ()), (3, 2, "message", "message", ()),
    ])
    assert rows(chat.link(chat.turns_as_calls(df.limit(0)))) == []


def test_tool_calls_in_dialogues(spark):
    call = lambda i, args: " " + json.dumps({"tool_call": {"id": i, "name": "reply", "arguments": args}})
    result = lambda i: json.dumps({"tool_result": {"id": i, "content": 1}})
    msgs = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call("0", {"prompt": "$result:b", "turn": 1})), (1, 2, "assistant", call("b", {"prompt": "", "turn": 2})),
        (1, 3, "tool", result("b")), (1, 4, "tool", result("0")), (1, 5, "user", "{no json"), (1, 6, "assistant", "fine"), (1, 7, "system", None),
        (2, 0, "user", json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": {}} for i in "xy"]})),
    ]
    got = {(r["conv_id"], r["turn"], r["part"]): r for r in rows(chat.link(chat.turns_as_calls(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string"))))}
    seen = lambda *k: (got[k]["kind"], got[k]["call_id"], got[k]["status"])
    assert len(got) == 10 and seen(1, 0, 0) == ("call", "0", "open")
    assert seen(1, 1, 0) == ("call", "0", "linked") and seen(1, 4, 0) == ("result", "0", "linked") and seen(1, 3, 0) == ("result", "b", "linked")
    assert seen(1, 5, 0) == ("call", "5", "linked") and seen(1, 6, 0) == ("result", "5", "linked") and seen(1, 7, 0) == ("message", None, "message")
    assert seen(2, 0, 0) == ("call", "x", "open") and seen(2, 0, 1) == ("call", "y", "open")
    assert got[1, 2, 0]["faults"] == ["$.prompt: too short"] and len(got[2, 0, 1]["faults"]) == 2
    assert [got[1, t, 0]["level"] for t in (2, 3, 1, 4)] == [0, 1, 2, 3]


# ---- GIF

def test_gif_round_trip(docs, empty):
    got = rows(gif.store_texts(docs))
    want = Counter()
    for d in DOCS:
        data = (d[1] or "").encode()
        pad = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want[d[0], len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert rows(gif.store_texts(empty)) == []


def plain_lzw(data, size):
    """A reader that follows the format bit by bit."""
    clear, stop, at, width, table, last, out = 1 << size, (1 << size) + 1, 0, size + 1, None, None, b""
    number = int.from_bytes(data, "little")
    while at + width <= 8 * len(data):
        code = number >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == stop:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, last = out + entry, entry
    return out


def test_lzw_against_plain_reader():
    rng = random.Random(5)
    for size, n in ((8, 30_000), (8, 0), (8, 1), (2, 3000), (4, 9000)):
        data = bytes(rng.choice(range(min(1 << size, 7))) for _ in range(n))
        code = gif.lzw_encode(data, size)
        assert plain_lzw(code, size) == data == gif.lzw_decode(code, size, n or 1)


def test_lzw_deferred_clear():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(9000))
    # roots only, one clear at the start: the table fills up and stays
    width, _, _ = gif._schedule(8, 4096 - 256)
    codes = np.r_[256, np.frombuffer(data, np.uint8).astype(int), 257]
    widths = np.r_[9, width, np.full(len(data) + 1 - len(width), 12)]
    assert gif.lzw_decode(gif._join_codes(codes, widths), 8, len(data)) == data


def make_gif(frames, w=4, h=4, palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    import struct

    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0), palette, b"\x21\xfe\x02hi\x00"]
    for left, top, fw, fh, disposal, delay, clear, interlace, local, samples in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, fw, fh, (0x40 if interlace else 0) | (0x81 if local else 0)) + (local or b"") + b"\x02")
        body = gif.lzw_encode(bytes(samples), 2)
        out += [bytes([len(body)]), body, b"\0"]
    return b"".join([*out, b";"])


def test_gif_composition(spark):
    full = (0, 0, 4, 4, 1, 5, None, False, None, [1] * 16)
    patch = lambda d, t=None: (1, 1, 2, 2, d, 7, t, False, None, [2, 3, 3, 2])
    last = (0, 0, 1, 1, 0, 1, None, False, None, [3])
    seen = lambda d, t=None: [f.canvas for f in gif.decode(make_gif([full, patch(d, t), last]))]
    kept, cleared, restored = seen(1), seen(2), seen(3)
    assert kept[2][1, 1].tolist() == [0, 255, 0, 255]
    assert cleared[2][1, 1].tolist() == [0, 0, 0, 0]
    assert restored[2][1, 1].tolist() == [255, 0, 0, 255]
    assert kept[1][1, 2].tolist() == [0, 0, 255, 255] and seen(1, 3)[1][1, 2].tolist() == [255, 0, 0, 255]
    rows_ = [i % 4 for i in (0, 4, 2, 1, 3)]
    woven = next(iter(gif.decode(make_gif([(0, 0, 1, 5, 0, 0, None, True, None, rows_)], 1, 5))))
    assert woven.samples[:, 0].tolist() == [rows_[0], rows_[3], rows_[2], rows_[4], rows_[1]]
    local = next(iter(gif.decode(make_gif([(0, 0, 4, 4, 0, 0, None, False, bytes([9] * 12), [1] * 16)]))))
    assert local.canvas[0, 0].tolist() == [9, 9, 9, 255]
    df = spark.createDataFrame([(1, make_gif([full, patch(2)])), (2, b"GIF89a"), (3, None), (4, make_gif([full])[:-12])], "id long, media binary")
    got = gif.frames(df, "id", "media").orderBy("id", "frame").collect()
    assert [(r["id"], r["frame"], r["at_cs"]) for r in got[:2]] == [(1, 0, 0), (1, 1, 5)] and got[0]["histogram"][7] == 16
    assert all(r["error"] for r in got[2:4])


def test_media_and_frames_are_stored(spark, docs, tmp_path):
    gif.media_of_texts(docs).write.parquet(str(tmp_path / "media"))
    stored = spark.read.parquet(str(tmp_path / "media"))
    back = Counter((r["doc_id"], gif.stored_samples(r["media"])[0][: r["n_bytes"]]) for r in rows(stored))
    assert back == Counter((d[0], (d[1] or "").encode()) for d in DOCS)
    media = make_gif([(0, 0, 4, 4, 1, 5, None, False, None, [1] * 16), (1, 1, 2, 2, 1, 7, None, False, None, [2, 3, 3, 2])])
    got = gif.frames(spark.createDataFrame([(1, media)], "id long, media binary"), "id", "media").orderBy("frame").collect()
    for r, f in zip(got, gif.decode(media), strict=True):
        assert bytes(r["canvas"]) == f.canvas.tobytes() and (r["canvas_width"], r["canvas_height"]) == (4, 4)
        assert (r["left"], r["top"], r["width"], r["height"]) == (f.left, f.top, *f.samples.shape[::-1])


# ---- mixing

def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing(docs, empty):
    got = rows(mixing.mix(docs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d[0], size(d[1])) for d in DOCS)
    sizes = defaultdict(int)
    for d in DOCS:
        sizes[d[3]] += size(d[1])
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs.repartition(7)))))
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert rows(mixing.mix(empty)) == []
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixing.apply_mix(empty).count() == 0
    assert Counter(r["doc_id"] for r in rows(mixed)) != {}


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 300}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    want = plain_targets(sizes)
    for r in rows(mixing.source_targets(df)):
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-9)


def test_blocks_of_a_source(docs, monkeypatch):
    whole = rows(mixing.mix(docs))
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    cut = rows(mixing.mix(docs))
    for got in (whole, cut):
        taken = defaultdict(int)
        for r in got:
            taken[r["source"], round(r["target"])] += r["taken"]
        assert all(abs(n - t) <= 1 for (_, t), n in taken.items())


def test_every_copy_has_its_position(spark, tmp_path):
    data = [(i, f"w{i} " * 10, "abc"[i % 3] if i < 60 else "d") for i in range(600)] + [(5, "again " * 10, "c"), (None, "none " * 10, "a"), (None, "none " * 10, "a")]
    names = ["_copies", "_copy", "_key", "_number", "row", "position", "size", "number", "a.b"]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names))).repartition(5)
    plan = rows(mixing.mix(df))
    by = defaultdict(list)
    for r in plan:
        assert len(r["positions"]) == -(-r["taken"] // r["size"]) and r["positions"] == sorted(r["positions"])
        assert r["position"] == (r["positions"][0] if r["taken"] else None)
        by[r["source"]] += r["positions"]
    twice = [r for r in plan if r["taken"] == 2 * r["size"]]
    # a rising weight meets half of its demand at (sqrt(5) - 1) / 2, a falling one as early as 1 less that
    half = {"a": (5 ** 0.5 - 1) / 2, "b": 1.5 - 1.25 ** 0.5}
    assert {r["source"] for r in twice} >= {"a"}
    for r in twice:
        if r["source"] in half:
            assert r["positions"][0] < half[r["source"]] <= r["positions"][1] + 1e-9
    for at in by.values():
        assert min(at) == 0 and max(at) > 0.9
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    mixed.write.parquet(str(tmp_path / "mixed"))
    want = sorted((p, -1 if r["doc_id"] is None else r["doc_id"]) for r in plan for p in r["positions"][: r["copies"]])
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    got = [r for f in files for r in rows(spark.read.parquet(str(f)))]
    assert [d for _, d in want] == [r["doc_id"] if r["doc_id"] is not None else -1 for r in got]
    assert Counter(r["text"] for r in got if r["doc_id"] == 5).keys() <= {"w5 " * 10, "again " * 10}


# ---- tokens, shards, packing

@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts(encode):
    rng, e = random.Random(2), tokens.encoder(tokens.default_path())
    for _ in range(1500):
        text = "".join(rng.choice([chr(rng.randrange(32, 0x250)), chr(rng.randrange(0x370, 0x1000)), " ", "\n", "ab", "'s", "\x1c", "\x85", "5", "²", "😀", "  "]) for _ in range(25))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == encode(text), repr(text)


def test_added_tokens(encode):
    """Added tokens anywhere give the ids that the library gives for the whole text."""
    e = tokens.encoder(tokens.default_path())
    assert len(e.tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids) == 4
    for t in json.loads(e.tokenizer.to_str())["added_tokens"]:
        x = t["content"]
        for text in (x, x + x, f"a{x}", f"{x}a", f" {x} {x} b", f"a {x}\n\n{x}", f"{x[:-1]} {x[1:]}", f"😀{x}é{x}"):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == encode(text), text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards(docs, empty, encode, tmp_path):
    got = rows(sst.token_table(docs))
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    start, want = 0, []
    for d in order:
        ids = encode(d[1]) + [2]
        want.append((d[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])) for r in got)
    assert rows(sst.token_table(empty)) == []
    manifest = sst.write_shards(docs, f"file://{tmp_path}/sst")
    assert sst.lookup(manifest, 9)[0].tolist() == encode(DOCS[3][1]) + [2]
    assert len(sst.lookup(manifest, None)) == 1 and len(sst.lookup(manifest, 15)) == 2 and sst.lookup(manifest, 1) == []


def test_shard_format(tmp_path):
    data = [(None, np.array([1], "<u4")), *((i * 7 - 50, np.arange(i % 40 + 1, dtype="<u4") * (70_000 if i % 9 == 0 else 1)) for i in range(900))]
    with open(tmp_path / "x", "wb") as f:
        sst.write_shard(f, data, block_bytes=256)
    with open(tmp_path / "x", "rb") as f:
        shard = sst.Shard(f)
        assert [(k, v.tolist()) for k, v in shard] == [(k, v.tolist()) for k, v in data] and len(shard.index) > 50
        assert all(shard.get(k)[0].tolist() == v.tolist() for k, v in data[::37])
        misses = [k for k in range(10_000, 30_000) if shard.may_contain(k)]
        assert len(misses) < 600 and shard.get(8) == []
    with pytest.raises(ValueError):
        with open(tmp_path / "y", "wb") as f:
            sst.write_shard(f, [(2, np.array([1])), (1, np.array([1]))])


def test_packing(docs, empty, encode):
    got = rows(packing.pack(docs))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for d in DOCS:
        want[d[0]].append(encode(d[1]) + [1])
    assert set(by) == set(want)
    for k, texts in want.items():
        if len(texts) == 1:
            ids, at = texts[0], 0
            for r in sorted(by[k], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and crc(ids[at : at + r["length"]]) == r["ids_crc32"]
                at += r["length"]
            assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(r["length"] for r in got) == total and padding < 0.02 * total
    assert rows(packing.pack(empty)) == []


@pytest.mark.parametrize("longest", [30, 400, 1900, 9000])
def test_packer_keeps_documents_whole(longest):
    """Every id once and in order, no padding, and few documents cut that fit."""
    rng = random.Random(longest)
    sizes = [1 + int(longest * rng.random() ** 2) for _ in range(1500)] + [2048, 1, 4096, 2049] * (longest > 2048)
    packer, found, seqs = packing.Packer(3), defaultdict(list), defaultdict(int)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for doc, start, n, data, total, seq, at in [r for i, x in enumerate(ids) for r in packer.add(i, x)] + list(packer.finish()):
        assert at == seqs[seq] and n * 4 == len(data) and total == sizes[doc] and seq >= 3 * packing.WORKER_STEP
        seqs[seq] += n
        found[doc].append((start, data))
    assert all(b"".join(d for _, d in sorted(found[i])) == x and sorted(found[i])[0][0] == 0 for i, x in enumerate(ids))
    assert all(n == 2048 or n & (n - 1) == 0 for n in seqs.values()) and sum(n < 2048 for n in seqs.values()) < 12
    fitting = [i for i, n in enumerate(sizes) if n <= 2048]
    assert sum(len(found[i]) == 1 for i in fitting) >= 0.9 * len(fitting)


def test_packed_ids_give_the_texts_back(docs, encode):
    by = defaultdict(list)
    for r in rows(packing.pack(docs)):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        by[r["doc_id"]].append((r["start"], ids))
    count = Counter(d[0] for d in DOCS)
    for d in DOCS:
        if count[d[0]] == 1:
            assert [x for _, ids in sorted(by[d[0]]) for x in ids] == encode(d[1]) + [packing.END_ID]


# ---- SimHash

def plain_simhash(text):
    import xxhash

    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs: (doc_id, fp). Component of each, all links by comparing all."""
    n, parent = len(pairs), list(range(len(pairs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return [least[top(i)] for i in range(n)]


def components_wanted(data):
    pairs = [(d[0], plain_simhash(d[1])) for d in data]
    return Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(pairs, plain_components(pairs), strict=True))


def components_found(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(df)))


def test_simhash(docs, empty):
    assert components_found(docs) == components_wanted(DOCS)
    assert rows(simhash.near_duplicates(empty)) == rows(simhash.keep_one(empty)) == []
    kept = rows(simhash.keep_one(docs))
    pairs = [(d[0], plain_simhash(d[1])) for d in DOCS]
    groups = defaultdict(set)
    for (d, fp), c in zip(pairs, plain_components(pairs), strict=True):
        groups[c].add(fp)
    assert len(kept) == len(groups) and {r["doc_id"] for r in kept} == set(groups)


def near_texts(n=3000, seed=21):
    """Three texts whose fingerprints link first to second and second to third, but not first to third."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    found = {}
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(120)] = f"v{rng.randrange(900)}"
        found[plain_simhash(" ".join(words))] = " ".join(words)
    far = lambda a, b: (a ^ b).bit_count()
    for b in found:
        near = [x for x in found if 0 < far(x, b) <= 3]
        for a in near:
            for c in near:
                if far(a, c) > 3:
                    return found[a], found[b], found[c]


def test_rows_without_an_id_link_others(spark):
    a, b, c = near_texts()
    schema = "doc_id long, text string, _rows int, _stay string, none string, digest int, n int, row string, `a.b` int"
    wrap = lambda data: spark.createDataFrame([(*d, 1, "s", "t", 2, 3, "r", 4) for d in data], schema)
    for data in ([(1, a), (None, b), (3, c)], [(None, a), (None, b), (9, "other words of a text")], [(5, a), (5, c), (4, b)], [(None, None), (None, ""), (2, " "), (None, "alone")], [(7, a), (7, a), (None, c)]):
        df = wrap(data)
        assert components_found(df) == components_wanted(data)
        pairs = [(d, plain_simhash(t)) for d, t in data]
        groups, top = defaultdict(list), {}
        for i, (_, fp) in enumerate(pairs):
            linked = {top[j] for j in range(i) if (pairs[j][1] ^ fp).bit_count() <= 3}
            top = {j: min(linked | {i}) if t in linked else t for j, t in top.items()} | {i: min(linked | {i})}
        for i, t in top.items():
            groups[t].append(pairs[i][0])
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in rows(kept)) == Counter(min((d for d in g if d is not None), default=None) for g in groups.values())


def test_masks_meet_every_linked_pair():
    rng = random.Random(5)
    levels = [simhash.MASKS]
    while more := sorted({x for m in levels[-1] for x in simhash.longer_masks(m)}):
        levels.append(more)
    assert len(levels) == 4 and all(64 - m.bit_count() <= 14 for m in levels[-1])
    for _ in range(400):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        met = [m for m in simhash.MASKS if not m & differ]
        assert met
        for _ in range(3):
            met = [next(x for x in simhash.longer_masks(m) if not x & differ) for m in met]


@pytest.mark.parametrize("posting", [1 << 12, 4])
def test_links_find_all(spark, monkeypatch, posting):
    monkeypatch.setattr(simhash, "POSTING", posting)
    rng = random.Random(4)
    seeds, fps = [rng.getrandbits(64) for _ in range(6)], set()
    for s in seeds:
        for _ in range(60):
            x = s
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(12)])
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(signed(fp), fp) for fp in sorted(fps)]
    df = spark.createDataFrame([(x,) for x, _ in pairs], "fp long").repartition(3)
    from leafmill.llm.components import components

    found = {r["node"]: r["component"] for r in rows(components(simhash.links(df)))}
    assert [found.get(d, d) for d, _ in pairs] == plain_components(pairs)


def test_components_of_a_path(spark):
    from leafmill.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- language

def language_docs(n=240):
    rng = random.Random(8)
    parts = {"xx": ["the", "ing", "and", "er", "wh", "sh"], "yy": ["que", "eau", "ç", "é", "ai", "la"], "zz": ["sch", "ung", "ß", "ei", "ü", "en"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        out.append((i, text, lang if rng.random() < 0.9 else None, lang))
    return out + [(1000, None, "xx", None), (1001, "12 34 !!", "yy", None), (1002, "", None, None), (1003, "qqqq qjqjq xqxq zzqz wwqk " * 30, None, None)]


def test_language(spark):
    data = language_docs()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, truth string")
    got = {r["doc_id"]: r for r in rows(langid.identify(df))}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 3 == 1 and d[3]]
    assert all(got[d[0]]["held_out"] == (zlib.crc32(str(d[0]).encode()) % 3 == 1) for d in data)
    assert sum(got[d[0]]["lang_pred"] == d[3] for d in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(got[i]["rejected"] for i in (1000, 1001, 1002, 1003))
    kept = {r["doc_id"] for r in rows(langid.keep_identified(df))}
    assert kept == {k for k, r in got.items() if not r["rejected"]} and len(kept) >= 235
    nothing = rows(langid.identify(df.limit(0)))
    assert nothing == []
    blind = rows(langid.identify(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in blind} == {"und"}


def plain_model(counts, order):
    """Interpolated Kneser-Ney by dictionaries: a function from (context, character) to its probability."""
    places = Counter()
    for w, n in counts.items():
        text = " " * (order - 1) + w + " "
        for i in range(order - 1, len(text)):
            places[text[i - order + 1 : i + 1]] += n
    tables = {order: places}
    for n in range(order - 1, 0, -1):
        # an n-gram counts once for each character that stands before it
        tables[n] = Counter(g[1:] for g in tables[n + 1]) if n + 1 < order else Counter(g[1:] for g in places)
    levels = {}
    for n, table in tables.items():
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        total, kinds = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        levels[n] = table, d, total, kinds

    def p(context, char, n):
        if n == 0:
            return langid.Model.base
        table, d, total, kinds = levels[n]
        h = context[len(context) - n + 1 :]
        if not total[h]:
            return p(context, char, n - 1)
        return max(table[h + char] - d, 0) / total[h] + d * kinds[h] / total[h] * p(context, char, n - 1)

    return lambda context, char: p(context, char, order)


def test_scores_against_plain_kneser_ney():
    """The scorer that the queries use, for words met and not met, under several models at once."""
    rng = random.Random(14)
    n = langid.ORDER
    vocabularies = [Counter({"".join(rng.choice(x) for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(60)}) for x in ("abcd", "cdeé", "日本abc")]
    scorer = langid.Scorer([langid.fit(str(i), v) for i, v in enumerate(vocabularies)])
    plain = [plain_model(v, n) for v in vocabularies]
    words = [w for v in vocabularies for w in list(v)[:15]] + ["zzz", "a", "abcdabcdabcd", "ééé", "日"]
    padded = {w: " " * (n - 1) + w + " " for w in words}
    bits = {w: [sum(math.log2(p(t[i - n + 1 : i], t[i])) for i in range(n - 1, len(t))) for p in plain] for w, t in padded.items()}
    assert np.allclose(scorer._scores(words), [bits[w] for w in words])
    text = " ".join(words) + ", " + words[0].upper() + " 12"
    (got, size), = scorer.entropies([text])
    every = [*words, words[0]]
    assert size == sum(len(w) + 1 for w in every) and np.allclose(got, [-sum(bits[w][i] for w in every) / size for i in range(3)])
    lang, score, best, _ = next(scorer.predict([text]))
    share = np.exp2(-(got - got.min()) * size)
    assert lang == str(int(got.argmin())) and math.isclose(score, share.max() / share.sum()) and math.isclose(best, got.min())


def test_every_language_is_learned(spark):
    """Hundreds of languages, some with few documents; a language's own letters tell it."""
    letters = [chr(0x4E00 + 20 * i) for i in range(300)]
    data = [(i, f"{letters[i % 300]}{letters[i % 300]} {letters[i % 300]} " * 3, f"l{i % 300:03d}") for i in range(900)] + [(None, "aa bb " * 4, "none")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learned = {l for i, _, l in data if i is None or zlib.crc32(str(i).encode()) % 3 != 1}
    got = rows(langid.identify(df))
    assert len(learned) > 256 and all(r["lang_pred"] == f"l{r['doc_id'] % 300:03d}" for r in got if r["doc_id"] is not None and f"l{r['doc_id'] % 300:03d}" in learned)


def test_long_texts(spark):
    """Texts of some megabytes through the operators that no other test gives one; the scores of parts add up."""
    rng = random.Random(15)
    words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(400_000)) + " password=abc123456"
    df = spark.createDataFrame([(0, long, "xx"), (1, long, "xx"), (2, "x " + long, None), (4, "wabc wabd", "xx"), (5, None, "xx")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["n_assign"] for r in rows(secrets.scan(df))} == {0: 1, 1: 1, 2: 1, 4: 0, 5: 0}
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(df))} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 5}
    assert {r["doc_id"]: r["lang_pred"] for r in rows(langid.identify(df))} == {0: "xx", 1: "xx", 2: "xx", 4: "xx", 5: "und"}
    packed = rows(packing.pack(df).select("doc_id", "length", "doc_tokens"))
    assert all(sum(r["length"] for r in packed if r["doc_id"] == i) == next(r["doc_tokens"] for r in packed if r["doc_id"] == i) for i in (0, 1, 2, 4, 5))

"""Framed streams: sizes that are refused, rows for faults, and one file in many tasks."""

import io

import pytest
from pyspark.sql import functions as F

from leafmill.plans.index import Index
from leafmill.sources import framed, storage


def frame(uri, body, size=None):
    return f"Content-Length: {len(body) if size is None else size}\nContent-Location: {uri}\n\n".encode() + body


@pytest.mark.parametrize("size", ["-45", "0", "99999999999999", "x", "-1"])
def test_bad_sizes(spark, tmp_path, size):
    with pytest.raises(framed.FrameError):
        list(framed.read_frames(io.BytesIO(frame("a", b"body", size))))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "bad").write_bytes(frame("a", b"one") + frame("b", b"two", size) + frame("c", b"three"))
    (tmp_path / "f" / "good").write_bytes(frame("d", b"four"))
    framed.register(spark)
    path = str(tmp_path / "f")
    rows = spark.read.format("framed").load(path).collect()
    assert sorted(str(r["uri"]) for r in rows) == ["None", "a", "d"] and sum(r["error"] is not None and r["content"] is None for r in rows) == 1
    assert framed._complete(f"{path}/bad", 0, 10**6) == 10**6  # ends, and the range that follows gives the row
    split = framed.read_split(framed.frame_offsets(spark, path, split=1)).collect()
    assert sorted(map(str, split)) == sorted(map(str, rows))


def test_stream_goes_on_after_a_fault(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes(frame("a", b"one") + frame("b", b"x", -45))
    (tmp_path / "f" / "b").write_bytes(frame("c", b"two"))
    framed.register(spark)
    q = spark.readStream.format("framed").load(str(tmp_path / "f")).writeStream.format("memory").queryName("faults").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((str(r["uri"]), r["error"] is None) for r in spark.table("faults").collect()) == [("None", False), ("a", True), ("c", True)]


def test_one_file_in_many_tasks(spark, tmp_path):
    bodies = [bytes([i % 250]) * (i * 37 % 400 + 1) + b"\n\nContent-Length: 3\n" for i in range(400)]
    folder = tmp_path / "a b%20"
    folder.mkdir()
    (folder / "one").write_bytes(b"".join(frame(f"u{i}", b) for i, b in enumerate(bodies)) + frame("cut", b"short", 50))
    (folder / "two").write_bytes(frame("only", b"x"))
    (folder / "empty").write_bytes(b"")
    offsets = framed.frame_offsets(spark, str(folder), split=2000)
    ranges = offsets.where(F.col("path").endswith("one")).orderBy("at").collect()
    assert len(ranges) > 20 and ranges[-1]["until"] is None and all(a["until"] == b["at"] for a, b in zip(ranges, ranges[1:]))
    assert all(2000 <= r["until"] - r["at"] < 2600 for r in ranges[:-1])
    read = framed.read_split(offsets)
    rows = read.collect()
    assert {r["uri"]: r["content"] for r in rows if r["uri"]} == {f"u{i}": bytearray(b) for i, b in enumerate(bodies)} | {"only": bytearray(b"x")}
    assert [r["error"] is None for r in rows].count(False) == 1 and "ends early" in next(r["error"] for r in rows if r["error"])
    framed.register(spark)
    plain = spark.read.format("framed").load(str(folder))
    assert plain.exceptAll(read).isEmpty() and read.exceptAll(plain).isEmpty()


def test_faults_are_not_indexed(spark, tmp_path):
    buffers = spark.createDataFrame([(frame("a", b"one") + frame("b", b"x", -1),), (None,), (b"",), (b"junk",)], "b binary")
    docs = framed.frames(buffers, "b").withColumn("parser", F.lit("TXT"))
    assert docs.where("error IS NOT NULL").count() == 2
    index = Index(spark, str(tmp_path / "i"))
    assert index.add(docs) == 1 and [r["uri"] for r in index.tables().search("one").collect()] == ["a"]


def test_schemes():
    assert storage.SCHEMES["s3a"] == "s3"

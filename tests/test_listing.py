"""Listing of folders in many tasks, against a walk on the driver."""

import gzip
import os

import pytest

from leafmill.config import MAX_FILE
from leafmill.sources import listing as L


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "a folder #1"
    for i in range(30):
        folder = root / f"d{i % 5}" / f"_e{i % 3}" / f"f{i}"
        folder.mkdir(parents=True)
        for name in ("x.txt", "_y.xml", ".hidden", "z"):
            (folder / name).write_text(f"{i} {name}")
    (root / ".dots").mkdir()
    (root / ".dots" / "x").write_text("x")
    (root / "empty").write_text("")
    with open(root / "huge", "wb") as f:
        f.truncate(MAX_FILE)
    (root / "packed.txt.gz").write_bytes(gzip.compress(b"inside"))
    (root / "broken.gz").write_bytes(b"no gzip")
    (root / "d0" / "up").symlink_to(root)
    (root / "d0" / "side").symlink_to(root / "d1" / "_e1")
    (root / "d0" / "file").symlink_to(root / "empty")
    (root / "d0" / "nowhere").symlink_to(root / "none")
    os.mkfifo(root / "pipe")
    return str(root)


def walked(path, links):
    out = []
    for name in sorted(os.listdir(path)):
        full = os.path.join(path, name)
        if name.startswith(".") or os.path.islink(full) and not links:
            continue
        if os.path.islink(full) and name == "up":
            continue
        out += walked(full, links) if os.path.isdir(full) else [full]
    return out


@pytest.mark.parametrize("links", [False, True])
@pytest.mark.parametrize("tasks", [1, 4, 1000])
def test_listing_is_a_walk(spark, tree, links, tasks):
    rows = L.listed(spark, tree, links=links, tasks=tasks).collect()
    assert sorted(r["uri"] for r in rows) == sorted(walked(tree, links))
    errors = {os.path.relpath(r["uri"], tree): r["error"] for r in rows if r["error"]}
    want = {"empty": "empty", "huge": f"{MAX_FILE} bytes or more", "pipe": "neither a file nor a folder"}
    if links:
        want |= {"d0/file": "empty", "d0/nowhere": "cannot be read: FileNotFoundError"}
    assert errors == want


def test_contents_and_faults(spark, tree):
    rows = {os.path.relpath(r["uri"], tree): r for r in L.read_listed(L.listed(spark, tree)).collect()}
    assert bytes(rows["packed.txt.gz"]["content"]) == b"inside" and rows["packed.txt.gz"]["mime"] == "text/plain"
    assert rows["broken.gz"]["error"] == "broken or too large inside" and rows["broken.gz"]["content"] is None
    assert rows["empty"]["content"] is None and rows["huge"]["content"] is None
    y = rows["d1/_e1/f1/_y.xml"]
    assert bytes(y["content"]) == b"1 _y.xml" and y["parser"] == "XML" and y["error"] is None and y["size"] == 8
    gone = spark.createDataFrame([(tree + "/gone", 3, 0, None)], L.SCHEMA)
    assert L.read_listed(gone).first()["error"] == "cannot be read: FileNotFoundError"


def test_folders_without_files(spark, tmp_path):
    assert L.listed(spark, str(tmp_path)).collect() == []
    none = L.listed(spark, str(tmp_path / "none")).collect()
    assert [r["error"] for r in none] == ["cannot be listed: FileNotFoundError"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a").write_text("a")
    assert L.listed(spark, str(tmp_path), recursive=False).collect() == []
    assert [r["uri"] for r in L.listed(spark, f"file://{tmp_path}").collect()] == [str(tmp_path / "sub" / "a")]

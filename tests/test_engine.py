"""Backup, change, restore, check, copy, prune: files come back byte by byte."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from chunkmere.model import Config
from chunkmere.plans.engine import Engine
from chunkmere.sources.repository import read_repository
from chunkmere.sources.storage import resolve

SMALL = Config(average_chunk_size=1 << 14, max_chunk_size=1 << 16, min_chunk_size=1 << 12, data_shards=5, parity_shards=2)


def digests(top):
    out = {}
    for folder, _, names in os.walk(top):
        for n in names:
            full = os.path.join(folder, n)
            with open(full, "rb") as f:
                out[os.path.relpath(full, top)] = hashlib.sha256(f.read()).hexdigest()
    return out


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A storage with two revisions of a folder."""
    top = tmp_path_factory.mktemp("world")
    rng = random.Random(5)
    repo = top / "repo"
    (repo / "dir1" / "deep").mkdir(parents=True)
    (repo / "skip").mkdir()
    files = {"file1": 200_000, "file2": 90_000, "dir1/file3": 150_000, "dir1/deep/empty": 0, "skip/no.tmp": 10}
    for n, size in files.items():
        (repo / n).write_bytes(rng.randbytes(size))
    os.symlink("file1", repo / "link")
    engine = Engine.init(spark, str(top / "storage"), SMALL)
    first = engine.backup("repo@host1", str(repo), rules=["-skip/"], tag="one")
    before = digests(repo)
    data = bytearray((repo / "file1").read_bytes())
    data[1000:1100] = rng.randbytes(100)
    (repo / "file1").write_bytes(data)
    os.utime(repo / "file1", (time.time() + 10,) * 2)
    (repo / "new").write_bytes(rng.randbytes(50_000))
    os.remove(repo / "file2")
    second = engine.backup("repo@host1", str(repo), rules=["-skip/"])
    return engine, repo, top, first, second, before


def test_backup_takes_only_what_changed(world):
    _, _, _, first, second, _ = world
    assert first["revision"] == 1 and first["files"] == 4 and first["new_chunks"] == first["chunks"] > 10
    assert second["revision"] == 2 and second["changed_files"] == 2 and 0 < second["new_chunks"] < second["chunks"]


def test_queries_on_snapshots(world):
    engine, repo, *_ = world
    assert [(r.id, r.revision) for r in engine.list(tag="one").collect()] == [("repo@host1", 1)]
    assert {(r.path, r.change) for r in engine.diff("repo@host1", 1, 2).collect()} == {("file1", "*"), ("file2", "-"), ("new", "+")}
    assert [r.changed for r in engine.history("repo@host1", "file1").orderBy("revision").collect()] == [True, True]
    assert engine.cat("repo@host1", "file1") == (repo / "file1").read_bytes()
    assert [r.path for r in engine.files("repo@host1").collect()] == ["file1", "link", "new", "dir1/", "dir1/file3", "dir1/deep/", "dir1/deep/empty"]
    assert engine.check().agg(F.sum("n_missing")).first()[0] == 0
    table = {r.revision: r for r in engine.check(statistics=True).collect()}
    assert table[1].new_chunks == table[1].total_chunks and table[None].total_chunks > table[2].total_chunks
    assert engine.info()["ids"] == ["repo@host1"]
    good = engine.verify()
    assert good.filter("not good").count() == 0 and good.count() > 0 and engine.verify().count() == 0


def test_restore_both_revisions(world):
    engine, repo, top, _, _, before = world
    out = top / "out"
    done = engine.restore("repo@host1", str(out), 1)
    want = {k: v for k, v in before.items() if not k.startswith("skip")}
    assert done["failed"] == [] and digests(out) == want and os.readlink(out / "link") == "file1"
    with pytest.raises(FileExistsError):
        engine.restore("repo@host1", str(out), 2)
    done = engine.restore("repo@host1", str(out), 2, overwrite=True, delete=True)
    assert done["skipped"] >= 2 and done["deleted"] == 1
    assert digests(out) == {k: v for k, v in digests(repo).items() if not k.startswith("skip")}


def test_copy_then_prune(world, spark):
    engine, _, top, *_ = world
    other = Engine.init(spark, str(top / "other"), copy_from=engine)
    assert engine.copy_to(other)["snapshots"] == 2
    assert engine.copy_to(other) == {"snapshots": 0, "copied": 0, "skipped": 0}
    with pytest.raises(ValueError):
        other.prune(revisions={"repo@host1": [2]})
    total = other.chunks.count()
    done = other.prune(revisions={"repo@host1": [1]})
    assert done["deleted_snapshots"] == 1 and done["fossils"] > 0 and other.chunks.filter("state = 'fossil'").count() == done["fossils"]
    # No host has moved on: the fossils stay.
    assert other.prune()["deleted_chunks"] == 0
    other.backup("repo@host1", str(top / "repo"), rules=["-skip/"])
    later = other.prune(now=int(time.time()))
    if not later["deleted_chunks"]:  # within the second of the collection
        time.sleep(2)
        other.backup("repo@host1", str(top / "repo"), rules=["-skip/"])
        later = other.prune()
    assert later["deleted_chunks"] == done["fossils"] and other.chunks.count() == total - done["fossils"]
    assert other.check().agg(F.sum("n_missing")).first()[0] == 0
    exclusive = other.prune(revisions={"repo@host1": [2]}, exclusive=True)
    assert exclusive["deleted_snapshots"] == 1


def test_repository_source_and_urls(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f").write_bytes(b"x")
    os.mkfifo(tmp_path / "pipe")
    got = {r.path: (r.size, r.skip_reason) for r in read_repository(spark, str(tmp_path)).collect()}
    assert got["a/"] == (0, None) and got["a/f"] == (1, None) and got["pipe"][1]
    assert resolve("s3://bucket/x")[1] == "s3a://bucket/x" and resolve("/x")[1] == "file:///x" and not resolve("s3://b")[0].consistent
    with pytest.raises(NotImplementedError):
        resolve("webdav://x")
    with pytest.raises(ValueError):
        resolve("foo://x")


def test_preferences(tmp_path):
    from chunkmere.sources import preferences as pref

    repo = str(tmp_path / "r")
    os.makedirs(repo)
    assert pref.load(repo) == [] and pref.find([]) is None
    a, b = pref.Preference("default", "me", "/s"), pref.Preference("cloud", "me", "s3://x", keys={"k": "v"})
    pref.put(repo, a)
    pref.put(repo, b)
    assert pref.load(repo) == [a, b] and pref.find([a, b]) is a and pref.find([a, b], "s3://x") is b and pref.find([a, b], "?") is None
    b.no_restore = True
    assert pref.put(repo, b) == [a, b]
    other = str(tmp_path / "linked")
    os.makedirs(other)
    with open(os.path.join(other, ".chunkmere"), "w") as f:
        f.write(os.path.join(repo, ".chunkmere"))
    assert pref.load(other) == [a, b]

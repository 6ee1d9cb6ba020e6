"""Encryption, resumption, packing, reuse, and what must hold when commands stop halfway or run beside each other."""

import glob
import os
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_engine import SMALL, digests

from chunkmere.operators.chunking import ChunkStream, cut_points
from chunkmere.plans import engine as module
from chunkmere.plans.engine import Engine, WrongPassword

ID = "repo@host1"


def write(folder, files):
    for name, data in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def missing(engine):
    return engine.check().agg(F.sum("n_missing") + F.sum("n_fossil")).first()[0]


@pytest.mark.parametrize("pack", [False, True])
def test_streamed_chunks_are_those_of_the_whole(pack):
    rng = random.Random(3)
    files = {f"f{i}": rng.randbytes(rng.choice([0, 1, 700, 5000, 40000])) for i in range(25)}
    stream = ChunkStream(1024, 4096, 256, b"seed", pack)
    chunks = []
    for name, data in files.items():
        at = 0
        while at < len(data):
            n = rng.randint(1, 9000)
            chunks += stream.feed(name, data[at : at + n], at + n >= len(data))
            at += n
    chunks += stream.close()
    back = dict.fromkeys(files, b"")
    for content, pieces in chunks:
        for name, number, start, stop, at in pieces:
            assert at == len(back[name]) and (number > 0) == (at > 0)
            back[name] += content[start:stop]
    assert back == files
    streams = [b"".join(files.values())] if pack else list(files.values())
    want = []
    for s in streams:
        ends = cut_points(s, 1024, 4096, 256, b"seed")
        want += [s[a:z] for a, z in zip([0, *ends], ends)]
    assert [c for c, _ in chunks] == want


def test_password_copy_and_damage(spark, tmp_path):
    rng = random.Random(7)
    repo = str(tmp_path / "repo")
    write(repo, {"a": rng.randbytes(120_000), "d/b": b"plain words " * 4000, "empty": b""})
    url = str(tmp_path / "sealed")
    made = Engine.init(spark, url, SMALL, password="first", iterations=100)
    made.backup(ID, repo)
    for bad in (None, "second"):
        with pytest.raises(WrongPassword):
            Engine(spark, url, bad)
    made.change_password("second", 100)
    with pytest.raises(WrongPassword):
        Engine(spark, url, "first")
    held = Engine(spark, url, "second")
    assert held.config == made.config and held.info()["encrypted"]
    for f in glob.glob(f"{url}/c*/**/*", recursive=True):
        if os.path.isfile(f):
            with open(f, "rb") as g:
                data = g.read()
            assert b"plain words" not in data and made.config.chunk_key not in data
    assert held.restore(ID, str(tmp_path / "out"))["failed"] == [] and digests(tmp_path / "out") == digests(repo)
    # Into a storage with other ids, keys and codec, and back by its own password.
    other = Engine.init(spark, str(tmp_path / "other"), copy_from=held, password="x", iterations=100)
    plain = replace(held.config, id_key=b"other", chunk_key=b"", compression_level=201, data_shards=0, parity_shards=0)
    open_ = Engine.init(spark, str(tmp_path / "open"), plain)
    for to in (other, open_):
        assert held.copy_to(to)["copied"] == held.chunks.count() and held.copy_to(to)["snapshots"] == 0
        assert to.chunks.select("chunk_id").join(held.chunks, "chunk_id").count() == 0
        assert to.cat(ID, "d/b") == b"plain words " * 4000 and missing(to) == 0 and to.verify().filter("not good").count() == 0
    good = {r.path: r.good for r in open_.verify_files(ID).collect()}
    assert good == {"a": True, "d/b": True, "empty": True}
    # One chunk's payload is exchanged.
    victim = open_.snapshot(ID).filter("path = 'a'").select(F.col("pieces")[0]["chunk_id"]).first()[0]
    rows = open_.stored.withColumn("payload", F.when(F.col("chunk_id") == victim, F.lit(b"ZSTDjunk")).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(rows, module.CHUNK).write.mode("overwrite").partitionBy("prefix").parquet(f"{open_.path}/chunks")
    assert {r.path: r.good for r in open_.verify_files(ID).collect()} == {"a": False, "d/b": True, "empty": True}
    assert [r.chunk_id for r in open_.verify(again=True).filter("not good").collect()] == [victim]
    assert open_.restore(ID, str(tmp_path / "half"))["failed"] == ["a"] and not os.path.exists(tmp_path / "half" / "a")
    with pytest.raises(ValueError):
        open_.cat(ID, "a")


def test_stopped_backup_goes_on(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    repo = str(tmp_path / "repo")
    write(repo, {f"f{i}": rng.randbytes(30_000) for i in range(12)})
    made = Engine.init(spark, str(tmp_path / "s"), SMALL)
    slices, upload = [], Engine._upload

    def stops(self, *args):
        if len(slices) == 2:
            raise InterruptedError
        slices.append(upload(self, *args))
        return slices[-1]

    monkeypatch.setattr(Engine, "_upload", stops)
    with pytest.raises(InterruptedError):
        made.backup(ID, repo, slice_bytes=90_000)
    monkeypatch.setattr(Engine, "_upload", upload)
    assert made.snapshots.count() == 0 and made.backup(ID, repo, dry_run=True)["resumed_files"] > 0
    held = sum(s["new_chunks"] for s in slices)
    done = made.backup(ID, repo, slice_bytes=90_000)
    assert done["revision"] == 1 and 0 < done["changed_files"] == 12 - done["resumed_files"]
    assert made.chunks.count() == held + done["new_chunks"] and missing(made) == 0 and all(r.good for r in made.verify_files(ID).collect())
    # Stopped before the header: nothing is read or written again.
    write(repo, {"f0": rng.randbytes(30_000)})
    os.utime(f"{repo}/f0", (time.time() + 10,) * 2)
    monkeypatch.setattr(Engine, "_header", lambda self, rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        made.backup(ID, repo)
    monkeypatch.undo()
    done = made.backup(ID, repo)
    assert (done["revision"], done["changed_files"], done["new_chunks"], done["resumed_files"]) == (2, 0, 0, 1)
    assert made.entries.filter("revision = 2").count() == 12 and all(r.good for r in made.verify_files(ID, 2).collect())


def test_small_files_share_chunks(spark, tmp_path):
    rng = random.Random(11)
    repo = str(tmp_path / "repo")
    write(repo, {f"d{i % 3}/f{i}": rng.randbytes(rng.choice([0, 500, 3000, 20_000])) for i in range(60)})
    alone = Engine.init(spark, str(tmp_path / "alone"), SMALL).backup(ID, repo)
    packed = Engine.init(spark, str(tmp_path / "packed"), SMALL)
    assert packed.backup(ID, repo, pack=True)["chunks"] < alone["chunks"]
    assert packed.restore(ID, str(tmp_path / "out"))["failed"] == [] and digests(tmp_path / "out") == digests(repo)
    assert all(r.good for r in packed.verify_files(ID).collect()) and packed.cat(ID, "d0/f0") == open(f"{repo}/d0/f0", "rb").read()


def test_restore_in_place_takes_what_is_there(spark, tmp_path):
    rng = random.Random(13)
    repo, out = str(tmp_path / "repo"), str(tmp_path / "out")
    data = rng.randbytes(400_000)
    write(repo, {"big": data, "x/same": b"s" * 100})
    os.chmod(f"{repo}/big", 0o640)
    try:
        os.setxattr(f"{repo}/big", "user.note", b"kept")
        noted = True
    except OSError:
        noted = False
    made = Engine.init(spark, str(tmp_path / "s"), SMALL)
    made.backup(ID, repo)
    write(out, {"big": b"in front" + data[:200_000] + b"other" + data[200_000:], "extra": b""})
    done = made.restore(ID, out, overwrite=True, delete=True, set_owner=True)
    total = made.snapshot(ID).filter("path = 'big'").select(F.size("pieces")).first()[0]
    assert done["failed"] == [] and 0 < done["reused_chunks"] < total and done["deleted"] == 1 and digests(out) == digests(repo)
    assert os.stat(f"{out}/big").st_mode & 0o777 == 0o640 and (not noted or os.getxattr(f"{out}/big", "user.note") == b"kept")
    write(out, {"big": b"changed", "more": b"1"})
    assert {(r.path, r.change) for r in made.diff(ID, 1, out).collect()} == {("big", "*"), ("more", "+")}


def test_backup_beside_a_collection(spark, tmp_path, monkeypatch):
    """A backup that ends after the collection needs what the collection has as fossils: its own rows stay."""
    rng = random.Random(17)
    repo = str(tmp_path / "repo")
    data = rng.randbytes(100_000)
    made = Engine.init(spark, str(tmp_path / "s"), SMALL)
    write(repo, {"f": data})
    made.backup(ID, repo)
    write(repo, {"f": rng.randbytes(90_000)})
    os.utime(f"{repo}/f", (time.time() + 10,) * 2)
    made.backup(ID, repo)
    fossils = made.prune(revisions={ID: [1]}, now=int(time.time()) - 5)["fossils"]
    assert fossils > 3 and made.list().count() == 1
    # While the fossils wait, their content comes back under another id, in a backup that has no header yet.
    write(str(tmp_path / "second"), {"g": data})
    header = Engine._header
    waiting = []
    monkeypatch.setattr(Engine, "_header", lambda self, rows: waiting.append(rows))
    assert made.backup("second@host1", str(tmp_path / "second"))["new_chunks"] == fossils
    monkeypatch.undo()
    write(repo, {"f": rng.randbytes(80_000)})
    os.utime(f"{repo}/f", (time.time() + 20,) * 2)
    made.backup(ID, repo)
    out = made.prune()
    assert out["deleted_chunks"] == fossils and made.state["collections"] == []
    header(made, waiting[0])
    assert missing(made) == 0 and made.cat("second@host1", "g") == data and made.verify(again=True).filter("not good").count() == 0
    assert made.rows.groupBy("chunk_id").count().filter("count > 1").isEmpty()


def test_commands_that_stop_halfway(spark, tmp_path, monkeypatch):
    rng = random.Random(19)
    repo = str(tmp_path / "repo")
    made = Engine.init(spark, str(tmp_path / "s"), SMALL)
    for k in range(3):
        write(repo, {"f": rng.randbytes(60_000), "g": b"always"})
        os.utime(f"{repo}/f", (time.time() + 10 * k,) * 2)
        made.backup(ID, repo)
    # Stopped before the manifest is saved: nothing has happened.
    change = Engine._change_state
    monkeypatch.setattr(Engine, "_change_state", lambda self, f: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        made.prune(revisions={ID: [1]})
    assert made.list().count() == 3 and missing(made) == 0
    monkeypatch.setattr(Engine, "_change_state", change)
    first = made.prune(revisions={ID: [1]})
    assert first["fossils"] > 0 and made.list().count() == 2 and missing(made) == 0
    # A state file that a crash cut short is passed over, and not written to again.
    with open(f"{tmp_path}/s/state/00000007.json", "w") as f:
        f.write('{"coll')
    assert len(made.state["collections"]) == 1
    # Stopped between the new files and the removal of the old ones, then before the collection is taken off.
    delete = Engine._delete_rows
    monkeypatch.setattr(Engine, "_delete_rows", lambda self, gone: (delete(self, gone), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        made.prune(revisions={ID: [2]}, exclusive=True, now=int(time.time()))
    monkeypatch.undo()
    assert missing(made) == 0 and len(made.state["collections"]) >= 1
    made.prune(exclusive=True)
    assert made.state["collections"] == [] and made._versions("state")[-1] > 7
    assert missing(made) == 0 and made.chunks.join(made.refs.select("chunk_id"), "chunk_id", "left_anti").filter("state = 'chunk'").count() <= 5
    assert made.prune(exhaustive=True, exclusive=True)["deleted_chunks"] >= 0
    assert made.chunks.join(made.refs.select("chunk_id"), "chunk_id", "left_anti").isEmpty() and all(r.good for r in made.verify_files(ID).collect())
    # The number of a deleted revision isn't used again.
    made.prune(revisions={ID: [3]}, exclusive=True)
    assert made.backup(ID, repo)["revision"] == 4


def test_check_brings_fossils_back(spark, tmp_path):
    repo = str(tmp_path / "repo")
    made = Engine.init(spark, str(tmp_path / "s"), SMALL)
    write(repo, {"f": random.Random(2).randbytes(50_000)})
    made.backup(ID, repo, tag="a")
    made.rows.select("chunk_id", "upload", F.lit(1).alias("number")).write.parquet(f"{made.path}/fossils")
    made._change_state(lambda s: {**s, "collections": [{"number": 1, "end_time": 0, "last_revisions": {}, "deleted_revisions": []}]})
    assert made.check(tag="b").count() == 0 and made.check(ID, "a", [1]).first()["n_fossil"] > 0
    made.check(resurrect=True)
    assert missing(made) == 0 and made.chunks.filter("state = 'fossil'").isEmpty()

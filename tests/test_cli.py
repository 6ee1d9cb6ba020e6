"""Commands from init to prune on a folder, by their output, their exit codes and what they leave."""

import json
import os
import time

import pytest

from chunkmere.cli import DAMAGED, FAILED, main
from chunkmere.sources import preferences


@pytest.fixture
def run(spark, tmp_path, capfd):
    """Runs a command; its exit code, its output's rows, and what it logged."""
    (tmp_path / "home").mkdir()

    def one(*arguments, raw=False):
        capfd.readouterr()
        code = main(["--repository", str(tmp_path / "home"), *arguments], spark)
        out, err = capfd.readouterr()
        return code, out if raw else [json.loads(x) for x in out.splitlines()], err

    return one


def small(*arguments):
    return (*arguments, "--chunk-size", "16k")


def test_commands(run, tmp_path):
    home = tmp_path / "home"
    (home / "a.txt").write_text("one\ntwo\nthree\n")
    (home / "big").write_bytes(os.urandom(100_000))
    (home / "x.tmp").write_text("no")
    assert run("backup")[0] == FAILED  # no storage yet
    assert run(*small("init", "me@here", str(tmp_path / "first")))[0] == 0
    assert run(*small("init", "me@here", str(tmp_path / "first")))[0] == FAILED
    (home / ".chunkmere" / "filters").write_text("-*.tmp\n")
    code, _, err = run("backup", "--tag", "t")
    assert code == 0 and json.loads(err.strip().splitlines()[-1])["revision"] == 1
    (home / "a.txt").write_text("one\n2\nthree\n")
    os.utime(home / "a.txt", (time.time() + 10,) * 2)
    assert run("--quiet", "backup")[::2] == (0, "")
    assert [r["revision"] for r in run("list")[1]] == [1, 2]
    assert {r["path"] for r in run("list", "--revision", "1", "--files")[1] if "path" in r} >= {"a.txt", "big"}
    assert not any(r.get("path") == "x.tmp" for r in run("list", "--files")[1])
    assert run("cat", "a.txt", "--revision", "1", raw=True)[1] == "one\ntwo\nthree\n"
    assert "+2" in run("diff", "a.txt", "--revision", "1", "--revision", "2", raw=True)[1].splitlines()
    assert len(run("history", "a.txt")[1]) == 2
    code, rows, _ = run("check", "--files", "--chunks", "--stats")
    assert code == 0 and sum(r.get("n_corrupted", 0) for r in rows) == 0 and any(r.get("n_files") for r in rows)
    assert run("info")[1][0]["ids"] == ["me@here"]
    assert run("restore", "--to", str(tmp_path / "back"), "--revision", "1")[0] == 0
    assert (tmp_path / "back" / "a.txt").read_text() == "one\ntwo\nthree\n"
    code, _, err = run("prune", "--revision", "1", "--exclusive")
    assert code == 0 and json.loads(err.strip().splitlines()[-1])["deleted_snapshots"] == 1
    assert [r["revision"] for r in run("list")[1]] == [2]
    assert run("cat", "missing")[0] == FAILED


def test_second_storage_passwords_and_options(run, tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / "f").write_bytes(os.urandom(30_000))
    assert run(*small("init", "me@here", str(tmp_path / "first")))[0] == 0
    assert run("backup")[0] == 0
    assert run("add", "second", "me@here", str(tmp_path / "second"), "--copy-from", "default", "--encrypt")[0] == FAILED  # no password
    monkeypatch.setenv("CHUNKMERE_PASSWORD_SECOND", "long enough")
    assert run("add", "second", "me@here", str(tmp_path / "second"), "--copy-from", "default", "--encrypt")[0] == 0
    assert run("copy", "--to", "second")[0] == 0
    assert run("list", "--on", "second")[1][0]["revision"] == 1 and run("check", "--on", "second", "--files")[0] == 0
    monkeypatch.setenv("NEW_CHUNKMERE_PASSWORD", "another one")
    assert run("password", "--on", "second")[0] == 0
    assert run("list", "--on", "second")[0] == FAILED
    monkeypatch.delenv("CHUNKMERE_PASSWORD_SECOND")
    assert run("set", "--on", "second", "--key", "password", "--value", "another one", "--no-backup", "yes")[0] == 0
    assert run("list", "--on", "second")[0] == 0 and run("backup", "--on", "second")[0] == FAILED
    held = preferences.find(preferences.load(str(home)), "second")
    assert held.no_backup and held.encrypted and not held.no_restore
    assert run("--suppress", "FAILED", "backup", "--on", "second")[2] == ""


def test_check_tells_of_damage(run, spark, tmp_path):
    from chunkmere.plans.engine import Engine

    (tmp_path / "home" / "f").write_bytes(os.urandom(30_000))
    (tmp_path / "home" / "g").write_bytes(b"g" * 10)
    assert run(*small("init", "me@here", str(tmp_path / "first")))[0] == 0 and run("backup")[0] == 0
    engine = Engine(spark, str(tmp_path / "first"))
    gone = engine.refs.filter("path = 'f'").select("chunk_id").limit(1)
    engine._delete_rows(engine.stored.join(gone, "chunk_id", "left_semi"))
    code, rows, _ = run("check", "--files")
    assert code == DAMAGED and rows[0]["n_missing"] == 1 and (rows[-1]["n_files"], rows[-1]["n_corrupted"]) == (2, 1)


def test_wrong_arguments(run):
    for wrong in (["nothing"], ["init", "id"], ["init", "id", "url", "--chunk-size", "big"], ["set", "--no-backup", "perhaps"]):
        with pytest.raises(SystemExit) as e:
            run(*wrong)
        assert e.value.code == 2

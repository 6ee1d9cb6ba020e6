"""The command line: one subcommand a method of ``Engine``, for the storages that a repository's options name.

Results go to the output, a row a line as JSON; what happens is logged to the error stream, each
message under an id that ``--suppress`` can silence (H1).  The exit code is 0, 1 if a check found
damage, 2 for wrong arguments, 3 for a command that couldn't be carried out (H2).
"""

from __future__ import annotations

import argparse
import getpass
import json
import logging
import os
import sys
from collections.abc import Iterator
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from chunkmere.functions.formats import parse_erasure, parse_revisions, parse_size
from chunkmere.model import Config
from chunkmere.plans.engine import Engine
from chunkmere.session import session
from chunkmere.sources import preferences
from chunkmere.sources.repository import OWN_FOLDER

DAMAGED, FAILED = 1, 3
ENVIRONMENT = "CHUNKMERE_PASSWORD"
log = logging.getLogger("chunkmere")


def _say(name: str, text: str, level: int = logging.INFO) -> None:
    log.log(level, text, extra={"message_id": name})


def _start_log(a: argparse.Namespace) -> logging.Handler:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message_id)s %(message)s" if a.log else "%(message)s", defaults={"message_id": "-"}))
    handler.addFilter(lambda r: getattr(r, "message_id", "") not in a.suppress)
    log.addHandler(handler)
    log.setLevel(logging.WARNING if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    return handler


def _size(text: str) -> int:
    n = parse_size(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text!r} isn't a size")
    return n


def _yes_or_no(text: str) -> bool:
    if text not in ("yes", "no"):
        raise argparse.ArgumentTypeError("yes or no")
    return text == "yes"


def _revisions(texts: list[str]) -> list[int] | None:
    return parse_revisions(texts) or None


def _password(preference: preferences.Preference, ask: str = "Storage password: ") -> str:
    """From the environment (the storage's own variable, then the common one), the saved options, or a prompt (H3)."""
    own = f"{ENVIRONMENT}_{preference.name.upper().replace('-', '_')}"
    for held in (os.environ.get(own), os.environ.get(ENVIRONMENT), preference.keys.get("password")):
        if held:
            return held
    if not sys.stdin.isatty():
        raise ValueError(f"{preference.name} needs a password: set {own} or {ENVIRONMENT}")
    return getpass.getpass(ask)


class _Job:
    """A command's arguments, repository and session."""

    def __init__(self, a: argparse.Namespace, spark: SparkSession):
        self.a, self.spark, self.top = a, spark, os.path.abspath(a.repository)

    def preference(self, name: str = "") -> preferences.Preference:
        found = preferences.find(preferences.load(self.top), name)
        if found is None:
            raise ValueError(f"{self.top} has no storage {name}".rstrip())
        return found

    def engine(self, name: str = "") -> Engine:
        p = self.preference(name)
        return Engine(self.spark, p.storage, _password(p) if p.encrypted else None)

    def rules(self, p: preferences.Preference) -> list[str]:
        """Those given, else those of the filter file (P5)."""
        file = p.filters or os.path.join(self.top, OWN_FOLDER, "filters")
        return self.a.rule or ([f"@{os.path.abspath(file)}"] if os.path.exists(file) else [])


def _show(rows: DataFrame) -> Iterator[Row]:
    """Print rows as they come; partitions are fetched one at a time."""
    for r in rows.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x)))
        yield r


def _all(rows: DataFrame) -> int:
    return sum(1 for _ in _show(rows))


def _init(j: _Job) -> int:
    """The first storage of a repository; ``add`` gives it another."""
    a = j.a
    held = preferences.load(j.top)
    name = a.name if a.command == "add" else "default"
    if a.command == "init" and held:
        raise ValueError(f"{j.top} is initialised; use add")
    if any(p.name == name for p in held):
        raise ValueError(f"there is a storage {name}")
    source = j.engine(a.copy_from) if a.copy_from else None
    average = a.chunk_size
    config = replace(
        Config(), average_chunk_size=average, max_chunk_size=a.max_chunk_size or 4 * average, min_chunk_size=a.min_chunk_size or average // 4, compression_level=a.compression,
        **dict(zip(("data_shards", "parity_shards"), parse_erasure(a.erasure))) if a.erasure else {},
    )
    p = preferences.Preference(name, a.id, a.storage, encrypted=a.encrypt)
    password = _password(p, "New storage password: ") if a.encrypt else None
    try:
        Engine(j.spark, a.storage, password)
        _say("STORAGE_HELD", f"{a.storage} holds a storage already; it is used as it is")
    except FileNotFoundError:
        Engine.init(j.spark, a.storage, None if source else config, source, password, bit_identical=a.bit_identical)
    preferences.put(j.top, p)
    _say("STORAGE_READY", f"{j.top} is backed up to {a.storage} as {a.id}")
    return 0


def _backup(j: _Job) -> int:
    a, p = j.a, j.preference(j.a.on)
    if p.no_backup:
        raise ValueError(f"backups to {p.name} are switched off")
    out = j.engine(a.on).backup(p.id, j.top, j.rules(p), a.tag, p.nobackup_file, p.exclude_by_attribute, a.hash, a.pack, a.dry_run)
    _say("BACKUP_DONE", json.dumps(out))
    return 0


def _restore(j: _Job) -> int:
    a, p = j.a, j.preference(j.a.on)
    if p.no_restore:
        raise ValueError(f"restores from {p.name} are switched off")
    out = j.engine(a.on).restore(a.id or p.id, a.to or j.top, a.revision, a.rule or None, a.overwrite, a.delete, a.owner, not a.no_reuse)
    _say("RESTORE_DONE", json.dumps(out, default=str))
    return 0


def _ids(j: _Job) -> str | None:
    return None if j.a.all else j.a.id or j.preference(j.a.on).id


def _list(j: _Job) -> int:
    a, engine = j.a, j.engine(j.a.on)
    chosen = engine.list(_ids(j), a.tag, _revisions(a.revision))
    _all(chosen)
    keys = chosen.select("id", "revision")
    if a.files:
        _all(engine.entries.join(keys, ["id", "revision"], "left_semi").select("id", "revision", "path", "size", "time", "hash").orderBy("id", "revision", "path"))
    if a.chunks:
        _all(engine.refs.join(keys, ["id", "revision"], "left_semi").select("id", "revision", "chunk_id").distinct().orderBy("id", "revision", "chunk_id"))
    return 0


def _check(j: _Job) -> int:
    a, engine, bad = j.a, j.engine(j.a.on), 0
    which = (_ids(j), a.tag, _revisions(a.revision))
    for r in _show(engine.check(*which, resurrect=a.resurrect)):
        bad += r.n_missing + (0 if a.fossils else r.n_fossil)
    if a.stats:
        _all(engine.check(*which, statistics=True))
    if a.files:
        for s in engine.list(*which).select("id", "revision").toLocalIterator():
            found = engine.damage(s.id, s.revision).first()
            bad += found.n_corrupted
            print(json.dumps({"id": s.id, "revision": s.revision, **found.asDict()}))
    if a.chunks:
        found = engine.verify(a.again).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum((~F.col("good")).cast("long")), F.lit(0)).alias("n_corrupted"))
        bad += sum(r.n_corrupted for r in _show(found))
    _say("CHECK_DONE", f"{bad} missing or damaged" if bad else "all there", logging.ERROR if bad else logging.INFO)
    return DAMAGED if bad else 0


def _cat(j: _Job) -> int:
    a, engine, id_ = j.a, j.engine(j.a.on), j.a.id or j.preference(j.a.on).id
    if a.path is None:
        _all(engine.list(id_, None, [a.revision] if a.revision else None))
        return 0
    sys.stdout.flush()
    sys.stdout.buffer.write(engine.cat(id_, a.path, a.revision))
    sys.stdout.buffer.flush()
    return 0


def _diff(j: _Job) -> int:
    a, engine, id_ = j.a, j.engine(j.a.on), j.a.id or j.preference(j.a.on).id
    if len(a.revision) > 2 or not a.revision:
        raise ValueError("one or two revisions are compared")
    if a.path:
        if len(a.revision) < 2:
            raise ValueError("two revisions of a file are compared")
        print("\n".join(engine.diff_file(id_, a.path, *a.revision)))
    else:
        _all(engine.diff(id_, a.revision[0], a.revision[1] if len(a.revision) > 1 else j.top))
    return 0


def _history(j: _Job) -> int:
    _all(j.engine(j.a.on).history(j.a.id or j.preference(j.a.on).id, j.a.path))
    return 0


def _prune(j: _Job) -> int:
    a, id_ = j.a, _ids(j)
    revisions = _revisions(a.revision)
    if revisions and id_ is None:
        raise ValueError("revisions are pruned of one id")
    out = j.engine(a.on).prune(
        a.keep or None, a.tag or None, {id_: revisions} if revisions else None, a.exhaustive, a.exclusive, a.ignore or None, None, a.dry_run, a.collect_only, a.delete_only, [id_] if id_ else None
    )
    _say("PRUNE_DONE", json.dumps(out))
    return 0


def _change_password(j: _Job) -> int:
    p = j.preference(j.a.on)
    new = os.environ.get(f"NEW_{ENVIRONMENT}") or getpass.getpass("New storage password: ")
    j.engine(j.a.on).change_password(new)
    if "password" in p.keys:
        preferences.put(j.top, replace(p, keys={**p.keys, "password": new}))
    _say("PASSWORD_CHANGED", f"{p.name} has a new password")
    return 0


def _set(j: _Job) -> int:
    """Options that aren't given stay as they are (H8)."""
    a, p = j.a, j.preference(j.a.on)
    given = {k: v for k in ("encrypted", "no_backup", "no_restore", "nobackup_file", "exclude_by_attribute", "filters") if (v := getattr(a, k)) is not None}
    keys = dict(p.keys)
    if a.key:
        keys.pop(a.key, None)
        if a.value:
            keys[a.key] = a.value
    preferences.put(j.top, replace(p, **given, keys=keys))
    return 0


def _info(j: _Job) -> int:
    print(json.dumps(j.engine(j.a.on).info()))
    return 0


def _copy(j: _Job) -> int:
    a = j.a
    out = j.engine(a.source).copy_to(j.engine(a.target), a.id or None, _revisions(a.revision))
    _say("COPY_DONE", json.dumps(out))
    return 0


def _benchmark(j: _Job) -> int:
    print(json.dumps(j.engine(j.a.on).benchmark(j.a.size)))
    return 0


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("chunkmere", description=__doc__.splitlines()[0])
    top.add_argument("--repository", default=".", help="the folder that is backed up")
    top.add_argument("--master", help="Spark's master; by default what spark-submit says")
    top.add_argument("--log", action="store_true", help="times, levels and ids of messages")
    top.add_argument("--quiet", action="store_true")
    top.add_argument("--verbose", action="store_true")
    top.add_argument("--suppress", action="append", default=[], metavar="ID")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, on: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        p.set_defaults(run=run)
        if on:
            p.add_argument("--on", default="", metavar="STORAGE", help="the storage's name; by default the first")
        return p

    def which(p: argparse.ArgumentParser, several: bool = True) -> None:
        p.add_argument("--id", default="")
        if several:
            p.add_argument("--all", action="store_true", help="every id")
            p.add_argument("--revision", action="append", default=[], help="a number or a range a-b")

    def flags(p: argparse.ArgumentParser, *names: str) -> None:
        for n in names:
            p.add_argument(f"--{n}", action="store_true")

    for name in ("init", "add"):
        p = command(name, _init, on=False)
        if name == "add":
            p.add_argument("name")
        p.add_argument("id")
        p.add_argument("storage", help="folder or URL")
        flags(p, "encrypt", "bit-identical")
        p.add_argument("--copy-from", default="", metavar="STORAGE", help="take chunk sizes and seeds from it")
        p.add_argument("--chunk-size", type=_size, default=4 << 20)
        p.add_argument("--max-chunk-size", type=_size)
        p.add_argument("--min-chunk-size", type=_size)
        p.add_argument("--compression", type=int, default=Config.compression_level)
        p.add_argument("--erasure", metavar="DATA:PARITY")
    p = command("backup", _backup)
    p.add_argument("--tag", default="")
    p.add_argument("--rule", action="append", default=[])
    flags(p, "hash", "pack", "dry-run")
    p = command("restore", _restore)
    which(p, several=False)
    p.add_argument("--revision", type=int)
    p.add_argument("--to", default="", help="another folder than the repository")
    p.add_argument("--rule", action="append", default=[])
    flags(p, "overwrite", "delete", "owner", "no-reuse")
    p = command("list", _list)
    which(p)
    p.add_argument("--tag")
    flags(p, "files", "chunks")
    p = command("check", _check)
    which(p)
    p.add_argument("--tag")
    flags(p, "stats", "fossils", "resurrect", "files", "chunks", "again")
    for name, run in (("cat", _cat), ("diff", _diff), ("history", _history)):
        p = command(name, run)
        which(p, several=False)
        if name != "history":
            p.add_argument("--revision", type=int, **{"action": "append", "default": []} if name == "diff" else {})
        p.add_argument("path", nargs=None if name == "history" else "?")
    p = command("prune", _prune)
    which(p)
    p.add_argument("--keep", action="append", default=[], metavar="INTERVAL:AGE")
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("--ignore", action="append", default=[], metavar="ID")
    flags(p, "exhaustive", "exclusive", "dry-run", "collect-only", "delete-only")
    command("password", _change_password)
    p = command("set", _set)
    for name, to in (("encrypt", "encrypted"), ("no-backup", "no_backup"), ("no-restore", "no_restore"), ("exclude-by-attribute", "exclude_by_attribute")):
        p.add_argument(f"--{name}", dest=to, type=_yes_or_no, metavar="yes|no")
    p.add_argument("--nobackup-file")
    p.add_argument("--filters")
    p.add_argument("--key")
    p.add_argument("--value", help="without one the key goes")
    command("info", _info)
    p = command("copy", _copy, on=False)
    p.add_argument("--id", default="")
    p.add_argument("--revision", action="append", default=[])
    p.add_argument("--from", dest="source", default="")
    p.add_argument("--to", dest="target", required=True)
    p = command("benchmark", _benchmark)
    p.add_argument("--size", type=_size, default=64 << 20)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; its exit code."""
    a = _parser().parse_args(arguments)
    handler = _start_log(a)
    try:
        return a.run(_Job(a, spark or session(a.master, spark__ui__showConsoleProgress="false")))
    except (ValueError, OSError, PySparkException) as e:
        _say("FAILED", str(e).split("\n")[0] or type(e).__name__, logging.ERROR)
        return FAILED
    finally:
        log.removeHandler(handler)

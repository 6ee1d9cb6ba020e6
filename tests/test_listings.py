"""Listings in JSON and in records: what is written comes back, and what is damaged ends the job."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from chunkmere.model import MODE_DIR, MODE_LINK
from chunkmere.sources import listings

ROWS = [
    ("a/" + "long" * 80, 5, 1_700_000_000, 0o644, "", "ab" * 32, 0, 3, 0, 8, 1000, 70_000, {"user.x": b"\x00\xff", "user.a": b""}),
    ("b é", 1 << 40, -5, 0o644, "", "cd" * 32, 0, 8, 300, 1 << 33, -1, -1, None),
    ("c/", 0, 1, MODE_DIR | 0o755, "", "", 0, 0, 0, 0, 0, 0, None),
    ("link", 0, -40_000, MODE_LINK, "b", "", 0, 0, 0, 0, -200, 40, {}),
    ("empty", 0, 0, 0, "", "", 1, 0, 0, 0, 1, 1, None),
]


def key(r):
    d = r.asDict()
    return {k: (None if not v else {a: bytes(b) for a, b in v.items()}) if k == "attributes" else v for k, v in d.items() if k not in ("id", "file")}


def entries(spark):
    return spark.createDataFrame(ROWS, listings.LISTED)


def test_integers_take_their_shortest_form():
    sizes = {0: 1, 127: 1, 128: 2, 255: 2, 256: 3, 65535: 3, 65536: 5, 2**32 - 1: 5, 2**32: 9, 2**63 - 1: 9, -1: 1, -32: 1, -33: 2, -128: 2, -129: 3, -32769: 5, -(2**31) - 1: 9}
    for n, size in sizes.items():
        raw = listings._int(n)
        stream = listings._Records()
        stream.data = raw
        assert len(raw) == size and stream._int() == n and stream.at == size
    for n in (0, 31, 32, 255, 256, 65535, 65536):
        stream = listings._Records()
        stream.data = listings._text(b"x" * n)
        assert stream._bytes() == b"x" * n


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_records_in_parts_of_any_length(spark, size):
    held = entries(spark).coalesce(1).select(listings.entry_record(F.struct(*listings.RECORD, "attributes")).alias("r")).collect()
    whole = b"".join(bytes(r.r) for r in held)
    parts = [(i, k, bytearray(whole[k : k + size])) for i in ("one", "two") for k in range(0, len(whole), size)]
    found = listings.read_records(spark.createDataFrame(parts, "id string, seq int, content binary")).collect()
    want, last = [], 0
    for row in entries(spark).collect():
        d = key(row)
        if not d["mode"] & (MODE_DIR | MODE_LINK):
            d["start_chunk"] += last
            last = d["end_chunk"] = d["end_chunk"] + d["start_chunk"]
        want.append(d)
    for i in ("one", "two"):
        assert [key(r) for r in found if r.id == i] == want
    short = spark.createDataFrame([("one", 0, bytearray(whole[:-1]))], "id string, seq int, content binary")
    with pytest.raises(Exception, match="ends within a record"):
        listings.read_records(short).collect()
    assert listings.read_records(short.limit(0)).count() == 0


def test_json_lists(spark, tmp_path):
    made = [json.loads(r.j) for r in entries(spark).select(listings.entry_json().alias("j")).collect()]
    assert made[0]["content"] == "0:3:0:8" and base64.b64decode(made[1]["name"]).decode() == "b é"
    assert "content" not in made[2] and "uid" not in made[1] and "link" not in made[0]
    (tmp_path / "one").write_text(json.dumps(made))
    (tmp_path / "two").write_text(json.dumps([{"path": "plain", "size": 0, "time": 1, "mode": 0, "hash": ""}]))
    (tmp_path / "three").write_text("[]")
    found = listings.read_json_lists(spark, str(tmp_path)).collect()
    want = {r.path: key(r) for r in entries(spark).collect()} | {"plain": {**dict.fromkeys(listings.RECORD, 0), "path": "plain", "time": 1, "link": "", "hash": "", "uid": -1, "gid": -1, "attributes": None}}
    want["empty"]["start_chunk"] = 0  # no range without bytes
    assert {r.path: key(r) for r in found} == want
    assert {r.file.rsplit("/", 1)[1] for r in found} == {"one", "two"}


@pytest.mark.parametrize("wrong", [{"size": None}, {"content": "1:2:3"}, {"name": "%%%"}, {"hash": None}])
def test_json_entries_that_lack_something(spark, tmp_path, wrong):
    good = {"name": base64.b64encode(b"x").decode(), "size": 4, "time": 1, "mode": 0, "hash": "h", "content": "0:0:0:4"}
    (tmp_path / "list").write_text(json.dumps([good, {k: v for k, v in (good | wrong).items() if v is not None}]))
    with pytest.raises(Exception):
        listings.read_json_lists(spark, str(tmp_path / "list")).collect()

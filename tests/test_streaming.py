"""Streams give what tables give, and hosts report once."""

import pytest
from pyspark.sql import functions as F

from chunkmere.model import DAY
from chunkmere.streaming import progress, windows

SF = "/root/testdata/sf0.001"


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    table = spark.read.parquet(str(tmp_path / "events"))
    return table, spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))


def test_windows_on_a_stream(spark, events):
    table, stream = events
    for k, f in enumerate((lambda e: windows.tumbling(e, "1 hour"), lambda e: windows.tumbling(e, "1 hour", "30 minutes"))):
        assert {tuple(r) for r in drain(spark, f(stream), f"w{k}", "complete").collect()} == {tuple(r) for r in f(table).collect()}
    assert drain(spark, windows.without_repeats(stream.union(stream)), "once").count() == table.count()
    closed = {tuple(r) for r in drain(spark, windows.sessions(stream, "1 hour"), "s").collect()}
    assert closed and closed <= {tuple(r) for r in windows.sessions(table, "1 hour").collect()}


def test_hosts_report_once(spark, tmp_path):
    day0 = 20_000
    rows = [[("a@h1", day0), ("b@h2", day0)], [("a@h1", day0 + 2), ("c", day0 + 2)], [("d@h1", day0 + 3)], [("e@h3", day0 + 30)], [("e@h3", day0 + 31)]]
    path = str(tmp_path / "headers")
    for k, part in enumerate(rows):
        spark.createDataFrame([(i, d * DAY) for i, d in part], "id string, end_time long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id string, end_time long").option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.host, r.reason) for r in drain(spark, progress.host_progress(stream, (day0 + 1) * DAY), "hosts").collect()}
    assert ("h1", "progressed") in got and ("h3", "progressed") in got and ("c", "progressed") in got
    assert ("h2", "dormant") in got and len([g for g in got if g[0] == "h1"]) == 1


def test_new_chunks_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "refs")
    df = spark.range(50).select((F.col("id") % 7).cast("string").alias("chunk_id"), F.timestamp_seconds(F.col("id")).alias("at"))
    df.write.parquet(path)
    got = drain(spark, progress.new_chunks(spark.readStream.schema(df.schema).parquet(path)), "chunks")
    assert got.count() == 7

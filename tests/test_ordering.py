"""Running sums and neighbours against a plain loop: groups of every size, over several parts each."""

import random

import pytest
from pyspark.sql import functions as F

from chunkmere.operators import chunking
from chunkmere.operators.ordering import in_order


def made(spark, groups, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), i, rng.randint(0, 9), rng.choice([None, *range(4)])) for i in range(600)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, w long, v long").repartition(5)


def plain(rows):
    out, total, last = {}, {}, {}
    for g, k, w, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out[k] = (total.get(g, 0), last.get(g))
        total[g], last[g] = total.get(g, 0) + w, v
    return out


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None, ""], [f"g{i}" for i in range(300)], ["a"] * 50 + ["b", "c"]])
def test_sums_and_neighbours_in_groups(spark, groups):
    rows, df = made(spark, groups)
    got = {r.k: (r.before, r.previous) for r in in_order(df, ["k"], F.col("w"), ["g"], lag="v").collect()}
    assert got == plain(rows)


def test_sums_without_groups(spark):
    rows, df = made(spark, ["a", "b"])
    out = in_order(df, ["k"], F.col("w"))
    assert out.columns == [*df.columns, "before"]
    assert {r.k: r.before for r in out.collect()} == {k: b for k, (b, _) in plain([("x", k, w, v) for _, k, w, v in rows]).items()}
    assert in_order(df.limit(0), ["k"], F.col("w"), ["g"], lag="v").count() == 0


def test_numbers_offsets_and_files(spark):
    rows, df = made(spark, ["a"] * 9 + ["b"])
    numbers, now = {}, {}
    for g, k, _, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n, last = now.get(g, (-1, "none"))
        now[g] = (n + (last == "none" or last != v), v)
        numbers[k] = now[g][0]
    assert {r.k: r.number for r in chunking.dense_numbers(df, ["g"], ["k"], "v").collect()} == numbers
    assert {r.k: (r.begin, r.end) for r in chunking.running_offsets(df, ["g"], ["k"], "w").collect()} == {k: (b, b + w) for (k, (b, _)), w in zip(sorted(plain(rows).items()), [r[2] for r in sorted(rows, key=lambda r: r[1])])}

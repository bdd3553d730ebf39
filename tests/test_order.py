"""Running totals against a walk over the sorted rows."""

import random

from pyspark.sql import functions as F

from stonefold.operators import namespace
from stonefold.operators.order import running
from stonefold.streaming import operators as streams


def test_running_totals_equal_a_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(50), None]), rng.choice([None, rng.randrange(100)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a int, v long").repartition(5)
    got = running(df, [F.col("a").desc(), F.col("id")], sums={"before": "v"}, highest={"top": F.col("v")}).collect()
    want, before, top = {}, 0, None
    for place, (i, a, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        if v is not None:
            top = v if top is None else max(top, v)
        want[i] = (i, a, v, place, before, top)
        before += v or 0
    assert sorted(map(tuple, got)) == sorted(want.values())
    assert running(df.limit(0), [F.col("id")], sums={"before": "v"}).collect() == []


def test_quiet_limit_is_the_nearest_rank_of_repeated_values(spark):
    values = [1.0] * 94 + [5.0] * 6
    rows = [(f"2024-01-01 00:00:{i % 60:02d}", v) for i, v in enumerate(values)] + [("2024-01-01 01:00:00", 5.0), ("2024-01-01 02:00:00", 5.1)]
    samples = spark.createDataFrame(rows, "ts string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    assert [r.quiet for r in streams.quiet_windows(samples, 3600, 1, 1.0).orderBy("start").collect()] == [True, False]


def test_children_are_numbered_without_holes(spark):
    entries = spark.createDataFrame([(1, "a", 3, 2), (2, "b", 9, 4)], "dir long, name string, cookie long, child long")
    inodes = spark.createDataFrame([(1,), (2,), (4,)], "ino long")
    asked = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (2, "x"), (5, "y")], "dir long, name string").selectExpr("*", "'f' AS kind", "420L AS mode", "CAST(NULL AS STRING) AS target")
    got = {(r.dir, r.name): (r.child, r.cookie, r.error) for r in namespace.children(entries, inodes, asked).collect()}
    assert got == {(1, "a"): (None, None, "Exists"), (1, "b"): (5, 4, None), (1, "c"): (6, 5, None), (2, "x"): (7, 10, None), (5, "y"): (8, 1, None)}

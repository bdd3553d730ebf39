from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stonefold.streaming import operators as s

T0 = datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp, key long, op string, value double"


def ops(rows):
    return [(i, T0 + timedelta(seconds=t), k, op, float(i)) for i, (t, k, op) in enumerate(rows)]


def as_stream(spark, tmp_path, rows, name="in"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_flush_commits_the_last_write_once(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = as_stream(spark, tmp_path, ops([(0, 1, "w"), (1, 1, "w"), (2, 2, "w")]))
    s.flush(stream, out, check).awaitTermination()
    s.flush(stream, out, check).awaitTermination()  # nothing new
    as_stream(spark, tmp_path, ops([(9, 3, "w")]))
    s.flush(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), out, check).awaitTermination()
    rows = sorted((r.batch, r.key, r.value, r.writes) for r in spark.read.parquet(out).collect())
    assert rows == [(0, 1, 1.0, 2), (0, 2, 2.0, 1), (1, 3, 0.0, 1)]


def test_replays_are_answered_once(spark, tmp_path):
    stream = as_stream(spark, tmp_path, ops([(0, 1, "r"), (5, 1, "r"), (6, 2, "r"), (7, 1, "q")]))
    rows = run(s.replay_dedup(stream, ["key", "op"], "ts", "10 minutes"), "replays")
    assert sorted((r.key, r.op) for r in rows) == [(1, "q"), (1, "r"), (2, "r")]


def test_windows_over_a_stream(spark, tmp_path):
    stream = as_stream(spark, tmp_path, ops([(0, 1, "v"), (4, 1, "v"), (5, 1, "v"), (60, 1, "v")]))
    rows = run(s.sampled(stream.withWatermark("ts", "1 second"), 5), "windows", "complete")
    assert sorted(r.n for r in rows) == [1, 1, 2]


def test_elision_over_a_stream(spark, tmp_path):
    # else timeouts keep a query that reads what is there from ending
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = as_stream(spark, tmp_path, ops([(0, 1, "create"), (1, 1, "write"), (2, 1, "unlink"), (3, 2, "write"), (4, 3, "write"), (5, 3, "unlink")]))
    rows = run(s.elided_stream(stream, "create", "unlink", 60_000), "elided")
    assert sorted((r.key, r.op) for r in rows) == [(2, "write"), (3, "unlink"), (3, "write")]


def test_access_times(spark, tmp_path):
    stream = as_stream(spark, tmp_path, ops([(0, 1, "v"), (9, 1, "v"), (3, 2, "v")])).withColumnRenamed("key", "id")
    rows = run(s.access_times(stream), "access", "complete")
    assert sorted((r.id, r["last"]) for r in rows) == [(1, T0 + timedelta(seconds=9)), (2, T0 + timedelta(seconds=3))]


def test_batch_and_stream_elide_alike(spark):
    df = spark.createDataFrame(ops([(0, 1, "create"), (1, 1, "unlink"), (2, 2, "create")]), SCHEMA)
    assert [r.key for r in s.elided(df, "create", "unlink").select(F.col("key")).collect()] == [2]


def cached(spark, rows, **bounds):
    """States of the calls among rows (second, conn, xid, kind, size) of one client."""
    events = [(1, c, x, "p", k, n, T0 + timedelta(seconds=t), i) for i, (t, c, x, k, n) in enumerate(rows)]
    df = spark.createDataFrame(events, "client long, conn long, xid long, print string, kind string, size long, ts timestamp, seq long")
    found = s.reply_cache(df, bounds.get("seconds", 60), bounds.get("entries", 9), bounds.get("size", 99))
    return [r.state for r in sorted(found.collect(), key=lambda r: r.seq)]


def test_calls_under_way_answered_and_forgotten(spark):
    call, reply = (lambda t, x, c=1: (t, c, x, "call", None)), (lambda t, x, n=1, c=1: (t, c, x, "reply", n))
    assert cached(spark, [call(0, 1), call(1, 1), reply(2, 1), call(3, 1)]) == ["new", "in_progress", "replay"]
    assert cached(spark, [call(0, 1), reply(1, 1, None), call(2, 1)]) == ["new", "new"]
    # the age counts from the reply, and replays do not renew it
    assert cached(spark, [call(0, 1), reply(50, 1), call(100, 1), call(110, 1)]) == ["new", "replay", "new"]
    # first in, first out, by number and by bytes
    assert cached(spark, [call(0, 1), reply(0, 1), call(1, 2), reply(1, 2), call(2, 1), call(2, 2)], entries=1) == ["new", "new", "new", "new"]
    assert cached(spark, [call(0, 1), reply(0, 1, 60), call(1, 2), reply(1, 2, 60), call(2, 2), call(2, 1)]) == ["new", "new", "replay", "new"]
    # another connection repeats a call only until the first one moves on
    assert cached(spark, [call(0, 1), reply(1, 1), call(2, 1, 2)]) == ["new", "replay"]
    assert cached(spark, [call(0, 1), reply(1, 1), call(2, 2), call(3, 1, 2)]) == ["new", "new", "new"]


def test_commits_by_age_number_and_bytes(spark):
    def batches(rows, **bounds):
        df = spark.createDataFrame([(1, i, T0 + timedelta(milliseconds=t), n) for i, (t, n) in enumerate(rows)], "key long, seq long, ts timestamp, size long")
        found = s.commit_batches(df, 250, 500, bounds.get("most", 9), bounds.get("dirty", 99))
        return [r.batch for r in sorted(found.collect(), key=lambda r: r.seq)]

    assert batches([(10, 1), (500, 1), (749, 1), (750, 1)]) == [0, 0, 0, 1]
    assert batches([(10, 1), (20, 1), (240, 1), (250, 1)], most=3) == [0, 0, 0, 1]
    assert batches([(10, 60), (20, 60), (30, None)]) == [0, 0, 1]
    assert batches([]) == []

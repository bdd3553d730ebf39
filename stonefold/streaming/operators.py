"""Continuous operators over operation streams; each also runs on a batch table."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from stonefold.operators.base import sql
from stonefold.operators.order import running


def coalesced(ops: DataFrame) -> DataFrame:
    """The last operation of each key and kind: a later write replaces an earlier one that waits."""
    return ops.groupBy("key", "op").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count("*").alias("writes"))


def elided(ops: DataFrame, create: str, unlink: str) -> DataFrame:
    """Operations of a batch without those of keys that are created and then removed in it: nothing of them is committed."""
    return sql(
        f"""SELECT o.* FROM {{o}} o LEFT ANTI JOIN (SELECT key FROM {{o}} GROUP BY key HAVING min(seq) FILTER (WHERE op = '{create}') = min(seq) AND max(seq) FILTER (WHERE op = '{unlink}') = max(seq)) d ON o.key = d.key""",
        o=ops,
    )


def replayed(ops: DataFrame, seconds: int) -> DataFrame:
    """Requests (key, op, ts, seq) as new, or as a replay of an equal one answered less than so long before.

    An answer's age counts from the request that made it: replays do not renew
    it, so a chain of retries ends. Each key's requests are read in order, in
    bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, 0
        for batch in batches:
            out = []
            for key, op, at in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                fresh = (key, op) == now and at - made < seconds * 1_000_000
                if not fresh:
                    now, made = (key, op), at
                out.append("replay" if fresh else "new")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], names=["key", "op", "seq", "ts", "state"])

    rows = ops.select("key", "op", "seq", "ts", F.unix_micros("ts").alias("at"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:4])
    return rows.repartition("key", "op").sortWithinPartitions("key", "op", "at", "seq").mapInArrow(run, f"{schema}, state string")


class ReplyCache:
    """One client's calls under way and answered: first in, first out, bounded by age, number and bytes of replies.

    The age of an entry counts from its call, and again from its reply. An equal
    call of another connection is a retransmission only while the connection
    that made the first one has sent nothing later.
    """

    def __init__(self, age: int, entries: int, size: int):
        self.age, self.entries, self.size = age, entries, size
        self.held: OrderedDict[tuple, list] = OrderedDict()  # (conn, xid, print): [answered, at, bytes]
        self.first: dict[tuple, tuple] = {}  # (xid, print): the entry of whichever connection made it
        self.newest: dict[int, int] = {}
        self.calls: dict[int, int] = {}
        self.bytes = 0

    def forget(self, key: tuple) -> None:
        _, _, size = self.held.pop(key)
        self.bytes -= size
        if self.first.get(key[1:]) == key:
            del self.first[key[1:]]
        self.calls[key[0]] -= 1
        if not self.calls[key[0]]:
            del self.calls[key[0]]
            self.newest.pop(key[0], None)

    def trim(self, now: int) -> None:
        while self.held:
            key = next(iter(self.held))
            if now - self.held[key][1] < self.age and len(self.held) <= self.entries and self.bytes <= self.size:
                return
            self.forget(key)

    def call(self, key: tuple, now: int) -> str:
        self.trim(now)
        conn, xid, _ = key
        found = self.held.get(key)
        other = self.first.get(key[1:])
        if found is None and other is not None and self.newest.get(other[0], xid) <= xid:
            found = self.held[other]
        if found is None:
            self.held[key] = [False, now, 0]
            self.first[key[1:]] = key
            self.calls[conn] = self.calls.get(conn, 0) + 1
        if conn in self.calls:
            self.newest[conn] = max(xid, self.newest.get(conn, xid))
        return "new" if found is None else "replay" if found[0] else "in_progress"

    def reply(self, key: tuple, size: int | None, now: int) -> None:
        """The call's reply of so many bytes; None: it made none, and is forgotten."""
        if key in self.held:
            if size is None:
                self.forget(key)
            else:
                self.bytes += size - self.held[key][2]
                self.held[key] = [True, now, size]
        self.trim(now)


def reply_cache(events: DataFrame, seconds: int, entries: int, size: int) -> DataFrame:
    """Each call (client, conn, xid, print, size, ts, seq; kind `call`) as new, in_progress or replay; `reply` ends it, with no size as if it had not been.

    A client's events are read in order by one task, in the memory that the
    bounds allow; clients do not push each other's entries out.
    """
    rows = events.select("client", "conn", "xid", "print", "kind", "size", F.unix_micros("ts").alias("at"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, cache = None, None
        for batch in batches:
            seqs, states = [], []
            for who, conn, xid, mark, kind, n, at, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cache is None or who != client:
                    client, cache = who, ReplyCache(seconds * 1_000_000, entries, size)
                if kind == "call":
                    seqs.append(seq)
                    states.append(cache.call((conn, xid, mark), at))
                else:
                    cache.reply((conn, xid, mark), n, at)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(states, pa.string())], names=["seq", "state"])

    return rows.repartition("client").sortWithinPartitions("client", "at", "seq").mapInArrow(run, "seq long, state string")


def commit_batches(ops: DataFrame, tick_ms: int, age_ms: int, most: int, dirty: int) -> DataFrame:
    """Operations (key, seq, ts, size) with the number of the commit of their queue that takes them.

    At each tick a queue is committed whose oldest operation is old enough or
    that holds `most` operations; its writer commits it at once when it holds
    more than `dirty` bytes. An operation at the very time of a tick comes after it.
    """
    rows = ops.select("key", "seq", F.unix_micros("ts").alias("at"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    tick, age = tick_ms * 1000, age_ms * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, oldest, last, n, held, begun = None, 0, 0, 0, 0, 0, False
        for batch in batches:
            out = []
            for key, at, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not begun or key != now:
                    now, number, n, held, begun = key, 0, 0, 0, True
                elif n and -(-(last if n >= most else oldest + age) // tick) * tick <= at:
                    number, n, held = number + 1, 0, 0
                if not n:
                    oldest = at
                last, n, held = at, n + 1, held + size
                out.append(number)
                if held > dirty:
                    number, n, held = number + 1, 0, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["key", "seq", "batch"])

    kinds = dict(rows.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, f"key {kinds['key']}, seq {kinds['seq']}, batch long")


def replay_dedup(stream: DataFrame, key: list[str], ts: str, window: str) -> DataFrame:
    """Streaming duplicate-request cache: equal requests within the watermark are answered once; state goes with it."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark(key)


def sampled(samples: DataFrame, seconds: int) -> DataFrame:
    """Count, mean, least and largest of each tumbling window; streams need a watermark."""
    return samples.groupBy(F.window("ts", f"{seconds} seconds").start.alias("start")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def quiet_windows(samples: DataFrame, seconds: int, baseline_windows: int, factor: float) -> DataFrame:
    """Windows after the first few, each against the nearest-rank p95 of all samples of those: quiet if its largest value is within the factor."""
    w = sql(f"SELECT unix_seconds(ts) DIV {seconds} AS w, value FROM {{s}}", s=samples)
    base = sql(f"SELECT value, count(*) AS n FROM {{w}} WHERE w < (SELECT min(w) FROM {{w}}) + {baseline_windows} GROUP BY value", w=w)
    placed = running(base, [F.col("value")], sums={"i": "n"})
    limit = sql("SELECT value AS limit FROM {p} JOIN (SELECT sum(n) AS total FROM {p}) WHERE least(total - 1, (95 * total) DIV 100) BETWEEN i AND i + n - 1", p=placed)
    return sql(f"SELECT w * {seconds} AS start, count(*) AS n, max(value) AS hi, max(value) <= {factor} * (SELECT max(limit) FROM {{l}}) AS quiet FROM {{w}} WHERE w >= (SELECT min(w) FROM {{w}}) + {baseline_windows} GROUP BY w", w=w, l=limit)


def throttled(events: DataFrame, millis: int) -> DataFrame:
    """The first event of each key, then the last of each later interval: at most one an interval."""
    return sql(
        f"""SELECT key, max_by(seq, struct(ts, seq)) AS seq, max(ts) AS ts FROM (SELECT *, (unix_millis(ts) - unix_millis(min(ts) OVER (PARTITION BY key)) + {millis - 1}) DIV {millis} AS slot FROM {{e}}) GROUP BY key, slot""",
        e=events,
    )


def access_times(stream: DataFrame) -> DataFrame:
    """Last access of each block."""
    return stream.groupBy("id").agg(F.max("ts").alias("last"))


def watermark_of(marks: DataFrame) -> DataFrame:
    """The durable high-water mark (pack, len), which never falls: each row's largest mark so far."""
    return running(marks, [F.col("seq")], highest={"w": F.struct("pack", "len")}).select("seq", "w.pack", "w.len")


def guarded_fills(fills: DataFrame, epochs: DataFrame) -> DataFrame:
    """Cache fills (dir, name, target, epoch) that are no older than their directory's epoch; of several the last; a null target is a negative entry."""
    return sql("SELECT f.dir, f.name, max_by(struct(f.target), f.seq).target AS target FROM {f} f LEFT JOIN {e} e ON f.dir = e.dir WHERE f.epoch >= coalesce(e.epoch, 0) GROUP BY f.dir, f.name", f=fills, e=epochs)


def flush(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Commit micro-batches: the last write of each key in a batch goes to the table, once for each batch id however often it is tried.

    A batch that fails is replayed from the checkpoint; the source's rate limit
    (`maxFilesPerTrigger`) is the back-pressure.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        coalesced(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def elided_stream(stream: DataFrame, create: str, unlink: str, wait_ms: int) -> DataFrame:
    """Streaming elision: a key's operations wait for `wait_ms` after its create and vanish if its unlink comes within it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*[list(x) for x in state.get], strict=True)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *h) for h in held], columns=["key", "seq", "op", "value"])
            return
        rows = sorted(held + [(r.seq, r.op, r.value) for b in batches for r in b.itertuples()])
        if rows and rows[0][1] == create and rows[-1][1] == unlink:
            if state.exists:
                state.remove()
        elif rows and rows[0][1] == create:
            state.update(tuple(map(list, zip(*rows, strict=True))))
            state.setTimeoutDuration(wait_ms)
        else:
            yield pd.DataFrame([(key[0], *h) for h in rows], columns=["key", "seq", "op", "value"])

    return stream.groupBy("key").applyInPandasWithState(step, "key long, seq long, op string, value double", "seq array<long>, op array<string>, value array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)

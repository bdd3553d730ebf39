"""Store statistics, liveness, pack plans and garbage collection.

Records are rows (id, pack, len); a live set is a table of ids. Unknown is not
empty: a live side that is missing must be an error of the caller's, never an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators.base import sql
from stonefold.operators.order import running

DEAD_RATIO, DEAD_BYTES = 0.5, 8 << 20


def stats(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: blocks, uncompressed and stored bytes, packs, puts, and hits and bytes of deduplication."""
    return sql(
        """SELECT (SELECT count(*) FROM {b}) AS blocks, (SELECT coalesce(sum(ulen), 0) FROM {b}) AS uncompressed, coalesce(sum(len), 0) AS pack_bytes,
                  count(DISTINCT pack) AS packs, count(*) AS puts, count(*) - count(DISTINCT block) AS dedup_hits FROM {r}""",
        r=records,
        b=blocks,
    )


def pack_plan(records: DataFrame, live: DataFrame) -> DataFrame:
    """Each pack's records, live and dead bytes and dead ratio (0 for a pack without bytes)."""
    return sql(
        """SELECT pack, count(*) AS records, coalesce(sum(len) FILTER (WHERE l.id IS NOT NULL), 0) AS live_bytes, coalesce(sum(len) FILTER (WHERE l.id IS NULL), 0) AS dead_bytes,
                  coalesce(try_divide(coalesce(sum(len) FILTER (WHERE l.id IS NULL), 0), sum(len)), 0) AS dead_ratio
           FROM {r} r LEFT JOIN (SELECT DISTINCT id FROM {l}) l ON r.block = l.id GROUP BY pack""",
        r=records,
        l=live,
    )


def coldness(records: DataFrame, accesses: DataFrame) -> DataFrame:
    """Integer mean of last accesses over a pack's records, repeats counted, missing as 0."""
    return sql(
        "SELECT pack, sum(coalesce(a.last, 0)) DIV count(*) AS coldness FROM {r} r LEFT JOIN (SELECT id, max(at) AS last FROM {a} GROUP BY id) a ON r.block = a.id GROUP BY pack",
        r=records,
        a=accesses,
    )


def candidates(plan: DataFrame, freeze_pack: int | None, ratio: float = DEAD_RATIO, dead: int = DEAD_BYTES) -> DataFrame:
    """Packs worth rewriting; packs at or above the freeze point never are, and none is if that is unknown."""
    epoch = "false" if freeze_pack is None else f"pack < {freeze_pack}"
    return sql(f"SELECT * FROM {{p}} WHERE {epoch} AND dead_ratio >= {ratio} AND dead_bytes >= {dead}", p=plan)


def within_budget(cands: DataFrame, cold: DataFrame, budget: int) -> DataFrame:
    """Candidates in order (coldest first, most dead bytes, pack) while what was copied before is under the budget."""
    rows = sql("SELECT c.pack, live_bytes, dead_bytes, coalesce(d.coldness, 0) AS cold FROM {c} c LEFT JOIN {d} d ON c.pack = d.pack", c=cands, d=cold)
    placed = running(rows, [F.col("cold"), F.col("dead_bytes").desc(), F.col("pack")], sums={"copied": "live_bytes"})
    return placed.where(F.col("copied") < budget).select("pack", "place", "live_bytes", "dead_bytes")


def net_reclaimed(plan: DataFrame) -> DataFrame:
    """Bytes that rewriting each pack gains: dead less rewritten, computed wide and clamped to a long; may be negative."""
    wide = "CAST(dead_bytes AS DECIMAL(38,0)) - CAST(live_bytes AS DECIMAL(38,0))"
    return sql(f"SELECT pack, CAST(greatest(least({wide}, CAST(9223372036854775807 AS DECIMAL(38,0))), CAST(-9223372036854775808 AS DECIMAL(38,0))) AS BIGINT) AS net FROM {{p}}", p=plan)


def live_set(*roots: DataFrame) -> DataFrame:
    """Union of the ids that each root reaches, holes (null ids) left out."""
    out = roots[0].select("id")
    for more in roots[1:]:
        out = out.union(more.select("id"))
    return out.where("id IS NOT NULL").distinct()


def pinned(polls: DataFrame) -> DataFrame:
    """Ids that any poll named; only an id that every poll left out is unpinned."""
    return polls.select("id").distinct()


def retained(marks: DataFrame, durable: DataFrame) -> DataFrame:
    """Recorded mark sets whose root is still durable."""
    return marks.join(durable.select("root").distinct(), "root", "left_semi")


def missing_live(live: DataFrame, blocks: DataFrame) -> DataFrame:
    """Live ids that the store lacks."""
    return live.select("id").distinct().join(blocks.select("id"), "id", "left_anti")


def unreferenced(blocks: DataFrame, live: DataFrame) -> DataFrame:
    """Stored blocks that nothing refers to."""
    return blocks.join(live.select("id"), "id", "left_anti")


def split_pack(records: DataFrame, pack: int, live: DataFrame) -> DataFrame:
    """The ids of one pack, each live or condemned."""
    return sql(f"SELECT DISTINCT block AS id, CASE WHEN l.id IS NULL THEN 'condemned' ELSE 'live' END AS fate FROM {{r}} r LEFT JOIN (SELECT DISTINCT id FROM {{l}}) l ON r.block = l.id WHERE pack = {pack}", r=records, l=live)


def copy_batches(records: DataFrame, budget: int) -> DataFrame:
    """Live records of each pack cut into batches of at most `budget` bytes, in record order.

    A batch takes whole records while they fit; its first always does. Each cut
    hangs on the one before, so a pack is read in order, in bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, n = None, 0, 0
        for batch in batches:
            out = []
            for pack, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if pack != now:
                    now, used, n = pack, 0, 0
                if used > 0 and used + size > budget:
                    used, n = 0, n + 1
                used += size
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    rows = records.select("pack", "ord", "file", "len")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.repartition("pack").sortWithinPartitions("pack", "file", "ord").mapInArrow(run, f"{schema}, batch long")


def discardable(condemned: DataFrame, live_now: DataFrame) -> DataFrame:
    """Per pack, whether all its condemned ids are still dead, so that it may be unlinked."""
    return sql("SELECT pack, count(*) AS condemned, count(l.id) AS revived, count(l.id) = 0 AS discard FROM {c} c LEFT JOIN (SELECT DISTINCT id FROM {l}) l ON c.block = l.id GROUP BY pack", c=condemned, l=live_now)


def unacknowledged(damage: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Damage that was not accepted before."""
    return damage.join(acknowledged, [c for c in acknowledged.columns], "left_anti")


def collect(records: DataFrame, live: DataFrame, accesses: DataFrame, freeze_pack: int | None, budget: int, ratio: float = DEAD_RATIO, dead: int = DEAD_BYTES) -> DataFrame:
    """One cycle's report: plan, candidates, those within the budget, bytes copied, reclaimed and net."""
    plan = pack_plan(records, live)
    cands = candidates(plan, freeze_pack, ratio, dead)
    done = within_budget(cands, coldness(records, accesses), budget)
    p, c, d = (x.agg(*a) for x, a in ((plan, [F.count("*").alias("packs")]), (cands, [F.count("*").alias("candidates")]), (done, [F.count("*").alias("rewritten"), F.coalesce(F.sum("live_bytes"), F.lit(0)).alias("copied"), F.coalesce(F.sum("dead_bytes"), F.lit(0)).alias("reclaimed")])))
    return sql("SELECT (SELECT packs FROM {p}) AS packs, (SELECT candidates FROM {c}) AS candidates, rewritten, copied, reclaimed, reclaimed - copied AS net FROM {d}", p=p, c=c, d=d)

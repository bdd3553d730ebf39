"""Deduplication accounting over files and chunks.

All operators take a table with an object's `id`, `size`, `pool`, `slot` and
`category`, one row an occurrence; counts are exact. Unique bytes of a pool or
category count an object once in each that holds it, so they may add up to more
than the unique bytes of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators.base import sql


def objects(files: DataFrame, content: str = "content") -> DataFrame:
    """Occurrences of whole files, identified by the SHA-256 of their content."""
    return files.withColumn("id", F.sha2(content, 256)).drop(content)


def totals(rows: DataFrame) -> DataFrame:
    """Objects, distinct objects, their bytes and the ratio; an empty store has ratio 0."""
    return sql(
        """SELECT coalesce(sum(n), 0) AS n_objects, count(*) AS n_unique, coalesce(sum(n * size), 0) AS raw_bytes,
                  coalesce(sum(size), 0) AS unique_bytes, coalesce(sum(n * size), 0) / greatest(coalesce(sum(size), 0), 1) AS ratio
           FROM (SELECT id, max(size) AS size, count(*) AS n FROM {r} GROUP BY id)""",
        r=rows,
    )


def by_slot_and_category(rows: DataFrame) -> DataFrame:
    """Totals for all, each slot and each category in one pass over the distinct pairs."""
    return sql(
        """SELECT slot, category, sum(n) AS n_objects, count(DISTINCT id) AS n_unique, sum(n * size) AS raw_bytes
           FROM (SELECT id, slot, category, max(size) AS size, count(*) AS n FROM {r} GROUP BY id, slot, category)
           GROUP BY GROUPING SETS ((), (slot), (category))""",
        r=rows,
    )


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """Unique objects and bytes of each value of `key`."""
    return sql(f"SELECT {key}, count(*) AS n_unique, sum(size) AS unique_bytes FROM (SELECT {key}, id, max(size) AS size FROM {{r}} GROUP BY {key}, id) GROUP BY {key}", r=rows)


def sharing_histogram(rows: DataFrame) -> DataFrame:
    """Unique objects and bytes by the number of pools that hold them."""
    return sql("SELECT n_pools, count(*) AS n_unique, sum(size) AS unique_bytes FROM (SELECT id, count(DISTINCT pool) AS n_pools, max(size) AS size FROM {r} GROUP BY id) GROUP BY n_pools", r=rows)


def cross_pool_savings(rows: DataFrame) -> DataFrame:
    """What sharing between pools saves: the pools' unique bytes less the unique bytes of all."""
    return sql(
        """SELECT sum(n_pools * size) AS per_pool_unique, sum(size) AS global_unique, sum((n_pools - 1) * size) AS savings
           FROM (SELECT id, count(DISTINCT pool) AS n_pools, max(size) AS size FROM {r} GROUP BY id)""",
        r=rows,
    )


def first_seen(rows: DataFrame, order: str) -> DataFrame:
    """Bytes charged to the slot that brings an object first in the total order given.

    Aggregates only, which combine before the shuffle: an object that is
    everywhere is one row a task.
    """
    return sql(
        f"""SELECT a.slot, a.n_objects, a.raw_bytes, coalesce(b.n_new, 0) AS n_new, coalesce(b.new_bytes, 0) AS new_bytes
            FROM (SELECT slot, count(*) AS n_objects, sum(size) AS raw_bytes FROM {{r}} GROUP BY slot) a
            LEFT JOIN (SELECT slot, count(*) AS n_new, sum(size) AS new_bytes FROM (SELECT id, min_by(slot, struct({order})) AS slot, max(size) AS size FROM {{r}} GROUP BY id) GROUP BY slot) b ON a.slot = b.slot""",
        r=rows,
    )


def slot_number(slot: str = "slot") -> str:
    """SQL of the place of a slot: numeric names by number, others last."""
    return f"coalesce(try_cast(regexp_extract({slot}, '[0-9]+$', 0) AS BIGINT), 9223372036854775807)"


def running_totals(slots: DataFrame) -> DataFrame:
    """`first_seen` rows in slot order with running sums and the ratio so far."""
    return sql(
        f"""SELECT slot, sum(raw_bytes) OVER w AS raw_so_far, sum(new_bytes) OVER w AS unique_so_far, sum(raw_bytes) OVER w / greatest(sum(new_bytes) OVER w, 1) AS ratio_so_far
            FROM {{s}} WINDOW w AS (ORDER BY {slot_number()}, slot ROWS UNBOUNDED PRECEDING)""",
        s=slots,
    )


def marginal_cost(slots: DataFrame) -> DataFrame:
    """New bytes of each slot as a percentage of the first slot's, rounded to two places."""
    return sql(f"SELECT slot, new_bytes, round(100 * new_bytes / nullif(first_value(new_bytes) OVER (ORDER BY {slot_number()}, slot), 0), 2) AS pct_of_first FROM {{s}}", s=slots)


def duplicates(rows: DataFrame) -> DataFrame:
    """Objects that occur more than once: how often, and the bytes that one copy would save."""
    return sql("SELECT id, count(*) AS n, (count(*) - 1) * max(size) AS wasted FROM {r} GROUP BY id HAVING count(*) > 1", r=rows)


def fixed_chunks(files: DataFrame, chars: int) -> DataFrame:
    """Chunks of `chars` characters: ino, slot, pool, category, ord, id and size in bytes. The empty file has none."""
    return sql(
        f"""SELECT ino, slot, pool, category, ord, sha2(chunk, 256) AS id, CAST(octet_length(chunk) AS BIGINT) AS size
            FROM (SELECT ino, slot, pool, category, k AS ord, substr(content, CAST(k * {chars} AS INT) + 1, {chars}) AS chunk
                  FROM {{f}} LATERAL VIEW explode(sequence(0L, CAST((length(content) - 1) DIV {chars} AS BIGINT))) AS k WHERE length(content) > 0)""",
        f=files,
    )


def put(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert if absent, by id: what is new, what was there already, and the bytes a second copy would have cost."""
    return sql(
        """SELECT coalesce(sum(n), 0) AS puts, count_if(s.id IS NULL) AS new_blocks, coalesce(sum(n), 0) - count_if(s.id IS NULL) AS dedup_hits,
                  coalesce(sum(n * size), 0) - coalesce(sum(size) FILTER (WHERE s.id IS NULL), 0) AS dedup_bytes
           FROM (SELECT id, max(size) AS size, count(*) AS n FROM {i} GROUP BY id) i LEFT JOIN (SELECT DISTINCT id FROM {s}) s ON i.id = s.id""",
        i=incoming,
        s=stored,
    )


def intern(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """`stored` with the incoming objects whose id it lacks, each once."""
    return stored.unionByName(incoming.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti").select(*stored.columns))

"""Places and running totals over a whole table, of which no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonefold.operators.graph import cut_lineage


def running(rows: DataFrame, order: list[Column], sums: dict[str, str] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with their `place` in `order` from 1, the sum of a column over the rows before, and the largest value so far.

    Rows are cut into ranges of the order, each of which is totalled by itself;
    what came before a range is one row a partition. `order` must tell rows
    apart: equal ones share a range, and their order in it is arbitrary. An
    empty sum is 0, an empty largest value null.
    """
    sums, highest = sums or {}, highest or {}
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_place"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in highest.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in ("place", *sums)], *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in highest])
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(before), "_range").select(
        *rows.columns,
        (F.row_number().over(inside).cast("long") + F.col("_place")).alias("place"),
        *[(F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_{n}")).alias(n) for n, c in sums.items()],
        *[F.greatest(F.max(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_{n}")).alias(n) for n, c in highest.items()],
    )

"""Connected components of a link table, wholly on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint, release

#: Links that a task joins up at once, at most (16 bytes each); no more of them in all need no round.
CHUNK_LINKS = 500_000


def join_up(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the least index of its component."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _contracted(edges: DataFrame) -> DataFrame:
    """Links that join up the same nodes: of each chunk of a partition's links, every node's with the least of its component there."""

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = join_up(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        for some in np.split(moved, range(100_000, len(moved), 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[labels[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(h.num_rows for h in held) + batch.num_rows > CHUNK_LINKS:
                yield from joined(held)
                held = []
            held.append(batch)
        if held:
            yield from joined(held)

    return edges.mapInArrow(run, "a long, b long")


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one link at most to a lesser node, which has none itself."""
    up, down = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.select("b", F.lit(0), F.lit(1))
    return up.union(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _distinct(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges(a, b)` that is not itself a root; a root is its component's least node.

    Each task joins up `CHUNK_LINKS` links, so that where there are no more,
    one task ends it. Otherwise alternating large-star and small-star steps
    follow until the links are stars, a number of rounds that grows with the
    logarithm of the number of nodes. A round's links are checkpointed; only
    their count, and whether they are stars, come to the driver, whose own
    memory follows the number of stages and tasks.
    """
    # the links are checkpointed before a Python worker reads them: `edges` may come from one, and two to a task would fill the executor
    now = checkpoint(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"))
    if n := now.count():
        now = checkpoint(_contracted(now.coalesce(-(-n // CHUNK_LINKS))))
    while n > CHUNK_LINKS and not _is_forest(now):
        now = checkpoint(_small_star(_large_star(now)))
        release(edges.sparkSession)
    release(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

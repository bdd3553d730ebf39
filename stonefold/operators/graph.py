"""Reachability, closures and rollups over edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefold.operators.base import sql


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where all of Spark runs on it and none is named, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="stonefold-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that `roots(id)` reach over `edges(parent, child)`, roots included, with their least depth.

    A frontier loop: each step expands only nodes not seen before, so shared
    subtrees are walked once and cycles end. Only the frontier's emptiness
    comes to the driver.
    """
    seen = frontier = cut_lineage(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier, edges["parent"] == frontier["id"]).select(F.col("child").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)  # of checkpointed tables
    return seen


def mark(edges: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Mark sets (root, id) of all `roots(id)`: those recorded in `known` are reused, only new roots are walked, gone roots are dropped."""
    kept = known.join(roots.select(F.col("id").alias("root")), "root", "left_semi")
    fresh = roots.join(known.select(F.col("root").alias("id")).distinct(), "id", "left_anti")
    marks = cut_lineage(fresh.select(F.col("id").alias("root"), "id"))
    frontier = marks
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["parent"]).select("root", F.col("child").alias("id")).distinct()
        frontier = cut_lineage(step.join(marks, ["root", "id"], "left_anti"))
        marks = marks.union(frontier)
    return kept.unionByName(marks)


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.count("*").alias("refs"))


def ancestry(parents: DataFrame, of: int) -> DataFrame:
    """A process and all its ancestors over `parents(pid, ppid)`, with their distance.

    By pointer doubling: a round doubles the length of all jumps, so a chain of
    any length takes the logarithm of it in rounds. Cycles end.
    """
    jumps = parents.where("ppid IS NOT NULL AND ppid <> pid").select(F.col("pid").cast("long").alias("at"), F.col("ppid").cast("long").alias("up"))
    seen, step = cut_lineage(parents.sparkSession.createDataFrame([(of, 0)], "pid long, depth int")), 1
    jumps = cut_lineage(jumps.groupBy("at").agg(F.min("up").alias("up")))
    while True:
        more = seen.join(jumps, F.col("pid") == F.col("at")).select(F.col("up").alias("pid"), (F.col("depth") + step).alias("depth"))
        wider = cut_lineage(seen.union(more).groupBy("pid").agg(F.min("depth").alias("depth")))
        if wider.count() == seen.count():
            return wider
        seen, step = wider, 2 * step
        jumps = cut_lineage(jumps.alias("a").join(jumps.alias("b"), F.expr("a.up = b.at")).select("a.at", "b.up"))


def bounded_closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` steps, and whether each is known as a parent (resolved)."""
    seen = roots.select("id").withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.select("id").join(edges, F.col("id") == edges["parent"]).select(F.col("child").alias("id")).distinct().withColumn("depth", F.lit(d))
        seen = seen.union(frontier)
    seen = seen.groupBy("id").agg(F.min("depth").alias("depth"))
    return seen.join(edges.select(F.col("parent").alias("id"), F.lit(True).alias("resolved")).distinct(), "id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def settle(counts: DataFrame, deltas: DataFrame, edges: DataFrame) -> DataFrame:
    """Reference counts after net deltas: a node that falls to 0 goes and takes one reference off each child, to the fixpoint.

    A count below 0 is an error.
    """
    now = cut_lineage(counts.select("id", "refs"))
    todo = deltas.groupBy("id").agg(F.sum("delta").alias("delta"))
    while True:
        now = cut_lineage(now.join(todo, "id", "full").select("id", (F.coalesce("refs", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("refs"), F.col("delta").isNotNull().alias("touched")))
        if not now.where("refs < 0").isEmpty():
            raise ValueError("a reference count fell below zero")
        freed = cut_lineage(now.where("refs = 0 AND touched").select("id"))
        if freed.isEmpty():
            return now.where("refs > 0").select("id", "refs")
        now = now.join(freed, "id", "left_anti")
        todo = edges.join(freed, edges["parent"] == freed["id"]).groupBy(F.col("child").alias("id")).agg((-F.count("*")).alias("delta"))


def reap(nodes: DataFrame, live: DataFrame, batch: int) -> DataFrame:
    """The next `batch` nodes to free, in id order: removal goes in bounded steps."""
    return nodes.join(live, "id", "left_anti").orderBy("id").limit(batch)


def merkle(nodes: DataFrame, depth: int) -> DataFrame:
    """Tree hashes of `nodes(id, parent, depth, name, content, size)` bottom-up, and the files and bytes below.

    A file (content not null) hashes `f` and its content, a directory `d` and its
    sorted entries. An entry is its kind, the length of its name in bytes, a
    colon, the name and the hash, so no two trees have the same encoding. One
    aggregation by parent a level, so depth rounds in all.
    """
    kind = F.when(F.col("content").isNull(), "d").otherwise("f")
    done = None
    rest = nodes.withColumns({"hash": F.sha2(F.concat(kind, F.coalesce("content", F.lit(""))).cast("binary"), 256), "files": F.when(F.col("content").isNotNull(), 1).otherwise(0).cast("long"), "bytes": F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))})
    for d in range(depth, 0, -1):
        below = rest.where(F.col("depth") == d) if done is None else done
        entry = F.concat(kind, F.octet_length("name").cast("string"), F.lit(":"), "name", "hash")
        up = below.groupBy(F.col("parent").alias("id")).agg(F.sha2(F.concat(F.lit("d"), F.array_join(F.array_sort(F.collect_list(entry)), "")).cast("binary"), 256).alias("h"), F.sum("files").alias("f"), F.sum("bytes").alias("b"))
        level = rest.where(F.col("depth") == d - 1).join(up, "id", "left")
        done = level.select(*nodes.columns, F.coalesce("h", "hash").alias("hash"), (F.col("files") + F.coalesce("f", F.lit(0))).alias("files"), (F.col("bytes") + F.coalesce("b", F.lit(0))).alias("bytes"))
    return done.select("id", "name", "hash", "files", "bytes")


def owners(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """The owner of each path by its longest directory prefix; null where none fits.

    A path's own prefixes are joined by equality, so no pair of an unrelated
    path and directory is looked at.
    """
    return sql(
        """SELECT id, path, max_by(owner, length(dir)) AS owner FROM (
             SELECT p.id, p.path, d.dir, d.owner FROM (SELECT id, path, explode_outer(transform(sequence(1, greatest(1, size(split(path, '/')) - 1)), k -> array_join(slice(split(path, '/'), 1, k), '/'))) AS prefix FROM {p}) p
             LEFT JOIN {d} d ON p.prefix = d.dir AND p.path <> d.dir) GROUP BY id, path""",
        p=paths,
        d=dirs,
    )


def dependents(changed: DataFrame, depends: DataFrame) -> DataFrame:
    """The packages to test: `changed(name)` and all that depend on them, over `depends(name, on)`."""
    return reachable(depends.select(F.col("on").alias("parent"), F.col("name").alias("child")), changed.select(F.col("name").alias("id"))).select(F.col("id").alias("name"))

"""Helpers that every operator of this package uses."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A scan of fewer bytes in fewer files than cores is dealt out anew before costly work.
SMALL_SCAN_BYTES = 64 << 20
#: Bytes of output after which a Python operator hands a batch on.
FLUSH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only where none is named (tests) make one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stonefold-checkpoint-"))


#: Spark deletes the shuffles of a query at its end; read when a DataFrame is made.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage there.

    The files live as long as the plan that reads them; Spark removes them
    with the last reference, so a pipeline does not pile them up.
    """
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_alone(df: DataFrame) -> DataFrame:
    """`checkpoint` that deletes the shuffles that made it at once, as nothing reads them again.

    What else is made of `df` itself runs its plan anew, as ever.
    """
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return checkpoint(df.select("*"))
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Delete the files of shuffles and checkpoints that nothing refers to any more, and give the driver's free memory back.

    Spark's cleaner does so when the driver's garbage is collected, which on a
    large heap may be hours after a loop has left them; so collect it now.
    What Python lets go of is handed to a thread that may sleep for a second
    before it tells the JVM, too late for the collection; so tell it here.
    Even so one collection leaves the last query's files in most runs (why was
    not found), and a second one, a little later, takes them.
    """
    gc.collect()
    let_go = getattr(spark._jvm._gateway_client, "finalizer_deque", None)
    with contextlib.suppress(IndexError):  # the thread may take the last one
        while let_go and isinstance(let_go[-1], tuple):  # else it is the sign that the thread ends
            client, target = let_go.pop()
            client.garbage_collect_object(target, False)
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    time.sleep(0.2)
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it reads a few small files, which may be a single row group and so a single task.

    A larger scan is left as it is: its own partitions suffice, and its rows
    are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_SCAN_BYTES
    return df.repartition(cores) if small and 0 < len(df.inputFiles()) < cores else df


#: How to empty what an operator remembers in a Python worker between tasks.
_MEMORIES: dict[str, Callable[[], None]] = {}


def remember(name: str, clear: Callable[[], None]) -> None:
    _MEMORIES[name] = clear


def claim(name: str) -> None:
    """Called by each operator's tasks: a worker that other operators used before gives up what they remembered."""
    for other, clear in _MEMORIES.items():
        if other != name:
            clear()


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """`mapInArrow` where `make()` builds a task's state once and returns its batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def ascii_lower(column: str | Column) -> Column:
    """Lower-case A-Z only; null is the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

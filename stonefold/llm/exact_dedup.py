"""Exact deduplication by Grace hashing, comparing complete content.

Texts are equal when identical after lower-casing A-Z. Each input partition is
deduplicated first, so a text that fills a third of the corpus leaves one row a
partition; what remains is shuffled by content hash and deduplicated again. Both
passes are the same operator: while its rows are within a memory budget they go
into an open-addressing table that compares complete content; beyond it, rows
are partitioned by further bits of their hash to spill files in the task's
temporary folder, and each file is treated alike, recursively. A file whose rows
all have one hash cannot be partitioned further and needs no more memory than
its distinct contents, so it is streamed through the table. Spill files belong
to one task attempt: a lost executor loses only tasks that Spark runs again.

Of equal texts the row with the largest doc_id stays (null is smallest, the
first row seen on a tie).

Defined results: a null text equals the empty text; rows without a doc_id are
kept only if no equal text has one; rows that repeat one doc_id and text are
one document to `dedup_report` (all are marked alike) while `exact_dedup` keeps
one of them; an empty table gives an empty table; other columns pass through
`exact_dedup` untouched, but for the reserved names `__hash` and `__copies`.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stonefold.llm.common import claim

#: Bytes of rows that a task holds before it partitions them to spill files.
BUDGET_BYTES = 96 << 20
FANOUT_BITS = 4


def normalised(column: pa.Array) -> list[bytes]:
    """Contents as compared: A-Z lower-cased, UTF-8; null is the empty text."""
    return pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")).cast(pa.binary()).to_pylist()


class Table:
    """Open addressing with linear probing; an entry for each distinct content."""

    def __init__(self):
        self.slots = np.full(1 << 10, -1, np.int64).tolist()
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keys: list = []
        self.copies: list[int] = []
        self.rows: list[tuple[pa.RecordBatch, int]] = []

    def grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots, mask = [-1] * size, size - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def find(self, h: int, content: bytes) -> int:
        """The content's entry, or -1 - slot where it belongs."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1 - at

    def add(self, batch: pa.RecordBatch, key_at: int, text_at: int) -> None:
        hashes, copies = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
        better: dict[int, int] = {}
        for row, (h, n, key, content) in enumerate(zip(hashes, copies, batch.column(key_at).to_pylist(), normalised(batch.column(text_at)), strict=True)):
            entry = self.find(h, content)
            if entry < 0:
                self.slots[-1 - entry] = entry = len(self.hashes)
                self.hashes.append(h)
                self.contents.append(content)
                self.keys.append(key)
                self.copies.append(n)
                self.rows.append((batch, row))
                better[entry] = row
                if 2 * len(self.hashes) > len(self.slots):
                    self.grow()
            else:
                self.copies[entry] += n
                if key is not None and (self.keys[entry] is None or key > self.keys[entry]):
                    self.keys[entry] = key
                    better[entry] = row
        if better:  # keep only the rows that lead their content
            some = batch.take(pa.array(list(better.values()), pa.int64()))
            for at, entry in enumerate(better):
                self.rows[entry] = (some, at)

    def leaders(self) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[pa.RecordBatch, list[int], list[int]]] = {}
        for (batch, row), n in zip(self.rows, self.copies, strict=True):
            _, rows, copies = by.setdefault(id(batch), (batch, [], []))
            rows.append(row)
            copies.append(n)
        for batch, rows, copies in by.values():
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(copies, pa.int64())], schema=batch.schema)



def grace(batches: Iterable[pa.RecordBatch], key_at: int, text_at: int, budget: int = BUDGET_BYTES, level: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each distinct content of `batches`, whose last two columns are hash and copies."""
    batches = iter(batches)
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > budget:
            break
    else:
        table = Table()
        for batch in held:
            table.add(batch, key_at, text_at)
        yield from table.leaders()
        return

    def rest() -> Iterator[pa.RecordBatch]:
        while held:
            yield held.pop(0)
        yield from batches

    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        sinks: dict[int, tuple[str, pa.OSFile, pa.RecordBatchStreamWriter]] = {}
        ends: dict[int, list[int]] = {}
        mask, shift = (1 << FANOUT_BITS) - 1, 64 - FANOUT_BITS * (level + 1)
        for batch in rest():
            hashes = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            bucket = (hashes.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & mask
            for b in np.unique(bucket).tolist():
                rows = np.flatnonzero(bucket == b)
                if b not in sinks:
                    f = pa.OSFile(path := os.path.join(folder, f"{level}-{b}"), "wb")
                    sinks[b] = (path, f, pa.ipc.new_stream(f, batch.schema))
                    ends[b] = [int(hashes[rows].min()), int(hashes[rows].max())]
                sinks[b][2].write_batch(batch.take(pa.array(rows)))
                ends[b] = [min(ends[b][0], int(hashes[rows].min())), max(ends[b][1], int(hashes[rows].max()))]
        for _, f, sink in sinks.values():
            sink.close()
            f.close()
        for b, (path, _, _) in sinks.items():
            with pa.OSFile(path) as f, pa.ipc.open_stream(f) as spilled:
                if ends[b][0] == ends[b][1] or shift == 0:  # no further bit tells these rows apart
                    table = Table()
                    for batch in spilled:
                        table.add(batch, key_at, text_at)
                    yield from table.leaders()
                else:
                    yield from grace(spilled, key_at, text_at, budget, level + 1)
            os.unlink(path)


def exact_dedup(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", copies: bool = False) -> DataFrame:
    """The rows of `docs` that stay; with `copies`, also how many rows had their text, as `__copies`."""
    columns = docs.columns
    key_at, text_at = columns.index(key_col), columns.index(text_col)
    inner = StructType([*docs.schema.fields, StructField("__hash", LongType()), StructField("__copies", LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, normalised(batch.column(text_at))), np.uint64, batch.num_rows).view(np.int64)
                    fields = [*batch.schema, pa.field("__hash", pa.int64()), pa.field("__copies", pa.int64())]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h), pa.array(np.ones(len(h), np.int64))], schema=pa.schema(fields))

        claim("exact_dedup")
        yield from grace(hashed(), key_at, text_at)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact_dedup")
        yield from grace((b for b in batches if b.num_rows), key_at, text_at)

    kept = docs.mapInArrow(local, inner).repartition("__hash").mapInArrow(final, inner)
    return kept.drop("__hash") if copies else kept.select(*columns)


def text_digests(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text_sha256 (lower-case hex of the normalised text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(c).hexdigest() for c in normalised(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["doc_id", "text_sha256"])

    return docs.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_sha256 string")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Groups come from the Grace tables; a document finds its group by the
    SHA-256 of its text, a join that adaptive execution splits where a group is
    hot.
    """
    leaders = exact_dedup(docs.select("doc_id", "text"), copies=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(c).hexdigest() for c in normalised(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column(0).cast(pa.int64()), batch.column(2)], names=["text_sha256", "keep_id", "group_size"])

    groups = leaders.mapInArrow(run, "text_sha256 string, keep_id long, group_size long")
    return text_digests(docs).join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    return dedup_report(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""

"""Pack files: append-only logs of records, written, scanned with resynchronising, and salvaged.

A record is a 56-byte header - magic, codec, id (SHA-256), lengths, payload
check sum, header check sum - and the payload. A scan yields records and the
gaps between them; after damage it goes on at the next header that checks out.
Codecs are raw and zlib, kept only where it saves five percent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stonefold.operators.base import sql

MAGIC = b"SFR1"
HEADER = struct.Struct("<4sB3x32sIII")
RAW, ZLIB = 0, 1


def encode(data: bytes) -> bytes:
    """One record."""
    small = zlib.compress(data, 3)
    codec, payload = (ZLIB, small) if len(small) * 100 <= len(data) * 95 else (RAW, data)
    head = HEADER.pack(MAGIC, codec, hashlib.sha256(data).digest(), len(data), len(payload), zlib.crc32(payload))
    return head + struct.pack("<I", zlib.crc32(head)) + payload


SIZE = HEADER.size + 4


def record_at(data: bytes, at: int) -> tuple[str, int, int, bool] | None:
    """(id, uncompressed length, record length, sound) of a header that checks out, else None."""
    head = data[at : at + HEADER.size]
    if len(head) < HEADER.size or head[:4] != MAGIC or data[at + HEADER.size : at + SIZE] != struct.pack("<I", zlib.crc32(head)):
        return None
    _, codec, digest, ulen, slen, check = HEADER.unpack(head)
    payload = data[at + SIZE : at + SIZE + slen]
    sound = len(payload) == slen and zlib.crc32(payload) == check
    if sound:
        raw = zlib.decompress(payload) if codec == ZLIB else payload
        sound = len(raw) == ulen and hashlib.sha256(raw).digest() == digest
    return digest.hex(), ulen, SIZE + slen, sound


def events(data: bytes, deep: bool = False) -> Iterator[tuple[str, int, int, str | None, int | None]]:
    """(kind, offset, length, id, uncompressed length): `record`, `damaged` or `gap`; deep also finds records inside payloads of damaged ones."""
    at = gap = 0
    while at < len(data):
        found = record_at(data, at)
        if found is None:
            nxt = data.find(MAGIC, at + 1)
            at = nxt if nxt >= 0 else len(data)
            continue
        digest, ulen, length, sound = found
        if gap < at:
            yield "gap", gap, at - gap, None, None
        yield ("record" if sound else "damaged"), at, min(length, len(data) - at), digest, ulen
        at += SIZE if deep and not sound else length
        gap = at
    if gap < len(data):
        yield "gap", gap, len(data) - gap, None, None


def write(blocks: DataFrame, data: str = "content", pack_bytes: int = 8 << 20) -> DataFrame:
    """Packs (path, content) of the blocks, each of some `pack_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:04d}.pack"]), pa.array([b"".join(held)], pa.binary())], names=["path", "content"])
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(encode(x if isinstance(x, bytes) else (x or "").encode()))
                size += len(held[-1])
                if size >= pack_bytes:
                    yield pack()
                    n, held, size = n + 1, [], 0
        if held:
            yield pack()

    return blocks.select(data).mapInArrow(run, "path string, content binary")


def scan(packs: DataFrame, deep: bool = False) -> DataFrame:
    """Scan events (path, kind, off, len, id, ulen) of packs (path, content), such as Spark's binaryFile source gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *e) for e in events(content, deep)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "kind", "off", "len", "id", "ulen"])

    return packs.select("path", "content").mapInArrow(run, "path string, kind string, off long, len long, id string, ulen long")


def salvage(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """What a rescan can add to an index (id, path, off, readable): records not indexed, and those that replace an unreadable entry; gaps are counted."""
    return sql(
        """SELECT CASE WHEN s.kind = 'gap' THEN 'gap' WHEN s.kind = 'damaged' THEN 'damaged' WHEN i.id IS NULL THEN 'added' WHEN NOT i.readable THEN 'replaced' ELSE 'known' END AS outcome, count(*) AS n, sum(s.len) AS bytes
           FROM {s} s LEFT JOIN {i} i ON s.id = i.id GROUP BY 1""",
        s=scanned,
        i=index,
    )


def listing(files: DataFrame) -> DataFrame:
    """Packs of a file listing (path, length) by id; other names are left out, the last is active."""
    return sql("WITH p AS (SELECT try_cast(regexp_extract(path, r'pack-(\\d+)\\.log$', 1) AS BIGINT) AS id, length AS len FROM {f} WHERE path RLIKE r'pack-\\d+\\.log$') SELECT id, len, id = (SELECT max(id) FROM p) AS active FROM p ORDER BY id", f=files)

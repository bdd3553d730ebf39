"""WARC archives: writing, reading, and a globally ordered capture index.

Writing: a record's payload is compared by its SHA-256; of equal payloads of at
least `MIN_REVISIT_BYTES` the record with the smallest page id is a response and
the others are revisits that refer to it. First holders are found by a grouped
minimum (combined before the shuffle), checkpointed and joined back by digest: a
join of plain tables, where adaptive execution splits a hot digest. A task writes its records, each a gzip member,
into archives of bounded size; an archive is a row (path, content) in the shape
of Spark's binaryFile source, so `read` takes either. Archive rows are written
to and read from storage through Spark alone and need no local disk.

Indexing: the captures of one archive form a locally sorted run. Runs are dealt
by ranges of (URL key, timestamp, page id), so a hot URL spreads over ranges,
and each task merges the runs of its range with a loser tree: log2(k) steps a
capture. Runs beyond the memory budget lie in the task's temporary folder and
are streamed. The order of ranges and the order within one make the global
order, `capture_order`.

Defined results: a null payload is the empty payload; a null url is the empty
url; a null page id is written as none, read back as null, and refers or is
referred to as null; rows that repeat the smallest page id of a payload are all
responses; an empty table gives no archives and an empty index. Only page_id,
url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint

#: Payloads below this are always written in full.
MIN_REVISIT_BYTES = 100
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Captures that a task sorts in memory before a run goes to its temporary folder.
RUN_CAPTURES = 200_000
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)

CAPTURES = "page_id long, url string, url_key string, timestamp string, archive string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def capture_time(page_id: int | None) -> datetime:
    """Pages carry no time; captures are a second apart in page order."""
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (50 * 365 * 86400))


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then the path; lower case, no scheme, no fragment."""
    rest = url.lower().split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", host.split("@")[-1].split(":")[0])
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", capture_time(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields[5:5] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def with_first_holders(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the smallest page id with that payload) and revisit."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = rows.join(checkpoint(first), "digest", "left").select("page_id", "url", "payload", "digest", "first")
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write(pages: DataFrame) -> DataFrame:
    """Archives (path, content): gzip members of WARC records, for every row of `pages`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out = TaskContext.get().partitionId(), 0, io.BytesIO()

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:04d}.warc.gz"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                page_id, url, payload, digest, first, revisit = row
                out.write(gzip.compress(record(page_id, url, payload, digest, first, revisit), 6, mtime=0))
                if out.tell() >= ARCHIVE_BYTES:
                    yield archive()
                    n, out = n + 1, io.BytesIO()
        if out.tell():
            yield archive()

    return with_first_holders(pages).mapInArrow(run, "path string, content binary")


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, d, parts = at, zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            parts.append(d.decompress(view[at : at + 65_536]))
            at = min(at + 65_536, len(view))
        if not d.eof:
            raise ValueError("a gzip member is cut short")
        at -= len(d.unused_data)
        yield start, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (after the HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return fields, payload


def captures_of(path: str, content: bytes) -> Iterator[tuple]:
    """A CAPTURES row for each record; a response's length and digest come from its payload."""
    for offset, data in members(content):
        fields, payload = parse(data)
        number = lambda k: int(fields[k]) if fields.get(k) else None
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        length = int(fields["http-length"])
        if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
            raise ValueError(f"damaged record at {path}:{offset}")
        url = fields["WARC-Target-URI"]
        stamp = re.sub(r"\D", "", fields["WARC-Date"])
        yield (number("X-Page-Id"), url, url_key(url), stamp, path, offset, length, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"))


def arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
KINDS = [pa.int64() if x.endswith(" long") else pa.string() for x in CAPTURES.split(", ")]


def order_of(row: tuple) -> tuple:
    """URL key, timestamp, page id (null first), archive, offset."""
    return (row[2], row[3], row[0] is not None, row[0] or 0, row[4], row[5])


def read(archives: DataFrame) -> DataFrame:
    """Captures of archives (path, content), each archive's sorted by URL key and timestamp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = sorted(captures_of(path, content), key=order_of)
                for at in range(0, len(rows), 10_000):
                    yield arrow(rows[at : at + 10_000], NAMES, KINDS)

    return archives.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """K-way merge of sorted runs: each inner node holds the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple[tuple, tuple]]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.loser = [0] * self.k
        winner = list(range(self.k))
        # play all matches from the leaves up; leaf i is node k + i
        node = [0] * self.k + winner
        for at in range(self.k - 1, 0, -1):
            a, b = node[2 * at], node[2 * at + 1]
            if self.less(b, a):
                a, b = b, a
            node[at], self.loser[at] = a, b
        self.top = node[1] if self.k > 1 else 0

    def less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while (found := self.head[self.top]) is not None:
            yield found[1]
            now = self.top
            self.head[now] = next(self.runs[now], None)
            at = (now + self.k) // 2
            while at:
                if self.less(self.loser[at], now):
                    self.loser[at], now = now, self.loser[at]
                at //= 2
            self.top = now


def spilled(path: str) -> Iterator[tuple[tuple, tuple]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


def external_merge(rows: Iterable[tuple], run_captures: int = RUN_CAPTURES) -> Iterator[tuple]:
    """All rows in order: those of each archive are a run; runs over the budget go to spill files first."""
    with tempfile.TemporaryDirectory(prefix="merge-") as folder:
        files: list[str] = []
        held: dict[str, list[tuple[tuple, tuple]]] = {}
        n = 0

        def spill() -> None:
            path = os.path.join(folder, str(len(files)))
            with open(path, "wb") as f:
                chunk = []
                for row in LoserTree([iter(sorted(r)) for r in held.values()]):
                    chunk.append((order_of(row), row))
                    if len(chunk) == 1000:
                        pickle.dump(chunk, f)
                        chunk = []
                pickle.dump(chunk, f)
            files.append(path)
            held.clear()

        for row in rows:
            held.setdefault(row[4], []).append((order_of(row), row))
            n += 1
            if n >= run_captures:
                spill()
                n = 0
        yield from LoserTree([*map(spilled, files), *(iter(sorted(r)) for r in held.values())])


def capture_index(captures: DataFrame) -> DataFrame:
    """`captures` with `capture_order`, rising by URL key, timestamp and page id over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), []
        names, kinds = [*NAMES, "capture_order"], [*KINDS, pa.int64()]
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(len(NAMES))), strict=True))
        for at, row in enumerate(external_merge(rows)):
            chunk.append((*row, (task << 40) + at))
            if len(chunk) == 10_000:
                yield arrow(chunk, names, kinds)
                chunk = []
        if chunk:
            yield arrow(chunk, names, kinds)

    return captures.repartitionByRange("url_key", "timestamp", "page_id").mapInArrow(run, CAPTURES + ", capture_order long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    archives = checkpoint(write(table(spark, sf_dir, "pages")))
    return capture_index(read(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest),
k AS (SELECT page_id, regexp_replace(regexp_extract(lower(regexp_replace(url, '#.*$', '')), '^(?:.*?://)?([^/]*)', 1), '^www[0-9]*\.', '') AS host,
        regexp_extract(lower(regexp_replace(url, '#.*$', '')), '^(?:.*?://)?[^/]*(.*)$', 1) AS path FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS timestamp
FROM d JOIN k USING (page_id) LEFT JOIN f USING (digest)
"""

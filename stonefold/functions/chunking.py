"""Content-defined chunking (FastCDC with normalised boundaries), as an Arrow operator.

The gear table is drawn from SHA-256 of its index. Small and large masks around
the average size (one bit more, one less) keep chunks near it. A chunk's
boundary depends on the bytes before it within the chunk alone, so equal
content gives equal chunks, and the chunks of a file are its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN, AVERAGE, MAX = 16 << 10, 64 << 10, 256 << 10
GEAR = [int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:8], "little") for i in range(256)]
_GEAR = np.array(GEAR, np.uint64)
_WINDOW = 64


def _rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum over the last 64 bytes of gear << age, for all bytes at once."""
    out = _GEAR[data]
    shift = 1
    while shift < _WINDOW:  # doubling: sums over 1, 2, 4, ... 64 bytes
        more = np.zeros_like(out)
        more[shift:] = out[:-shift] << np.uint64(shift)
        out = out + more
        shift *= 2
    return out


def cuts(data: bytes, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> list[int]:
    """Ends of the chunks of `data`; the empty input has none."""
    n, bits = len(data), average.bit_length() - 1
    if not n:
        return []
    hashes = _rolling(np.frombuffer(data, np.uint8))
    top = lambda b: np.uint64(((1 << b) - 1) << (64 - b))
    strict, loose = np.flatnonzero((hashes & top(bits + 1)) == 0), np.flatnonzero((hashes & top(bits - 1)) == 0)
    out, start = [], 0
    while n - start > least:
        # no boundary looks at bytes before its chunk: the hash's window lies within the least size
        lo, mid, end = start + max(least, _WINDOW), min(start + average, n), min(start + most, n)
        at = np.searchsorted(strict, lo)
        if at < len(strict) and strict[at] < mid:
            cut = int(strict[at]) + 1
        else:
            at = np.searchsorted(loose, max(lo, mid))
            cut = int(loose[at]) + 1 if at < len(loose) and loose[at] < end else end
        out.append(cut)
        start = cut
    if start < n:
        out.append(n)
    return out


def chunk(files: DataFrame, content: str = "content", least: int = MIN, average: int = AVERAGE, most: int = MAX) -> DataFrame:
    """A row for each chunk: the other columns of `files`, ord, off, size, id (SHA-256), and stored, its size compressed or raw if that saves under 5 %."""
    keep = [c for c in files.columns if c != content]
    schema = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep) + ", ord int, off long, size long, id string, stored long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                data = (text or b"") if isinstance(text, bytes) else (text or "").encode()
                start = 0
                for k, end in enumerate(cuts(data, least, average, most)):
                    piece = data[start:end]
                    small = len(zlib.compress(piece, 3))
                    parts.append((k, start, len(piece), hashlib.sha256(piece).hexdigest(), small if small * 100 <= len(piece) * 95 else len(piece)))
                    rows.append(i)
                    start = end
            kept = batch.select(range(len(keep))).take(pa.array(rows, pa.int64()))
            own = zip(*parts, strict=True) if parts else ([],) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(own, kinds, strict=True))], names=[*keep, "ord", "off", "size", "id", "stored"])

    return files.select(*keep, content).mapInArrow(run, schema)

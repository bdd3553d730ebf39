import hashlib
import os
import random
import tempfile

import numpy as np
import pyarrow as pa
import xxhash

from stonefold.llm.exact_dedup import dedup_report, exact_dedup, grace, normalised

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (None, "a b"), (None, "lone"), (7, "x " * 50_000), (8, "X " * 50_000), (9, "same"), (9, "same"), (10, " same")]


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    docs = DOCS + [(100 + i, f"copy {rng.randrange(30)}".upper() if i % 3 else "hot") for i in range(300)]
    df = spark.createDataFrame([(d, t, "q", 3) for d, t in docs], "doc_id long, text string, keep_id string, kept int").repartition(5)
    assert sorted((tuple(r) for r in dedup_report(df).collect()), key=str) == brute(docs)


def test_kept_rows_carry_their_columns(spark):
    df = spark.createDataFrame([(d, t, str(d)) for d, t in DOCS], "doc_id long, text string, source string")
    rows = exact_dedup(df).collect()
    assert len(rows) == len({(t or "").translate(LOWER) for _, t in DOCS})
    assert all(r.source == str(r.doc_id) for r in rows) and rows[0].__fields__ == ["doc_id", "text", "source"]
    assert exact_dedup(df.limit(0)).collect() == [] and dedup_report(df.limit(0)).collect() == []


def batches(docs, rows=50):
    for at in range(0, len(docs), rows):
        ids, texts = map(list, zip(*docs[at : at + rows], strict=True))
        text = pa.array(texts, pa.string())
        h = np.array([xxhash.xxh3_64_intdigest(c) for c in normalised(text)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), text, pa.array(h), pa.array([1] * len(ids), pa.int64())], names=["doc_id", "text", "h", "n"])


def test_spill_files_are_partitioned_recursively_and_removed():
    rng = random.Random(6)
    docs = [(i, f"text {rng.randrange(500)} " * 20 if i % 3 else "hot " * 30) for i in range(3000)]
    before = len(os.listdir(tempfile.gettempdir()))
    for budget in (1 << 30, 50_000, 4_000):
        found = sorted((r["doc_id"], r["n"]) for b in grace(batches(docs), 0, 1, budget) for r in b.to_pylist())
        assert found == sorted({(k, n) for _, k, n, _, _ in brute(docs)})
    assert len(os.listdir(tempfile.gettempdir())) <= before


def test_colliding_hashes_are_told_apart_by_content():
    some = next(batches([(1, "a"), (2, "b"), (3, "a")]))
    same = pa.RecordBatch.from_arrays([*some.columns[:2], pa.array([7, 7, 7]), some.column(3)], names=some.schema.names)
    for budget in (1 << 20, 1):
        assert sorted((r["doc_id"], r["n"]) for b in grace([same], 0, 1, budget) for r in b.to_pylist()) == [(2, 1), (3, 2)]

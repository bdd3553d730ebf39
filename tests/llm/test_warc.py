import gzip
import hashlib
import os
import random
import tempfile

from stonefold.llm.warc import LoserTree, capture_index, captures_of, external_merge, members, order_of, read, record, url_key, write

LONG = "<p>" + "é" * 60
PAGES = [(1, "http://a.example.com/x", "small"), (2, "http://a.example.com/x", "small"), (3, "https://WWW.b.org/Q?x#f", LONG), (4, None, LONG), (5, "u", None), (6, "u", ""), (7, "http://a.example.com/x", LONG), (None, "n", LONG), (None, "n", "tiny"), (9, "http://c/\r\nX: y", "a" * 300_000), (9, "http://c/\r\nX: y", "a" * 300_000), (10, "h", "\r\n\r\nWARC/1.1" + "b" * 100)]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "k", b"z") for p in pages], "page_id long, url string, html string, digest string, payload binary").repartition(3)


def brute(pages):
    rows = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, body in rows:
        first = min((j for j, b in rows if b == body and j is not None), default=None) if len(body) >= 100 else None
        revisit = first is not None and first != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_read_back(spark):
    rng = random.Random(3)
    pages = PAGES + [(100 + i, f"http://h{i % 5}.net/{rng.randrange(9)}", rng.choice(["hot " * 40, "x" * rng.randrange(300)])) for i in range(300)]
    archives = write(frame(spark, pages))
    rows = read(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(pages)
    index = sorted(capture_index(read(archives)).collect(), key=lambda r: r.capture_order)
    assert len({r.capture_order for r in index}) == len(pages)
    keys = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in index]
    assert keys == sorted(keys)


def test_archives_are_plain_warc_files(spark, tmp_path):
    for r in write(frame(spark, PAGES)).collect():
        (tmp_path / r.path).write_bytes(r.content)
        whole = gzip.decompress(r.content)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"".join(m for _, m in members(r.content)) == whole
    again = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(str(r.page_id) for r in read(again).collect()) == sorted(str(p[0]) for p in PAGES)


def test_empty_table(spark):
    none = write(frame(spark, PAGES).limit(0))
    assert none.collect() == [] and capture_index(read(none)).collect() == []


def test_loser_tree_and_spilled_runs():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(LoserTree([iter([((x,), x) for x in r]) for r in runs])) == sorted(x for r in runs for x in r)
    rows = [(rng.choice([None, rng.randrange(99)]), "", f"k{rng.randrange(9)}", str(rng.randrange(9)), f"a{rng.randrange(5)}", i, 0, "", "response", None) for i in range(2000)]
    before = len(os.listdir(tempfile.gettempdir()))
    for budget in (10**6, 300, 1):
        assert list(external_merge(rows[: 200 if budget == 1 else 2000], budget)) == sorted(rows[: 200 if budget == 1 else 2000], key=order_of)
    assert len(os.listdir(tempfile.gettempdir())) <= before


def test_keys_and_damage():
    assert url_key("https://WWW.B.Example.org:80/Q?x#f") == "org,example,b)/q?x"
    data = bytearray(record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False))
    data[-6] ^= 1
    try:
        list(captures_of("p", gzip.compress(bytes(data))))
        raise RuntimeError("damage was not seen")
    except ValueError:
        pass

import random

import pytest
from pyspark.sql import functions as F

from stonefold.functions import paths
from stonefold.operators import compare
from stonefold.operators.snapshots import Snapshots, refresh_base
from stonefold.sources import logs, packs, store_source, walk


def blocks(n=60):
    rng = random.Random(4)
    return [rng.randbytes(rng.randrange(1, 3000)) if i % 2 else bytes([i]) * 2000 for i in range(n)]


def pack(data):
    return b"".join(map(packs.encode, data))


def test_scan_finds_all_records():
    data = blocks()
    found = list(packs.events(pack(data)))
    assert [e[0] for e in found] == ["record"] * len(data) and [e[4] for e in found] == [len(d) for d in data]


def test_scan_goes_on_after_damage():
    data = blocks()
    whole = bytearray(pack(data))
    at = len(pack(data[:10]))
    whole[at + 2] ^= 255  # a header
    body = len(pack(data[:21]))
    whole[body + packs.SIZE + 3] ^= 255  # a payload
    found = list(packs.events(bytes(whole)))
    assert [e[0] for e in found].count("record") == len(data) - 2
    assert [e[0] for e in found].count("gap") == 1 and [e[0] for e in found].count("damaged") == 1
    assert sum(e[2] for e in found) == len(whole)
    torn = list(packs.events(bytes(whole[:-5])))
    assert torn[-1][0] == "damaged"


def test_deep_scan_finds_nested_records():
    inner = packs.encode(b"inner" * 3)
    outer = bytearray(packs.encode(b"\1" + inner + random.Random(1).randbytes(3000)))
    outer[-1] ^= 255
    assert [e[0] for e in packs.events(bytes(outer))] == ["damaged"]
    assert "record" in [e[0] for e in packs.events(bytes(outer), deep=True)]


def test_pack_data_source(spark, tmp_path):
    (tmp_path / "a.pack").write_bytes(pack(blocks(5)))
    (tmp_path / "b.pack").write_bytes(pack(blocks(7)) + b"torn")
    (tmp_path / "other").write_bytes(b"x")
    store_source.register(spark)
    rows = spark.read.format("stonefold_packs").load(str(tmp_path)).groupBy("path", "kind").count().collect()
    assert sorted(map(tuple, rows)) == [("a.pack", "record", 5), ("b.pack", "gap", 1), ("b.pack", "record", 7)]


def test_manifest_and_walk(spark, tmp_path):
    for name, text in (("a/target/x", "1"), ("a/c/y", "22"), ("b/z", "333")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in walk.manifest(spark, str(tmp_path)).collect()}
    assert {k: r.size for k, r in rows.items()} == {"x": 1, "y": 2, "z": 3} and len(rows["x"].digest) == 64
    assert "digest" not in walk.manifest(spark, str(tmp_path), digest=False).columns


def test_jsonl_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "rep int, gate string")
    assert logs.append_new(rows, path, ["rep", "gate"]) == 2 and logs.append_new(rows, path, ["rep", "gate"]) == 0
    (tmp_path / "odd.jsonl").write_text('{"rep": 3}\n\nnot json\n[1]\n{"rep": 4, "gate": "c"}\n')
    assert [r.rep for r in logs.read_jsonl(spark, str(tmp_path / "odd.jsonl"), "rep int, gate string").collect()] == [3, 4]


def test_index_checkpoint_is_rebuilt_if_it_is_wrong(spark, tmp_path):
    path, entries = str(tmp_path / "index"), spark.createDataFrame([("x", 1), ("y", 2)], "id string, pack int")
    rebuild = lambda: entries.limit(1)
    assert logs.load_index(spark, path, rebuild).count() == 1
    logs.save_index(entries, path)
    assert logs.load_index(spark, path, rebuild).count() == 2
    entries.limit(1).union(spark.createDataFrame([("z", 9)], entries.schema)).write.mode("overwrite").parquet(f"{path}/entries")
    assert logs.load_index(spark, path, rebuild).count() == 1


def test_ingest_publishes_only_what_it_verified(spark, tmp_path):
    tree = spark.createDataFrame([("a", "file", 6, 3, "d", 1), ("b", "file", 6, 3, "d", 1)], "path string, kind string, mode int, size int, digest string, ino int")
    done = []
    assert logs.ingest(tree, str(tmp_path / "s"), done.append, compare.import_faults) == {"files": 2, "bytes": 6, "new": 1, "stored": 3} and len(done) == 1
    assert logs.ingest(tree, str(tmp_path / "u"), print, compare.import_faults, known=tree)["new"] == 0
    with pytest.raises(ValueError):
        logs.ingest(tree, str(tmp_path / "t"), done.append, lambda a, b: compare.import_faults(a, b.withColumn("size", F.lit(9))))
    assert len(done) == 1


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snaps"))
    s.create("base")
    s.write("base", "r1")
    s.fork("base", "work")
    s.write("work", "r2")
    names = lambda: {r.name: r.root for r in s.table().collect()}
    assert names() == {"base": "r1", "work": "r2"}
    old = s.versions()[-1]
    s.swap("base", "work")
    assert names() == {"base": "r1", "work": "r1"}
    s.rename("work", "done")
    s.promote("done", "published")
    assert [r.name for r in s.lineage("published").orderBy("depth").collect()] == ["published", "done", "base"]
    for wrong, error in ((lambda: s.create("base"), FileExistsError), (lambda: s.fork("none", "x"), FileNotFoundError), (lambda: s.remove("done", held=True), PermissionError)):
        with pytest.raises(error):
            wrong()
    s.remove("done")
    assert set(names()) == {"base", "published"}
    assert {r.name: r.root for r in s.table(old).collect()} == {"base": "r1", "work": "r2"}
    # an interrupted swap, staged but not yet moved, is rolled forward
    s.write("base", "r9")
    staged = s.fork("base", "published.swap~")
    s.recover()
    assert names() == {"base": "r9", "published": "r9"} and s.find("published").id == staged
    # a removed id is never given out again
    gone = s.create("last")
    s.remove("last")
    assert s.create("next") == gone + 1
    for wrong in ("c/../x", "", ".x", "x.swap~", "y" * 300):
        with pytest.raises(ValueError):
            s.create(wrong)
        with pytest.raises(ValueError):
            s.rename("next", wrong)
    # rows without a marker, or with one that is not written yet, are never read
    (tmp_path / "snaps" / "v999999").mkdir()
    (tmp_path / "snaps" / "v999998").touch()
    assert set(names()) == {"base", "published", "next"}
    # of two writers of one version the second is refused
    last = s.versions()[-1]
    s.commit(s.table(), last)
    with pytest.raises(FileExistsError):
        s.commit(s.table().limit(0), last)
    assert set(names()) == {"base", "published", "next"} and s.versions() == sorted(s.versions(), key=lambda v: int(v[1:]))


def test_name_keys_in_any_form(spark):
    df = spark.createDataFrame([("É",), ("é",), ("X" * 300,), (None,)], "name string")
    keys = [r.k for r in df.select(paths.name_key_any(F.col("name")).alias("k")).collect()]
    assert keys[0] == keys[1] == "é" and keys[2].startswith("#") and keys[3] is None


def test_a_run_is_resumed_by_what_its_meta_row_says(spark, tmp_path):
    folder, want = str(tmp_path / "runs"), {"root": "/r", "counts": {"a": 1}, "corpus_sha": "x", "gates": ["g"], "host": "h"}
    first = logs.open_run(spark, folder, "gates", want, True)
    second = logs.open_run(spark, folder, "gates", want, False)
    assert first != second and logs.open_run(spark, folder, "gates", want | {"host": "other"}, True) == second
    rows = spark.createDataFrame([("rep", 1)], "kind string, rep int")
    assert logs.append_new(rows, second, ["rep"]) == 1 and logs.append_new(rows, second, ["rep"]) == 0
    assert logs.open_run(spark, folder, "gates", want, True) == second
    assert logs.open_run(spark, folder, "gates", want | {"gates": []}, True) not in (first, second)
    assert logs.open_run(spark, folder, "other", want, True) not in (first, second)


def test_corpus_checkpoints(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert logs.load_corpus(spark, path, ["a"]) is None
    for n in (2, 3):
        logs.save_corpus({"chunks": spark.range(n), "files": spark.range(0)}, ["a"], path)
    found = logs.load_corpus(spark, path, ["a"])
    assert (found["chunks"].count(), found["files"].count()) == (3, 0)
    with pytest.raises(ValueError):
        logs.load_corpus(spark, path, ["a", "b"])
    folder = found["chunks"].inputFiles()[0].rsplit("/", 1)[0]
    spark.range(7).write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError):
        logs.load_corpus(spark, path, ["a"])


def test_an_ingest_reports_progress_and_can_be_stopped(spark, tmp_path):
    tree = spark.createDataFrame([(f"f{i}", "file", 6, 3, f"d{i}", 1) for i in range(9)], "path string, kind string, mode int, size int, digest string, ino int")
    seen, published = [], []
    assert logs.ingest(tree, str(tmp_path / "s"), published.append, compare.import_faults, progress=lambda *x: not seen.append(x), steps=3)["files"] == 9
    assert seen[0] == (0, 27) and seen[-1] == (27, 27) and seen == sorted(seen)
    with pytest.raises(logs.Stopped):
        logs.ingest(tree, str(tmp_path / "t"), published.append, compare.import_faults, progress=lambda done, total: done == 0, steps=3)
    assert len(published) == 1


def test_a_base_is_refreshed_with_its_provenance(spark, tmp_path):
    tree = spark.createDataFrame([("a", "file", 6, 3, "d", 1)], "path string, kind string, mode int, size int, digest string, ino int")
    snaps = Snapshots(spark, str(tmp_path / "base"))
    roots = lambda: {r.name: r.root for r in snaps.table().collect()}
    for folder in (str(tmp_path / "t1"), str(tmp_path / "t2")):
        assert refresh_base(snaps, "main", tree, folder, {"revision": "abc"}, compare.import_faults)["files"] == 1
        assert roots() == {"main": folder}
        assert [r.value for r in spark.read.parquet(f"{folder}.provenance").collect()] == ["abc"]
    with pytest.raises(ValueError):
        refresh_base(snaps, "main", tree, str(tmp_path / "t3"), {}, lambda a, b: compare.import_faults(a, b.withColumn("size", F.lit(9))))
    assert roots() == {"main": folder}

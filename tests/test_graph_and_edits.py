import random

import pytest

from stonefold.operators import consistency, extents, graph, namespace, stats, store
from stonefold.streaming import operators as streams


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, child long")
    assert sorted(map(tuple, graph.reachable(edges, spark.createDataFrame([(1,)], "id long")).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_settle_frees_in_cascade_and_refuses_underflow(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3)], "parent long, child long")
    counts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, refs long")
    gone = graph.settle(counts, spark.createDataFrame([(1, -1)], "id long, delta long"), edges)
    assert list(map(tuple, gone.collect())) == [(3, 1)]
    with pytest.raises(ValueError):
        graph.settle(counts, spark.createDataFrame([(1, -2)], "id long, delta long"), edges)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    ranges = [(rng.randrange(3), a, a + rng.randrange(1, 300)) for a in rng.choices(range(500), k=60)]
    ext, off = [], {0: 0, 1: 0, 2: 0}
    for i in range(60):
        f, n = i % 3, rng.randrange(1, 90)
        ext.append((f, i, i, n, off[f]))
        off[f] += n
    got = extents.overlaps(spark.createDataFrame(ranges, "file long, lo long, hi long"), spark.createDataFrame(ext, "file long, ord int, block long, len long, off long"))
    want = sorted((f, lo, hi, o, max(lo, s), min(hi, s + n) - max(lo, s)) for f, lo, hi in ranges for g, o, _, n, s in ext if f == g and s < hi and s + n > lo)
    assert sorted((r.file, r.lo, r.hi, r.ord, r.from_off, r.n) for r in got.collect()) == want


def test_create_link_unlink(spark):
    entries = spark.createDataFrame([(1, "a", 1, 2, "f")], "dir long, name string, cookie long, child long, kind string")
    inodes = spark.createDataFrame([(1, "d", 493, 2, 0, None, 1), (2, "f", 420, 1, 5, None, 1)], "ino long, kind string, mode long, nlink long, size long, target string, parent long")
    req = spark.createDataFrame([(1, "b", "d", 493, None), (1, "a", "f", 420, None)], "dir long, name string, kind string, mode long, target string")
    entries, inodes, errors = namespace.create(entries, inodes, req)
    assert [tuple(r) for r in errors.collect()] == [(1, "a", "Exists")]
    assert {r.ino: r.nlink for r in inodes.collect()} == {1: 3, 2: 1, 3: 2}
    entries, inodes = namespace.link(entries, inodes, spark.createDataFrame([(3, "a2", 2)], "dir long, name string, child long"))
    assert {r.ino: r.nlink for r in inodes.collect()}[2] == 2
    entries, inodes = namespace.unlink(entries, inodes, spark.createDataFrame([(1, "a"), (3, "a2")], "dir long, name string"))
    assert sorted(r.ino for r in inodes.collect()) == [1, 3] and [r.name for r in entries.collect()] == ["b"]


def test_batch_is_all_or_nothing(spark):
    def fail(*_):
        raise RuntimeError

    df = spark.range(3)
    with pytest.raises(RuntimeError):
        namespace.batch((df,), [lambda t: (t.limit(0),), fail])
    assert df.count() == 3


def test_unknown_load_is_not_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "k long, value double")
    peaks = {r.k: r.peak for r in stats.peak_or_unknown(df, "k").collect()}
    assert peaks[2] == 3.0 and peaks[1] != peaks[1]


def test_p95_of_twenty_is_the_last(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(20)], "k long, value double")
    assert stats.nearest_rank_p95(df, "k").first().p95 == 19.0


def test_ancestry_is_deep_and_ends_on_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(400)] + [(900, 901), (901, 902), (902, 900)], "pid long, ppid long")
    assert sorted(map(tuple, graph.ancestry(chain, 399).collect())) == [(i, 399 - i) for i in range(400)]
    assert sorted(map(tuple, graph.ancestry(chain, 900).collect())) == [(900, 0), (901, 1), (902, 2)]
    entries = spark.createDataFrame([(i, f"n{i + 1}", 1, i + 1, "d") for i in range(150)], "dir long, name string, cookie long, child long, kind string")
    assert namespace.rename(entries, (1, "n2", 150, "x"))[1] == "InvalidArgument" and namespace.rename(entries, (149, "n150", 1, "x"))[1] is None


def test_namespace_faults_of_a_cycle(spark):
    inodes = spark.createDataFrame([(1, "d", 3, 1), (2, "d", 3, 1), (3, "d", 3, 2), (4, "d", 2, 4)], "ino long, kind string, nlink long, parent long")
    names = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "dir long, child long")
    found = sorted(map(tuple, consistency.graph_faults(inodes, names, 1).collect()))
    assert found == [(2, "parent"), (4, "orphan"), (4, "unreachable")]


def test_trees_that_read_alike_hash_unlike(spark):
    def tree(*children):
        rows = [("r", None, 0, "root", None, 0), *[(f"c{i}", "r", 1, n, c, 1) for i, (n, c) in enumerate(children)]]
        return graph.merkle(spark.createDataFrame(rows, "id string, parent string, depth int, name string, content string, size long"), 1).first().hash

    x = [("x", "1"), ("y", "2")]
    assert tree(*x) == tree(*reversed(x))
    one = spark.createDataFrame([("1",)], "c string").selectExpr("sha2(concat('f', c), 256)").first()[0]
    assert len({tree(*x), tree((f"x{one}f1:y", "2")), tree((f"x:{one},y", "2")), tree(), tree(("x", None)), tree(("x", ""))}) == 6


def test_compaction_batches_keep_to_the_budget(spark):
    rows = spark.createDataFrame([(1, i, 1, n) for i, n in enumerate([60, 60, 40, 0, 150, 10, 90, 1])], "pack long, ord int, file long, len long")
    got = sorted((r.ord, r.batch) for r in store.copy_batches(rows, 100).collect())
    assert [b for _, b in got] == [0, 1, 1, 1, 2, 3, 3, 4]


def test_a_chain_of_retries_expires(spark):
    ops = spark.createDataFrame([(1, "a", i, i * 60) for i in range(6)] + [(1, "b", 9, 60)], "key long, op string, seq long, at long").selectExpr("key", "op", "seq", "timestamp_seconds(at) AS ts")
    got = {r.seq: r.state for r in streams.replayed(ops, 150).collect()}
    assert [got[i] for i in range(6)] == ["new", "replay", "replay", "new", "replay", "replay"] and got[9] == "new"


def test_noise_is_the_same_however_it_is_dealt(spark):
    one = sorted(map(tuple, stats.noise_simulation(spark, [0.1, 0.3], 300).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, stats.noise_simulation(spark, [0.1, 0.3], 300).repartition(7).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one != sorted(map(tuple, stats.noise_simulation(spark, [0.1, 0.3], 300, seed=2).collect()))


def test_splice_makes_extents(spark):
    old = spark.createDataFrame([(1, 5, 0, 10), (1, 6, 10, 10), (1, 7, 20, 5), (2, 8, 0, 9)], "file long, block long, off long, len long")
    version = spark.createDataFrame([(1, 3), (2, 1)], "file long, version long")

    def after(*edits):
        return sorted((r.file, r.off, r.block, r.len) for r in extents.spliced(old, spark.createDataFrame(list(edits), "file long, expected long, lo long, hi long, block long, len long"), version).collect())

    same = [(1, 0, 5, 10), (1, 10, 6, 10), (1, 20, 7, 5), (2, 0, 8, 9)]
    assert after((1, 3, 10, 20, 99, 3), (2, 0, 0, 9, 98, 1)) == [(1, 0, 5, 10), (1, 10, 99, 3), (1, 13, 7, 5), (2, 0, 8, 9)]
    assert after((1, 2, 10, 20, 99, 3)) == after((1, 3, 10, 19, 99, 3)) == same  # a conflict, an unaligned range

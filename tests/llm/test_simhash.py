import random
import re

import numpy as np
import xxhash

from stonefold.llm import components
from stonefold.llm.components import connected_components
from stonefold.llm.simhash import BkForest, fingerprint, keep_one, links, near_duplicates, shard_masks


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return [find(x) for x in range(n)]


def clustered(rng, n):
    """Fingerprints of which many lie within a few bits of each other."""
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    return list(out)[:n]


def test_forest_and_masks_equal_brute_force():
    rng = random.Random(2)
    fps = sorted(clustered(rng, 400))
    near = [(i, j) for i in range(400) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert BkForest(np.array(fps, np.uint64), np.zeros(400, np.int64)).search().tolist() == roots(400, near)
    for n in (10, 10**7, 10**10):
        assert all(any(fps[i] & m == fps[j] & m for m in shard_masks(n)) for i, j in near)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(161, pairs)
    assert found == {i: r for i, r in enumerate(want) if r != i}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_in_rounds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK_LINKS", 10)
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(300, 380)] + [(400, i) for i in range(401, 480)]
    rng.shuffle(pairs)
    found = [(r.node, r.root) for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()]
    want = roots(480, pairs)
    assert sorted(found) == [(i, r) for i, r in enumerate(want) if r != i]


def test_few_links_are_joined_up_without_rounds(spark):
    """The driver's memory follows the stages and tasks, of which a round has many."""
    df = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "components")
    try:
        found = connected_components(df)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5
    assert found.count() == 500 and [r.root for r in found.select("root").distinct().collect()] == [0]


def test_links_join_up_all_near_fingerprints(spark):
    rng = random.Random(9)
    fps = sorted(clustered(rng, 300))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    at = {f: i for i, f in enumerate(signed)}
    for n in (300, 10**7):
        found = [(at[r.a], at[r.b]) for r in links(df, n).collect()]
        near = [(i, j) for i in range(300) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        assert roots(300, found) == roots(300, near)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=400) for _ in range(8)]
    docs = [(1, None), (2, " \n"), (3, "one"), (4, "One two"), (None, "one two"), (None, "alone é"), (9, "same here now"), (9, "same here now"), (10, "x " * 70_000)]
    for i in range(60):
        some = list(base[i % 8])
        some[rng.randrange(400)] = f"e{rng.randrange(3)}"
        docs.append((100 + i, " ".join(some)))
    fps = [brute_fingerprint(t) for _, t in docs]
    assert [fingerprint(t or "") for _, t in docs] == fps
    root = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {r: min((d for (d, _), x in zip(docs, root, strict=True) if x == r and d is not None), default=None) for r in root}
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, fp int, component_id string").repartition(4)
    found = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert found == sorted(((d, f, least[r]) for (d, _), f, r in zip(docs, fps, root, strict=True)), key=str)
    kept = keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for (d, _), r in zip(docs, root, strict=True) if d is None or d == least[r])
    assert near_duplicates(df.limit(0)).collect() == [] and kept[0].__fields__ == df.columns

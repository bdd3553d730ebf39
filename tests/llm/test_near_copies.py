import random

import pytest

from stonefold.llm import near_copies
from stonefold.llm.near_copies import keep_one


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("chunks", [(200_000, 1_000_000), (300, 700)])
def test_keep_one_equals_brute_force(spark, monkeypatch, chunks):
    monkeypatch.setattr(near_copies, "REST_CHUNK", chunks[0])
    monkeypatch.setattr(near_copies, "ALL_CHUNK", chunks[1])
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.choice([40, 120, 400])) for _ in range(12)]
    docs = [(1, None), (2, " "), (3, "one two"), (4, "One  two"), (None, "one two"), (9, "same here"), (9, "same here")]
    for i in range(150):
        some = list(base[i % 12])
        for _ in range(rng.randrange(1 + len(some) // 20)):
            some[rng.randrange(len(some))] = f"e{rng.randrange(99)}"
        docs.append((100 + i, " ".join(some)))
    sets, of = [grams(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            like = len(a & b) >= 0.8 * len(a | b)
            if like and docs[i][0] is not None and docs[j][0] is not None:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    want = sorted(str(d) for k, (d, _) in enumerate(docs) if d is None or d == min(e for m, (e, _) in enumerate(docs) if of[m] == of[k] and e is not None))
    assert 20 < len(want) < 120
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(4)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
    assert keep_one(df.limit(0)).collect() == []


def test_the_pipeline_drops_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rng = random.Random(3)
    text = [f"w{rng.randrange(5000)}" for _ in range(100)]
    near = list(text)
    near[50] = near[20] = "changed"
    a, b = grams(" ".join(text)), grams(" ".join(near))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()] == [1]

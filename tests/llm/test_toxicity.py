import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stonefold.llm import toxicity
from stonefold.llm.toxicity import Model, examples, keep_non_toxic, learn, score, word_counts, words_of

INSULTS = ["moron", "scum", "clown"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = [a + b + c for a in ("al", "Be", "gam", "ün", "x1") for b in ("ta", "ro", "mi", "né") for c in ("", "s", "ka", "lo", "di", "pu", "we")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 2
        words = rng.choices(plain, k=rng.randrange(20, 80))
        for w in rng.sample(INSULTS, rng.randrange(1, 3)) if toxic else []:
            words.insert(rng.randrange(len(words)), rng.choice([w, w.upper() + "!!", w + "###"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    # near copies of one toxic document, whose other words tell nothing
    docs += [(10_000 + i, "peculiar words go together scum " + str(i)) for i in range(60)]
    labels += [(10_000 + i, 1, 1) for i in range(60)]
    return docs, labels


def brute(rows, queries, k=15):
    """Scores without calibration and evidence, from raw texts, by the definitions alone; `rows`: (doc_id, text, label)."""
    n, counts = len(rows), [Counter(words_of(t.lower())) for _, t, _ in rows]
    df = Counter(w for c in counts for w in c)

    def vector(c, weight):
        v = {w: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[w])) + 1) * weight.get(w, toxicity.FLOOR) for w, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items())

    plain = [vector(c, dict.fromkeys(df, 1.0)) for c in counts]
    leader = list(range(n))
    for i in range(n):
        near = [j for j in range(i) if leader[j] == j and rows[j][2] == rows[i][2] and cosine(plain[i], plain[j]) >= toxicity.COPY]
        leader[i] = near[0] if near else i
    alone = [i for i in range(n) if leader[i] == i]
    base = sum(rows[i][2] for i in alone) / len(alone)
    weight, z = {}, toxicity.CONFIDENCE
    for w in df:
        mine = [rows[i][2] for i in alone if w in counts[i]]
        size, p = max(len(mine), 1), sum(mine) / max(len(mine), 1)
        low = (p + z * z / (2 * size) - z * math.sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)
        weight[w] = toxicity.FLOOR + (1 - toxicity.FLOOR) * max(0, (low - base) / (1 - base))
    share, vectors = [1 / leader.count(x) for x in leader], [vector(c, weight) for c in counts]
    out = []
    for text in queries:
        q = vector(Counter(words_of(text.lower())), weight)
        near = sorted(((cosine(q, v), i) for i, v in enumerate(vectors)), reverse=True)
        near = [x for x in near if x[0] > 0]
        out.append((near, share, base, [r[0] for r in rows], [r[2] for r in rows]))
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("dense", [0, 3, 512])
def test_neighbours_and_votes_are_those_of_brute_force_from_raw_texts(spark, monkeypatch, block, dense):
    monkeypatch.setattr(toxicity, "DENSE_WORDS", dense)
    docs, labels = corpus(150)
    lab = {i: t for i, _, t in labels}
    rows = [(i, t, lab[i]) for i, t in sorted(docs) if i in lab and zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = Model(word_counts(examples(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))))
    index = model.index
    if block != index.block:
        at = np.repeat(np.arange(len(rows)), [len(set(words_of(t.lower()))) for _, t, _ in rows])
        pairs = [(model.terms[w], c) for _, t, _ in rows for w, c in Counter(words_of(t.lower())).items()]
        weight = index.scale / (math.log(1 + len(rows)) - np.log1p(index.df) + 1)
        share = dict(zip(index.ids.tolist(), index.share.tolist()))
        index = toxicity.Index(np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float), np.array([share[r[0]] for r in rows]), at, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float), weight, block)
    queries = [t for _, t in docs[:25]] + ["moron", "nothing known here qq", "peculiar words", "SCUM scum scum alta"]
    got = index.votes([model.query(t) for t in queries])
    cosines = index.nearest([model.query(t) for t in queries])
    for (vote, places), (found, _), (near, share, base, ids, label) in zip(got, cosines, brute(rows, queries), strict=True):
        top = near[: toxicity.NEIGHBOURS]
        assert found.tolist() == pytest.approx([c for c, _ in top], abs=1e-8)
        clear = {ids[i] for c, i in near if top and c > top[-1][0] + 1e-8}  # without those that tie for the last place
        assert clear <= set(index.ids[places].tolist()) <= {ids[i] for c, i in near if c >= top[-1][0] - 1e-8} if top else not len(places)
        if len(near) <= toxicity.NEIGHBOURS or top[-1][0] > near[toxicity.NEIGHBOURS][0] + 1e-8:
            w = [share[i] / (1 - c + toxicity.SOFTEN) for c, i in top]
            want = (toxicity.BASE_VOTE * base + sum(x * label[i] for x, (_, i) in zip(w, top))) / (toxicity.BASE_VOTE + sum(w))
            assert vote == pytest.approx(want, abs=1e-6)
    assert [s for s, _ in model.score(queries)] == pytest.approx([model.calibrated(v) for v, _ in model.index.votes([model.query(t) for t in queries])])


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = corpus(1500)
    df = spark.createDataFrame([(*d, 0.5, "q") for d in docs], "doc_id long, text string, score double, lang string").repartition(4)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (4, 1, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = learn(df, lab)
    truth = {i: any(w in t.lower() for w in INSULTS) for i, t in docs}
    rows = score(df, model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.score >= 0.5) == truth[r.doc_id] and 0 <= r.score <= 1
        assert r.evidence and all(zlib.crc32(str(e).encode()) % 5 for e in r.evidence)
    held = [r for r in rows if not zlib.crc32(str(r.doc_id).encode()) % 5]
    # the mean score is the share of toxic documents, of all and of either side
    for side in (held, [r for r in held if r.score >= 0.5], [r for r in held if r.score < 0.5]):
        assert sum(r.score for r in side) / len(side) == pytest.approx(sum(truth[r.doc_id] for r in side) / len(side), abs=0.06)
    kept = keep_non_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t in truth.items() if not t}


def test_examples_are_bounded_in_rows(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame([(i, t + x) for i, t in docs for x in ("", " b", " a")] + [(1, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    rows = examples(df, lab, 100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 100
    plain = dict(docs)
    assert all(r.text == ("" if r.doc_id == 1 else plain[r.doc_id]) for r in rows)  # the least text


def test_copies_share_one_vote(spark):
    docs, labels = corpus(300)
    model = learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    copies = model.index.ids >= 10_000
    assert copies.sum() > 40 and model.index.share[copies].sum() == pytest.approx(1)
    telling = {w for w, i in model.terms.items() if model.index.scale[i] > 0.5 * model.index.scale.max()}
    assert telling == set(INSULTS)  # words that merely come along in the copies weigh little


def test_ends(spark):
    docs, labels = corpus(1500)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "MORON"), (3, "moron " * 50_000), (3, "moron " * 50_000), (5, "### 123")], "doc_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = score(odd, model).collect()
    assert [r.score >= 0.5 for r in rows] == [False, False, True, True, True, False] and rows[3] == rows[4]
    assert rows[0].evidence == rows[1].evidence == rows[5].evidence == [] and rows[0].score == rows[5].score
    assert score(odd.limit(0), model).collect() == []
    for some in ([], [(i, q, 0) for i, q, _ in labels], [(i, q, 1) for i, q, _ in labels]):  # no label, or one only
        model = learn(df, spark.createDataFrame(some, "doc_id long, quality int, toxic int"))
        assert [r.score >= 0.5 for r in score(odd, model).collect()] == [bool(some and some[0][2])] * 6
    nothing = learn(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.score for r in score(odd, nothing).collect()] == [0.0] * 6

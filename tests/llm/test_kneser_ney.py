import math
import random
from collections import Counter, defaultdict

import pytest

from stonefold.llm import kneser_ney as kn


def brute_model(trusted, order=kn.ORDER):
    """Interpolated modified Kneser-Ney over bytes, straight from the definition: a function p(gram)."""
    counts = {order: Counter()}
    for t in trusted:
        b = kn.PAD + t.encode()
        counts[order].update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, totals = {}, {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        cut[n] = {i: min(i - 0.05, max(0.05, i - (i + 1) * y * m[i + 1] / m[i])) if y is not None and m[i] else i / 2 for i in (1, 2, 3)}
        totals[n] = defaultdict(lambda: [0, 0.0])
        for g, k in c.items():
            totals[n][g[:-1]][0] += k
            totals[n][g[:-1]][1] += cut[n][min(k, 3)]

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 256
        total, mass = totals[n].get(g[:-1], (0, 0))
        k = counts[n].get(g, 0)
        return ((k - cut[n][min(k, 3)] if k else 0) + mass * lower) / total if total else lower

    return p


def corpus(rng, n):
    words = {"en": ["the", "and", "thing", "hand", "with"], "fr": ["le", "été", "que", "dans"], None: ["und", "der", "ß"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang], k=rng.randrange(1, 60)))
        out.append((i, text if i % 6 else "".join(rng.choices("#$%XQ|9", k=200)), lang))
    return out


def test_scores_equal_the_definition(spark):
    rng = random.Random(2)
    docs = corpus(rng, 120) + [(500, None, "en"), (501, "", "fr"), (None, "the hand", "en"), (7, "and again", "en"), (7, "and again", "en"), (502, "a\n\n\n\nb é" * 900, "en")]
    trusted = [(i,) for i in range(120) if i % 6 and i % 2] + [(None,), (3,)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, block int").repartition(4)
    rows = kn.classify(df, spark.createDataFrame(trusted, "doc_id long")).collect()
    assert len(rows) == len(docs)
    ids = {i for i, in trusted if i is not None}
    p = brute_model([t or "" for i, t, _ in docs if i in ids])
    bits = {}
    for i, t, lang in docs:
        b = kn.PAD + (t or "").encode()
        bits[i, lang, len(b) - 4] = -sum(math.log2(p(b[k - 4 : k + 1])) for k in range(4, len(b)))
    means = {}
    for lang in ("en", "fr", None, "all"):
        some = [(bits[i, x, len((t or "").encode())], len((t or "").encode())) for i, t, x in docs if i in ids and lang in (x, "all")]
        means[lang] = (sum(a for a, _ in some) / sum(b for _, b in some), len(some))
    for r in rows:
        mean = means[r.lang][0] if means[r.lang][1] >= kn.MIN_TRUSTED else means["all"][0]
        assert r.score == pytest.approx((bits[r.doc_id, r.lang, r.n_bytes] + 64 * mean) / (r.n_bytes + 64), rel=1e-4)
    for lang in ("en", "fr", None):  # thresholds by sorting the trusted scores
        own = sorted(r.score for r in rows if r.lang == lang and r.doc_id in ids)
        most = math.ceil(own[math.ceil(kn.QUANTILE * len(own)) - 1] / kn.RESOLUTION) * kn.RESOLUTION * kn.SLACK
        weight = min(1, len(own) / kn.MIN_TRUSTED)
        want = max(most, most * weight + kn.UNKNOWN_BITS * (1 - weight))
        for r in rows:
            if r.lang == lang:
                assert r.threshold == pytest.approx(want) and r.rejected == (r.n_bytes > 0 and r.score > r.threshold)
    junk = {r.doc_id: r.rejected for r in rows if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 6 == 0}
    assert all(junk.values()) and sum(r.rejected for r in rows if r.doc_id not in junk) <= 3
    assert not any(r.rejected for r in rows if r.n_bytes == 0)
    kept = kn.keep_quality(df, spark.createDataFrame(trusted, "doc_id long"))
    assert kept.columns == df.columns and kept.count() == len(docs) - sum(r.rejected for r in rows)


def test_ends(spark):
    df = spark.createDataFrame([(1, "x", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long")
    rows = kn.classify(df, none).collect()
    assert [r.rejected for r in rows] == [False, False] and rows[0].score is None
    assert kn.classify(df.limit(0), none).collect() == []


@pytest.mark.parametrize("n_trusted", [0, 5])
def test_a_language_with_little_trusted_text_keeps_its_clean_documents(spark, n_trusted):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["the", "and", "thing", "hand", "with"], k=50)), "en") for i in range(60)]
    docs += [(100 + i, " ".join("".join(rng.choices("bcdfgjklmpquvxyz", k=6)) for _ in range(40)), "xx") for i in range(20)]
    trusted = [(i,) for i in range(60)] + [(100 + i,) for i in range(n_trusted)]
    rows = kn.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(trusted, "doc_id long")).collect()
    assert len(rows) == 80 and (n_trusted == 0 or all(r.score < 8 for r in rows)) and not any(r.rejected for r in rows)


def test_probabilities_sum_to_one(spark):
    text = "abracadabra abra cadabra"
    p = brute_model([text])
    for h in (b"abra", b"zzzz", b"\n\n\n\n"):
        assert sum(p(h + bytes([w])) for w in range(256)) == pytest.approx(1)


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs = corpus(random.Random(6), 80) + [(900, "the hand with the thing " * 4000, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(80) if i % 6], "doc_id long")
    read = lambda: sorted((r.doc_id, round(r.score, 5), r.rejected) for r in kn.classify(df, trusted).collect())
    one = read()
    monkeypatch.setattr(kn, "BLOCK_BYTES", 500)
    assert read() == one


def test_quantiles_are_exact_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.random() * 5) for _ in range(999)]
    for parts in (1, 7):
        found = {r.lang: (r.value, r.n) for r in kn.quantiles(spark.createDataFrame(rows, "lang string, score double").repartition(parts), 0.9).collect()}
        for lang in ("a", None):
            own = sorted(s for x, s in rows if x == lang)
            assert found[lang] == (pytest.approx(math.ceil(own[math.ceil(0.9 * len(own)) - 1] / kn.RESOLUTION) * kn.RESOLUTION), len(own))

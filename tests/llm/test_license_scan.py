import random
import re
from collections import defaultdict

import pytest

from stonefold.llm.license_scan import TEMPLATES, scan


def brute(docs, templates):
    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)]
    best = defaultdict(list)
    for doc_id, text in docs:
        s = grams(text)
        for name, template in templates:
            own = set(grams(template))
            if not own:
                continue
            n, stride = len(own), max(1, len(own) // 2)
            for first in range(0, max(1, len(s)), stride):
                share = len(own & set(s[first : first + 2 * n])) / n
                if share >= 0.8:
                    best[doc_id, name].append((share, -first))
    return sorted(((d, x, max(v)[0], -max(v)[1], len(v)) for (d, x), v in best.items()), key=str)


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    noise = [f"w{i}" for i in range(50)]
    docs = [(1, None), (2, ""), (3, "MIT License."), (4, "released UNDER the\nmit license!"), (None, TEMPLATES[0][1]), (5, "filler words here " * 30_000 + TEMPLATES[4][1])]
    for i in range(10, 120):
        body = rng.choices(noise, k=rng.randrange(1, 90))
        for _, text in rng.sample(TEMPLATES, rng.randrange(3)):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(noise)
            at = rng.randrange(len(body))
            body[at:at] = words
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, license string, n int").repartition(4)
    found = sorted(((r.doc_id, r.license, pytest.approx(r.containment), r.first_word, r.n_windows) for r in scan(df).collect()), key=lambda r: str((r[0], r[1])))
    assert [(a, b, c, d, e) for a, b, c, d, e in sorted(brute(docs, TEMPLATES), key=lambda r: str((r[0], r[1])))] == found
    assert scan(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        scan(df, [("none", "too short")])
    again = scan(df.union(df)).where("doc_id = 4").collect()
    assert len(again) == 1 and again[0].license == "MIT"


@pytest.mark.parametrize("n_words", [3, 6, 10])
def test_notices_with_words_put_in_are_found(spark, n_words):
    rng, docs = random.Random(n_words), []
    notices = [(name, text) for name, text in TEMPLATES if len(text.split()) > 27]
    assert len(notices) >= 4
    for i in range(400):
        words = notices[i % len(notices)][1].split()
        at = rng.randrange(len(words))
        words[at:at] = [f"x{k}" for k in range(n_words)]
        docs.append((i, " ".join(f"y{k}" for k in range(rng.randrange(60))) + " " + " ".join(words)))
    found = {(r.doc_id, r.license) for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all((i, notices[i % len(notices)][0]) in found for i in range(400))

import random
import re
from collections import Counter

import pytest

from stonefold.llm.quality_rules import figures, host_rates, judge, with_failures


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\nx \n y\n#|<>", "é ß 🙂\x0b日本 \x1c", "a b c d a b c e a b c", "word " * 30_000, "\n".join(["same line"] * 50)]


def test_figures_equal_brute_force(spark):
    rng = random.Random(1)
    some = TEXTS + [" ".join(rng.choices(["a", "b", "c", "d$", "e\n"], k=rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "h", 1) for i, t in enumerate(some)], "doc_id long, text string, source string, w int").repartition(4)
    rows = {r.doc_id: r for r in figures(df).collect()}
    for i, t in enumerate(some):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_host_verdicts(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "too few"
    docs = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 10 else bad, "good") for i in range(200)] + [(5000 + h, bad, f"lone{h}") for h in range(3)] + [(7000 + h, good, f"fine{h}") for h in range(3)]
    df = spark.createDataFrame([*docs, (1, bad, "bad")], "doc_id long, text string, source string")
    rows = judge(df).collect()
    assert len(rows) == 407
    for r in rows:
        assert r.host_rejected == (r.host == "bad" or r.host.startswith("lone") and r.host_rejected)
        assert r.kept == (not r.base_failed and r.host != "bad")
    rates = {(r.host, r.rule): r.rate for r in host_rates(with_failures(figures(df))).collect()}
    assert 0.45 < rates["lone0", "few_words"] < 1 and rates["bad", "few_words"] == pytest.approx(0.9, abs=0.02)
    assert judge(df.limit(0)).collect() == []

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

PLAIN = [a + b + e for a in ("al", "be", "gam", "no", "ri") for b in ("ta", "ro", "mi", "ne") for e in ("", "s", "ka", "lo", "di", "pu", "we")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus whose clean, junk, toxic and copied documents are known."""
    rng = random.Random(5)
    kinds, docs, labels = {}, [], []

    def add(kind, text, lang="en"):
        i = len(docs)
        kinds[i] = kind
        docs.append((i, text, lang, f"src{i % 3}", len(text)))
        if kind in ("clean", "junk", "toxic") and i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))

    clean = lambda n: " ".join(rng.choices(PLAIN, k=n))
    for i in range(900):
        words = clean(rng.randrange(60, 160)).split()
        if i % 9 == 0:
            add("junk", "".join(rng.choices("#$%&QXZ|0987", k=400)))
        elif i % 9 == 1:
            for w in rng.sample(["moron", "scum", "clown"], 2):
                words.insert(rng.randrange(len(words)), w)
            add("toxic", " ".join(words))
        else:
            add("clean", " ".join(words))
    copied, near = clean(300), clean(900).split()
    for i in range(20):
        add("copy", copied.upper() if i == 3 else copied)
    for i in range(10):
        words = list(near)
        words[i * 7] = "alta"
        add("near", " ".join(words))
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), kinds, docs


def test_each_stage_drops_its_own_and_keeps_the_clean(spark, corpus):
    folder, kinds, docs = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, df, folder)
        assert kept.columns == df.columns
        left[name] = [kinds[r.doc_id] for r in kept.select("doc_id").collect()]
    count = lambda name, kind: left[name].count(kind)
    total = {k: list(kinds.values()).count(k) for k in set(kinds.values())}
    assert count("quality_classifier", "junk") == 0 and count("quality_classifier", "clean") >= 0.98 * total["clean"]
    assert count("toxicity", "toxic") == 0 and count("toxicity", "clean") == total["clean"]
    assert len(left["exact_dedup"]) == len({d[1].lower() for d in docs})
    assert count("simhash_near_dedup", "copy") == 1 and count("simhash_near_dedup", "near") <= 3 and count("simhash_near_dedup", "clean") == total["clean"]


def test_run_packs_what_is_left(spark, corpus):
    folder, kinds, _ = corpus
    rows = c.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert not any(kinds[i] in ("junk", "toxic") for i in ids)
    assert sum(kinds[i] == "copy" for i in ids) == 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in slots) <= 4096 for slots in by.values())
    assert len(by) <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_two_runs_do_not_share_a_folder(spark, corpus, tmp_path, monkeypatch):
    folder, _, docs = corpus
    monkeypatch.setattr(c, "shared_folder", lambda _: str(tmp_path))
    first, second = c.run(spark, folder), c.run(spark, folder)
    assert first.count() == second.count() > 0 and not list(tmp_path.iterdir())
    small = tmp_path / "in"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(small / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(small / "labels.parquet"))
    assert c.run(spark, str(small)).collect() == []  # an empty table


def test_stages_take_nulls_repeats_and_clashing_columns(spark, corpus):
    folder, kinds, docs = corpus
    clean = next(d[1] for d in docs if kinds[d[0]] == "clean")
    odd = [(None, clean + " one more", None, None), (3, None, "en", 1), (3, None, "en", 1), (4, "", "fr", 2), (5, clean, "en", 3), (5, clean, "en", 3), (6, clean + "".join(f" {a}{b}" for a in PLAIN for b in PLAIN), "en", 4)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, score long").withColumns({"band": F.lit(1), "fp": F.lit("x"), "rejected": F.lit(None).cast("boolean"), "root": F.lit(7), "v": F.lit(0)})
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, df, folder)
        assert kept.columns == df.columns and stage(spark, df.limit(0), folder).collect() == [], name
        found = sorted((r.doc_id or 0) for r in kept.collect())
        assert found == {"exact_dedup": [0, 4, 5, 6], "simhash_near_dedup": [0, 3, 3, 5, 5, 6]}.get(name, found), name
        assert {0, 5} <= set(found), name
    assert {r.doc_id for r in c.packed(spark, df, folder).collect()} == {None, 3, 4, 5, 6}


def test_entry_without_the_folder():
    root = Path(__file__).resolve().parents[2]
    assert os.path.exists(root / "corpus_pipeline.py") and "corpus_pipeline" in (root / "__spark_entry__.py").read_text()

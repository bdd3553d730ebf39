import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stonefold.llm.packing import CAPACITY, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    """Item by item: how many sequences."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_item_by_item(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.paretovariate(0.8))) for _ in range(400)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, n_sequences = plan(histogram, 64)
    assert n_sequences == best_fit_decreasing(lengths, 64)
    assert plan({}, 64)[1] == 0


def check_packed(rows, docs):
    own = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k, s, len(c), zlib.crc32(c.tobytes())) for k, s in enumerate(range(0, len(ids), CAPACITY)) for c in [ids[s : s + CAPACITY]]]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(by)


def test_pack_matches_the_library_and_leaves_no_gap(spark):
    rng = random.Random(7)
    words = ["alpha", "Béta", "don't", "x" * 40, "12345", "日本", "<|endoftext|>", "a b", "é", "ΣΑΣ"]
    docs = [(1, None), (2, ""), (3, " \n\t "), (None, "null id"), (5, "same"), (5, "same"), (6, "word " * 9000), (7, "w" * 5000)]
    docs += [(i, " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(10, 60)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, length string, part int").repartition(3)
    rows = pack(df, PATH).collect()
    n = check_packed(rows, docs)
    assert n == best_fit_decreasing([r.length for r in rows], CAPACITY)


def test_pack_of_an_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_a_vocabulary_of_other_rules_is_refused(tmp_path):
    import json

    import public_tokenizers

    from stonefold.llm.packing import WordTokenizer

    settings = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    settings["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(settings))
    with pytest.raises(ValueError):
        WordTokenizer(str(tmp_path / "other.json"))

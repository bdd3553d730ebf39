import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stonefold.functions import chunking as c

LEAST, AVERAGE, MOST = 256, 1024, 4096


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(0, 5))
def test_chunks_are_the_input_and_within_bounds(data, repeat):
    data = data * (repeat + 1)
    ends = c.cuts(data, LEAST, AVERAGE, MOST)
    assert ends == c.cuts(bytes(data), LEAST, AVERAGE, MOST)
    if not data:
        assert ends == []
        return
    starts = [0, *ends[:-1]]
    assert b"".join(data[a:b] for a, b in zip(starts, ends, strict=True)) == data
    sizes = [b - a for a, b in zip(starts, ends, strict=True)]
    assert all(s <= MOST for s in sizes) and all(s > LEAST for s in sizes[:-1])


def test_an_insertion_changes_few_chunks():
    data = random.Random(1).randbytes(400_000)
    ids = lambda d: {hashlib.sha256(d[a:b]).digest() for e in [c.cuts(d, LEAST, AVERAGE, MOST)] for a, b in zip([0, *e[:-1]], e, strict=True)}
    before, after = ids(data), ids(data[:200_000] + b"inserted" + data[200_000:])
    assert len(before - after) <= 5
    mean = 400_000 / len(before)
    assert AVERAGE / 2 < mean < AVERAGE * 2.5


def test_a_boundary_does_not_look_before_its_chunk():
    data = random.Random(2).randbytes(100_000)
    ends = c.cuts(data, LEAST, AVERAGE, MOST)
    assert c.cuts(data[ends[3] :], LEAST, AVERAGE, MOST) == [e - ends[3] for e in ends[4:]]


def test_chunk_rows(spark):
    text = "".join(random.Random(3).choices("abcdef", k=30_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None)], "ino long, content string")
    rows = c.chunk(df, "content", LEAST, AVERAGE, MOST).collect()
    assert {r.ino for r in rows} == {1, 2} and sum(r.size for r in rows if r.ino == 1) == 30_000
    assert sorted(r.id for r in rows if r.ino == 1) == sorted(r.id for r in rows if r.ino == 2)
    assert all(r.stored <= r.size for r in rows)

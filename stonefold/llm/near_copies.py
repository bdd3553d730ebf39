"""Near copies by the exact Jaccard similarity of word shingles.

Documents are linked if the sets of their 5-word shingles have a similarity of
0.8 or more; components of links keep their least doc_id. Candidates are the
groups of `simhash.near_duplicates` (radius 3, too tight alone: most pairs of
similarity 0.8 lie at 2 to 11 bits) and all that share one of 20 MinHash bands
of 4 rows. A pair of similarity 0.8 shares none with probability
(1 - 0.8^4)^20 < 0.00003. Each pair that links is verified by its shingle sets
(as 64-bit hashes).

Bands of the same members count once. First each member of a band is compared
with the band's least one, a row of a join that adaptive execution can split;
verified pairs join up components. Where a band still has several, the members
outside of its largest component are compared with all of the band, in tasks of
bounded size: chunks of the former meet chunks of the latter, each task finds
the similarities from an index of its shingles, and returns links alone. So
every two members of different components are compared, and a group of n copies
of which r are unlike the least makes about n + r rows and, beyond the size of
a chunk, n * r / chunk.

Defined results: a null text is the empty text; texts without words are like
each other; a text with fewer words than a shingle is one shingle; rows without
doc_id stay and link nothing; rows of one doc_id stay or go together, and are
linked with what any of them is like; very long texts are compared whole; an
empty table gives an empty table. Only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.llm import simhash
from stonefold.llm.common import checkpoint, claim, release, spread, texts
from stonefold.llm.components import connected_components

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
BANDS, ROWS = 20, 4
SEED = 42
#: Shingles of a chunk of members outside of the largest component, and of a chunk of all members.
REST_CHUNK, ALL_CHUNK = 200_000, 1_000_000


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the text's word shingles, sorted."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :], strict=False)] or [digest(joined, SEED)], np.uint64))


_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MULTIPLY = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band's number and minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512, None] ^ _XOR) * _MULTIPLY).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, v and band, a row for each band, of `rows(doc_id, v, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            found = np.concatenate([np.zeros(0, np.int64), *(bands(shingles(t)) for t in texts(batch.column(2)))])
            keys = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS), pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found)], names=["doc_id", "v", "band"])

    return spread(rows).mapInArrow(run, "doc_id long, v long, band long")


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, v and set of the rows whose (doc_id, v) are `wanted`, each once."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            found = [shingles(t).view(np.int64) for t in texts(batch.column(2))]
            ends = np.cumsum([0, *(len(x) for x in found)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["doc_id", "v", "set"])

    # repeated rows are reduced to one a partition before they meet
    some = rows.mapInArrow(one, rows.schema).join(wanted, ["doc_id", "v"], "left_semi")
    return some.dropDuplicates(["doc_id", "v"]).select("doc_id", "v", "text").mapInArrow(run, "doc_id long, v long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), the doc_ids of the `pairs(a, av, b, bv)` that are similar."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("v").alias(f"{c}v"), F.col("set").alias(f"{c}set")) for c in "ab")
    both = F.size(F.array_intersect("aset", "bset"))
    # the pivots, few and shared by many pairs, come last: a hot one is split
    return pairs.join(right, ["b", "bv"]).join(left, ["a", "av"]).where(both >= MIN_JACCARD * (F.size("aset") + F.size("bset") - both)).select("a", "b")


def compared(chunks: DataFrame) -> DataFrame:
    """Links (a, b) between the `rest` and the other members of each chunk pair of `chunks(band, i, j, rest, doc_id, root, set)`."""

    def found(rows: list[tuple[bool, int, int, np.ndarray]]) -> pa.RecordBatch:
        a, b = ([r for r in rows if r[0] is side] for side in (True, False))
        ids, roots, sizes = (np.array(x, np.int64) for x in ([r[1] for r in b], [r[2] for r in b], [len(r[3]) for r in b]))
        tokens = np.concatenate([np.zeros(0, np.int64), *(r[3] for r in b)])
        owner = np.repeat(np.arange(len(b)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        left, right = [], []
        for _, doc_id, root, own in a:
            start, end = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            n = end - start
            where = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[where], minlength=len(b))
            near = (both >= MIN_JACCARD * (len(own) + sizes - both)) & (roots != root)
            left += [doc_id] * int(near.sum())
            right.append(ids[near])
        # a link for each two components is enough
        root_of = {r[1]: r[2] for r in rows}
        pairs = {(root_of[x], root_of[y]): (x, y) for x, y in zip(left, np.concatenate([np.zeros(0, np.int64), *right]).tolist(), strict=True)}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs.values()], pa.int64()), pa.array([y for _, y in pairs.values()], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_copies")
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            values = zip(*(batch.column(k).to_pylist() for k in range(3, 6)), strict=True)
            for i, (key, (rest, doc_id, root)) in enumerate(zip(keys, values, strict=True)):
                if key != now and held:
                    yield found(held)
                    held = []
                now = key
                held.append((rest, doc_id, root, batch.column(6)[i].values.to_numpy()))
        if held:
            yield found(held)

    return chunks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` with the `root` of each."""
    return checkpoint(members.join(roots, F.col("doc_id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "doc_id")))


def near_copies(docs: DataFrame) -> DataFrame:
    """(node, root) of every doc_id that is not the least of its component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), "text")
    grouped = simhash.near_duplicates(rows, keep=("v",)).select("doc_id", "v", F.xxhash64(F.lit("simhash"), "component_id").alias("band"))
    signed = checkpoint(signatures(rows).union(grouped))
    own = F.xxhash64("doc_id", "v")
    # joins by band are of plain tables, so that adaptive execution can split a hot one
    shared = checkpoint(signed.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("band"))
    signed = checkpoint(signed.join(shared, "band").distinct())
    groups = signed.groupBy("band").agg(F.count("*").alias("n"), F.sum(own.cast("decimal(20,0)")).alias("sum"), F.bit_xor(own).alias("xor"), F.min(F.struct("doc_id", "v")).alias("least"))
    groups = checkpoint(groups.groupBy("n", "sum", "xor").agg(F.min(F.struct("band", "least")).alias("g")).select("g.band", "g.least"))
    members = checkpoint(signed.join(groups, "band").select("band", "doc_id", "v", "least"))
    del grouped, signed, shared, groups
    release(docs.sparkSession)
    sets = checkpoint(shingle_sets(rows, members.select("doc_id", "v").distinct()))
    release(docs.sparkSession)
    pairs = members.where("doc_id <> least.doc_id").select(F.col("least.doc_id").alias("a"), F.col("least.v").alias("av"), F.col("doc_id").alias("b"), F.col("v").alias("bv")).distinct()
    roots = checkpoint(connected_components(verified(checkpoint(pairs), sets)))
    del pairs

    now = rooted(members.select("band", "doc_id", "v").join(sets.select("doc_id", "v", F.size("set").alias("size")), ["doc_id", "v"]), roots)
    of_root = now.groupBy("band", "root").agg(F.sum(F.col("size") + 1).alias("size"))
    open_bands = of_root.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most"), F.count("*").alias("roots")).where("roots > 1")
    pieces = lambda size, chunk: F.ceil(size / chunk).cast("int")
    open_bands = checkpoint(open_bands.select("band", "largest", pieces(F.col("all") - F.col("most"), REST_CHUNK).alias("n_i"), pieces(F.col("all"), ALL_CHUNK).alias("n_j")))
    left = checkpoint(now.join(open_bands, "band"))
    del members, now, of_root, open_bands
    release(docs.sparkSession)
    dealt = F.xxhash64("doc_id", "v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = left.where("root <> largest").select("band", F.pmod(dealt, "n_i").cast("int").alias("i"), every("n_j").alias("j"), F.lit(True).alias("rest"), "doc_id", "root", "v")
    all_of = left.select("band", every("n_i").alias("i"), F.pmod(dealt, "n_j").cast("int").alias("j"), F.lit(False).alias("rest"), "doc_id", "root", "v")
    more = compared(rest.union(all_of).join(sets, ["doc_id", "v"]).select("band", "i", "j", "rest", "doc_id", "root", "set"))
    return connected_components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for those whose component has a smaller doc_id."""
    return docs.join(near_copies(docs).select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)

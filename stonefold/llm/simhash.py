"""SimHash near-duplicate detection over forests of BK-trees.

A fingerprint's bit is set if it is set in over half the XXH64 hashes of the
text's word shingles. Copies share a fingerprint and travel as one node.
Fingerprints within the radius must agree in some choice of bit blocks (radius
+ k blocks, k of them equal), so each is dealt into a shard for each choice; k
grows with the number of fingerprints to keep shards small, and any k is exact.
A shard is a BK-tree: children keyed by their integer Hamming distance to the
parent; a search follows only edges within the radius of its own distance. All
trees of a task are built and searched together, level by level.

The trees are co-located with their queries by the shuffle rather than
broadcast: a tree of all fingerprints has no size bound.

Each task returns at most one link a fingerprint and shard, to the least one it
reaches there, so a group of n near copies never makes n * n rows; components
are then joined up by `connected_components`.

Defined results: a null text is the empty text; texts without words have
fingerprint zero and are linked like any other; a text with fewer words than a
shingle is one shingle; null doc_ids get the least doc_id of their component
(null where it has none); repeated rows are repeated; an empty table gives an
empty table. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint, claim, spread, texts
from stonefold.llm.components import connected_components, join_up

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints that random ones should put in a shard, at most.
SHARD_SIZE = 16
#: Fingerprints that a task holds at once, unless one shard is larger.
TASK_NODES = 500_000
#: Pairs that a search looks at together.
PAIRS = 50_000


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text."""
    parts = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [digest(joined, SEED)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = np.array(hashes[at : at + 65_536], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every row, and the columns of longs to `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep))
    return spread(docs.select(F.col("doc_id").cast("long"), "text", *keep)).mapInArrow(run, schema)


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks; fingerprints within the radius agree under one at least."""
    for equal in range(1, 64 - radius):
        blocks = radius + equal
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(some) for some in combinations(bits, equal)]
        if n <= SHARD_SIZE << min(m.bit_count() for m in masks) or len(masks) > 30:
            return masks
    raise ValueError("the radius is too large for 64 bits")


class BkForest:
    """BK-trees over `fp`, one for each run of equal `tree`; both are sorted by tree."""

    def __init__(self, fp: np.ndarray, tree: np.ndarray):
        self.fp = fp
        first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1])]) if len(tree) else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, len(tree)]))
        keys, nodes = [], []
        left = np.flatnonzero(self.root != np.arange(len(fp)))
        at = self.root[left]
        while len(left):
            key = at * 65 + np.bitwise_count(fp[left] ^ fp[at])
            child, new, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(child)
            nodes.append(left[new])
            rest = np.ones(len(left), bool)
            rest[new] = False
            left, at = left[rest], left[new][which[rest]]
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(key)
        self.key, self.child = key[order], np.concatenate([*nodes, np.zeros(0, np.int64)])[order]

    def search(self, radius: int = RADIUS) -> np.ndarray:
        """For each fingerprint the least index linked with it, directly or through others of its tree."""
        fp, labels = self.fp, np.arange(len(self.fp))
        todo = [(np.arange(at, min(at + PAIRS, len(fp))), None) for at in range(0, len(fp), PAIRS)]
        while todo:
            query, node = todo.pop()
            node = self.root[query] if node is None else node
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            if near.any():
                labels = join_up(labels, query[near], node[near])
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            if not (total := int(n.sum())):
                continue
            place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            query, node = np.repeat(query, n), self.child[np.repeat(lo, n) + place]
            todo += [(query[i : i + PAIRS], node[i : i + PAIRS]) for i in range(0, total, PAIRS)]
        return labels


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join up all of the distinct fingerprints `nodes(fp)` within the radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_masks(n, radius)]
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long").bitwiseAND(F.col("fp")) for m in masks])).alias("choice", "bits"))

    def joined(fp: np.ndarray, tree: np.ndarray) -> Iterator[pa.RecordBatch]:
        shared = np.bincount(tree)[tree] > 1
        fp, tree = fp[shared].view(np.uint64), tree[shared]
        labels = BkForest(fp, tree).search(radius)
        moved = labels != np.arange(len(fp))
        for at in range(0, int(moved.sum()), 100_000):
            a, b = fp[moved][at : at + 100_000], fp[labels[moved]][at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards together, up to `TASK_NODES` fingerprints or the largest shard."""
        claim("simhash")
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if sum(len(h[0]) for h in held) < TASK_NODES:
                continue
            fp, choice, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            tree = np.cumsum(np.r_[True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
            whole = tree < tree[-1]  # the last shard may go on
            if whole.any():
                yield from joined(fp[whole], tree[whole])
            held = [[fp[~whole], choice[~whole], bits[~whole]]]
        if held:
            fp, choice, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from joined(fp, np.cumsum(np.r_[True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])[: len(fp)])

    return dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable by links) of every row, and the columns of longs to `keep`."""
    rows = checkpoint(fingerprints(docs, words, keep))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(nodes, nodes.count(), radius))
    member = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    least = member.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component"))
    named = nodes.join(member.join(least, "root").select(F.col("node").alias("fp"), "component"), "fp", "left")
    # a join of two plain tables, so that adaptive execution can split a hot fingerprint
    named = checkpoint(named.select("fp", F.coalesce("component", "least").alias("component_id")))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *keep)


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` but for those whose component has a smaller doc_id; rows without doc_id stay."""
    dropped = near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

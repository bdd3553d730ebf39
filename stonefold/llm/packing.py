"""Best-fit packing of tokenized documents into sequences of fixed size.

Documents are tokenized once and cut into pieces of at most one sequence; a
checkpointed table keeps (doc_id, piece, start, length, crc) and each piece's
rank among the pieces of its length. The plan is made from the histogram of
lengths alone, at most `capacity` rows however large the corpus: lengths in
falling order, each best-fit into the open sequences with the least room that
still holds it, whole groups of equal sequences at a time. It says for a run
of ranks of one length which sequences and offsets they take. Pieces then find
their slot by length and rank.

A group of open sequences is hit at most log2(capacity) times, since each hit
leaves less than half its room, and a length splits at most two groups, so the
plan has at most 2 * capacity * log2(capacity) + capacity runs (some 100,000
of five integers at 4096): the proven bound of what is sent to executors.

Ranks are counted within an input partition, then raised by the partitions
before it, a window over (length, partition) counts; no length, however common,
is gathered in one task.

Defined results: a null text is the empty text; an empty document is one piece
that has only the end id; an empty table gives an empty table; repeated rows
are packed each for itself; a null doc_id stays null. Only columns doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint, claim, remember, spread, texts

CAPACITY = 4096
END_ID = 1
#: Words that a Python worker remembers in a generation, of which there are two (some 200 bytes each).
MEMO_WORDS = 450_000

#: The settings under which a text's ids are those of its words.
WORD_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


class WordTokenizer:
    """Ids of whole texts, a word at a time, as tokenizers gives them.

    The vocabulary's pre-tokenizer never crosses white space and drops it, and
    normalization lower-cases and stays within words, so a text's ids are its
    words' ids. A blank between an ASCII letter and punctuation changes
    nothing either, since letters and other characters are never in one
    pre-token; the apostrophe (contractions) and the characters of the special
    tokens are left alone. The library deals with all else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        settings = json.loads(self.library.to_str())
        for part, value in WORD_SETTINGS.items():
            if settings[part] != value:
                raise ValueError(f"{path}: texts cannot be read word by word under its {part} {settings[part]}")
        self.apart = re.compile(rb"(?<=[a-z])(?=[.,!?;:\"#%&$*()])").sub
        #: words of this generation and of the last; a word that is met again is taken over
        self.memo: dict[bytes, bytes] = {}
        self.last: dict[bytes, bytes] = {}

    def encode_all(self, docs: list[str]) -> Iterator[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.last = {}, self.memo
        memo, last, rows, fresh = self.memo, self.last, [], set()
        get = memo.get
        for text in docs:
            words = self.apart(b" ", text.encode().lower()).split()
            found = list(map(get, words))
            missing = []
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        w = words[i]
                        if (known := last.get(w)) is not None:
                            memo[w] = found[i] = known
                        else:
                            missing.append((i, w))
                            fresh.add(w)
            rows.append((found, missing))
        order = list(fresh)
        for at in range(0, len(order), 20_000):
            some = order[at : at + 20_000]
            encoded = self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            memo.update(zip(some, [np.array(e.ids, "<u4").tobytes() for e in encoded], strict=True))
        for found, missing in rows:
            for i, w in missing:
                found[i] = memo[w]
            yield b"".join(found)


_TOKENIZERS: dict[str, WordTokenizer] = {}
remember("packing", _TOKENIZERS.clear)


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document, with its rank among equal lengths of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        own, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        last, full = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, rows = batch.slice(at, 512), []
                for doc_id, ids in zip(some.column(0).to_pylist(), own.encode_all(texts(some.column(1))), strict=True):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), full)):
                        cut = ids[start : start + full]
                        n = len(cut) // 4
                        rows.append((doc_id, piece, start // 4, n, zlib.crc32(cut), part, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text"))).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts: runs (length, first rank, first sequence, items a sequence, offset), and how many sequences.

    A run's item of rank r takes sequence first + (r - first rank) // items,
    at offset + (r - first rank) % items * length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free room -> [(first sequence, sequences)]
    rooms: list[int] = []  # its keys, sorted
    runs, n_sequences = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((first, n))

    def fill(length: int, rank: int, left: int, free: int, first: int, n: int) -> int:
        """Place up to `left` items in n sequences with `free` room; how many were placed."""
        each = free // length
        full, rest = divmod(min(left, each * n), each)
        runs.append((length, rank, first, each, capacity - free))
        put(free - each * length, first, full)
        if rest:
            put(free - rest * length, first + full, 1)
        put(free, first + full + bool(rest), n - full - bool(rest))
        return full * each + rest

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                placed = fill(length, rank, left, capacity, n_sequences, n)
                n_sequences += n
            else:
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
                placed = fill(length, rank, left, free, first, n)
            rank, left = rank + placed, left - placed
    return np.array(runs, np.int64).reshape(-1, 5), n_sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `docs`."""
    pieces = checkpoint(tokenized_pieces(docs, tokenizer_path, capacity, end_id))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most `capacity` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_part")).alias("rank"))
    return ranked.mapInArrow(placer(docs.sparkSession, runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def placer(spark, runs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives each (length, rank) the slot of the run that covers it."""
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = sent.value
        by_length: dict[int, np.ndarray] = {}
        lengths, starts = np.unique(planned[:, 0], return_index=True)
        for n, some in zip(lengths.tolist(), np.split(planned, starts[1:]), strict=True):
            by_length[n] = some
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first = np.unique(length[order], return_index=True)
            for n, rows in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
                some = by_length[n]
                hit = some[np.searchsorted(some[:, 1], rank[rows], side="right") - 1]
                place = rank[rows] - hit[:, 1]
                sequence[rows] = hit[:, 2] + place // hit[:, 3]
                offset[rows] = hit[:, 4] + place % hit[:, 3] * n
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stonefold.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

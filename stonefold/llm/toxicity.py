"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Learning reads at most `MAX_EXAMPLES` labelled documents, one row each, chosen
by a hash of their id: the documented bound of all that is sent to executors.
Every word (a run of letters, lower-cased) of every example is in the
vocabulary, every example is in the index, and every text with a known word is
searched; no word, example or text is left out.

A vector has a component (1 + ln tf) * idf * weight for each word, and unit
length. The weight is supervised: plain TF-IDF neighbours follow topic and
language, not toxicity (held out, it found 8 of 97 toxic documents of sf0.1, and
flagged half the clean ones of check_s). So a word weighs `FLOOR` and, beyond
that, the lower confidence bound of its share of toxic examples, above the share
among all. Near copies among the examples (plain cosine of `COPY` or more with
the first of their group, and its label) count once in these shares, and share
one vote as neighbours.

The examples' inverted index is cut into blocks of neighbouring examples; each
word keeps its largest component in each block. A search bounds every block by
the query's components times those maxima, scores the blocks of the highest
bounds exactly, then all whose bound reaches the k-th best so far: the result
is the exact top k.

The raw score is the neighbours' label vote weighted by nearness, with the rate
of toxic labels as one more, lightly weighted vote. It is calibrated by a
logistic fit to the votes of `CALIBRATION_FOLDS` held-in folds, each voted on by
weights and an index made without that fold and its near copies. The neighbours'
ids are the evidence.

Defined results: a null text is the empty text; texts without a known word get
the calibrated base rate and no evidence; equal cosines (to nine places) are
ordered by place in the index; of rows that share a doc_id the least text is
the example, and its label the largest; rows with a null label or id are not
learned from; without examples all scores are 0; repeated rows get equal scores; an empty table
gives an empty table; texts of any length are scored whole. Only id and text
are read, so other columns cannot clash; `keep_non_toxic` passes all columns
through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonefold.llm.common import claim, spread, texts

MAX_EXAMPLES = 2_000
BLOCK_EXAMPLES = 64
#: The most common words, at most so many, that are in one example of so many have dense lists.
DENSE_WORDS, DENSE_SHARE = 512, 16
NEIGHBOURS = 15
#: Weight of a word that tells nothing.
FLOOR = 0.05
#: Standard deviations of the lower bound of a word's toxic share.
CONFIDENCE = 4.0
#: Plain cosine from which examples of one label are near copies.
COPY = 0.8
#: Weight of the base rate's vote.
BASE_VOTE = 0.25
#: A neighbour's vote weighs 1 / (1 - cosine + this).
SOFTEN = 0.05
CALIBRATION_FOLDS = 3
#: Rows of a batch that are Python strings at once.
SLICE_ROWS = 256
FOLDS, HELD_OUT = 5, 0

words_of = re.compile(r"[^\W\d_]+").findall


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of at most `max_examples` labelled documents that are not held out, a row each."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))


def word_counts(some: DataFrame) -> pa.Table:
    """doc_id, toxic, words and counts of every row of `examples`, in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            rows = [Counter(words_of(t.lower())) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([list(r) for r in rows], pa.list_(pa.string())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "counts"])

    return some.mapInArrow(run, "doc_id long, toxic int, words array<string>, counts array<int>").toArrow().sort_by("doc_id")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


#: (words, counts, sum of squares of (1 + ln tf) of words in no example) of a text.
Query = tuple[np.ndarray, np.ndarray, float]


class Index:
    """Block-max inverted index over unit vectors of examples; places are in the index's own order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, share: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, block: int = BLOCK_EXAMPLES):
        """Components (`at` an example, `term`, `tf`), sorted by example; `weight` of each term; `share` of a vote of each example."""
        n, n_terms = len(ids), len(weight)
        self.df = df = np.bincount(term, minlength=n_terms)
        self.scale = (math.log(1 + n) - np.log1p(df) + 1) * weight
        #: factor of a word that is in no example
        self.unknown = (math.log(1 + n) + 1) * FLOOR
        w = (1 + np.log(tf)) * self.scale[term]
        w = w / np.sqrt(np.bincount(at, w * w, n))[at]
        # neighbours in a block have the same telling and the same common words, which makes its maxima tight
        common = np.lexsort((term, -df[term], at))
        telling = np.where(weight > 0.3, weight, 0)[term]
        best = np.lexsort((-telling, at))
        first = np.searchsorted(at, np.arange(n + 1))
        keys = [(int(term[best[a]]) if telling[best[a]] else -1, term[common[a : min(b, a + 12)]].tolist()) if a < b else (-2, []) for a, b in zip(first[:-1], first[1:], strict=True)]
        order = np.array(sorted(range(n), key=lambda i: (keys[i], i)), np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels, self.share, self.block, self.n_blocks = ids[order], labels[order], share[order], block, -(-n // block)
        #: the toxic share, near copies counted once
        self.base = float((self.labels * self.share).sum() / self.share.sum()) if n else 0.0
        where = place[at]
        # the most common words have dense lists, which are read at once for many texts
        self.dense = np.full(n_terms, -1, np.int64)
        head = np.argsort(-df, kind="stable")[:DENSE_WORDS]
        head = head[DENSE_SHARE * df[head] >= max(n, 1)]
        self.dense[head] = np.arange(len(head))
        self.lists = np.zeros((len(head), self.n_blocks * block))
        common = self.dense[term] >= 0
        self.lists[self.dense[term[common]], where[common]] = w[common]
        term, where, w = term[~common], where[~common], w[~common]
        by_term = np.lexsort((where, term))
        self.places, self.parts = where[by_term], w[by_term]
        # an entry for each other word and block: the largest component, and where its components are
        key = term[by_term] * max(1, self.n_blocks) + where[by_term] // block
        self.start = np.flatnonzero(np.diff(key, prepend=-1)).astype(np.int64)
        self.length = np.diff(self.start, append=len(key))
        self.most = np.maximum.reduceat(self.parts, self.start) if len(key) else np.zeros(0)
        self.in_block = (key[self.start] % max(1, self.n_blocks)).astype(np.int64)
        self.entry = np.searchsorted(key[self.start] // max(1, self.n_blocks), np.arange(n_terms + 1))

    def nearest(self, queries: list[Query], k: int = NEIGHBOURS, least: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, places) of the exact top k of at least `least` and above 0 for each query, best first, ties by place."""
        parts = []
        common = np.zeros((len(queries), len(self.lists)))
        for i, (terms, tf, unknown) in enumerate(queries):
            q = (1 + np.log(tf)) * self.scale[terms]
            q /= math.sqrt((q * q).sum() + unknown * self.unknown**2) or 1.0
            at = self.dense[terms]
            common[i, at[at >= 0]] = q[at >= 0]
            parts.append((terms[at < 0], q[at < 0]))
        return [self._search(scores, *some, k, least) for scores, some in zip(common @ self.lists, parts, strict=True)]

    def _search(self, scores: np.ndarray, terms: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Completes `scores` of the common words by the components `q` of other `terms`."""
        if not len(scores):
            return np.zeros(0), np.zeros(0, np.int64)
        n_entries = self.entry[terms + 1] - self.entry[terms]
        entries, of_entry = ranges(self.entry[terms], n_entries), np.repeat(q, n_entries)
        blocks = self.in_block[entries]
        bounds = scores.reshape(-1, self.block).max(axis=1) + np.bincount(blocks, of_entry * self.most[entries], self.n_blocks) + 1e-8
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bounds, kind="stable")[: max(2, -(-2 * k // self.block))]] = True
        self._add(scores, first, blocks, entries, of_entry)
        todo = ~first & (bounds >= max(least, self._kth(scores, k)))
        self._add(scores, todo, blocks, entries, of_entry)
        found = np.flatnonzero((scores >= max(least, self._kth(scores, k)) - 1e-8) & (scores > 0))
        cosines = np.round(scores[found], 9)
        best = np.lexsort((found, -cosines))[:k]
        best = best[cosines[best] >= least]
        return cosines[best], found[best]

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> float:
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 0.0

    def _add(self, scores: np.ndarray, some: np.ndarray, blocks: np.ndarray, entries: np.ndarray, of_entry: np.ndarray) -> None:
        """Adds what the entries in the blocks of `some` give to `scores`, which makes them exact there."""
        mine = some[blocks]
        length = self.length[entries[mine]]
        where = ranges(self.start[entries[mine]], length)
        scores += np.bincount(self.places[where], np.repeat(of_entry[mine], length) * self.parts[where], len(scores))

    def votes(self, queries: list[Query], k: int = NEIGHBOURS) -> list[tuple[float, np.ndarray]]:
        """(toxic share of the nearness-weighted votes, places of the neighbours) for each query."""
        out = []
        for cosines, places in self.nearest(queries, k):
            w = self.share[places] / (1 - cosines + SOFTEN)
            out.append((float((BASE_VOTE * self.base + (w * self.labels[places]).sum()) / (BASE_VOTE + w.sum())), places))
        return out


def term_weights(labels: np.ndarray, counted: np.ndarray, at: np.ndarray, term: np.ndarray, n_terms: int) -> np.ndarray:
    """`FLOOR` to 1: by how much the lower bound of a word's toxic share among the `counted` examples is above that of all."""
    own = counted[at]
    n, toxic = np.bincount(term[own], minlength=n_terms), np.bincount(term[own], labels[at[own]], n_terms)
    base = labels[counted].mean() if counted.any() else 1.0
    size, z2 = np.maximum(n, 1), CONFIDENCE**2
    p = toxic / size
    low = (p + z2 / (2 * size) - CONFIDENCE * np.sqrt(p * (1 - p) / size + z2 / (4 * size**2))) / (1 + z2 / size)
    return FLOOR + (1 - FLOOR) * np.clip((low - base) / max(1 - base, 1e-9), 0, 1)


def leaders(ids: np.ndarray, labels: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int) -> np.ndarray:
    """For each example the first one of its group of near copies, which is the first within `COPY` of it that has its label and leads itself."""
    n = len(ids)
    plain = Index(np.arange(n), labels, np.ones(n), at, term, tf, np.ones(n_terms))
    first = np.searchsorted(at, np.arange(n + 1))
    leader = np.arange(n)
    near = (found for a in range(0, n, SLICE_ROWS) for found in plain.nearest([(term[i:j], tf[i:j], 0.0) for i, j in zip(first[a : a + SLICE_ROWS], first[a + 1 :])], n, COPY))
    for i, (_, places) in enumerate(near):
        before = np.sort(plain.ids[places])
        before = before[(before < i) & (labels[before] == labels[i])]
        before = before[leader[before] == before]
        if len(before):
            leader[i] = before[0]
    return leader


def logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic fit to the log odds of `votes`, with a weak prior toward taking them as they are."""
    x = np.log(votes / (1 - votes))
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weights * (p - labels)) + (beta - [1.0, 0.0])
        step = np.linalg.solve((design * (weights * p * (1 - p))[:, None]).T @ design + np.eye(2), slope)
        beta = beta - step
        if abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.05), float(beta[1])  # a larger vote never scores lower


class Model:
    """The vocabulary, the index of all examples and the calibration."""

    def __init__(self, table: pa.Table):
        """`table`: doc_id, toxic, words, counts; a row for each example."""
        ids, labels = table.column("doc_id").to_numpy(), (table.column("toxic").to_numpy() == 1).astype(np.float64)
        lengths = np.array([len(x) for x in table.column("words").combine_chunks()], np.int64) if len(ids) else np.zeros(0, np.int64)
        words = pa.chunked_array([c.flatten() for c in table.column("words").chunks] or [pa.array([], pa.string())]).combine_chunks().dictionary_encode()
        term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tf = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column("counts").chunks)]).astype(np.float64)
        at, n_terms = np.repeat(np.arange(len(ids)), lengths), len(words.dictionary)
        self.terms = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        leader = leaders(ids, labels, at, term, tf, n_terms)
        share = 1 / np.bincount(leader, minlength=len(ids))[leader] if len(ids) else np.zeros(0)

        def index(inside: np.ndarray) -> Index:
            mine = inside[at]
            weight = term_weights(labels, inside & (leader == np.arange(len(ids))), at, term, n_terms)
            return Index(ids[inside], labels[inside], share[inside], (np.cumsum(inside) - 1)[at[mine]], term[mine], tf[mine], weight)

        self.slope, self.offset = 1.0, 0.0
        first, votes = np.searchsorted(at, np.arange(len(ids) + 1)), np.zeros(len(ids))
        part = leader % CALIBRATION_FOLDS
        for f in range(CALIBRATION_FOLDS if 0 < labels.sum() < len(ids) else 0):
            held_in = index(part != f)
            out = np.flatnonzero(part == f)
            for some in np.split(out, range(SLICE_ROWS, len(out), SLICE_ROWS)):
                votes[some] = [v for v, _ in held_in.votes([(term[first[i] : first[i + 1]], tf[first[i] : first[i + 1]], 0.0) for i in some])]
        if 0 < labels.sum() < len(ids):
            self.slope, self.offset = logistic(np.clip(votes, 1e-4, 1 - 1e-4), labels, share)
        self.index = index(np.ones(len(ids), bool))

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        return 1 / (1 + math.exp(-(self.slope * math.log(v / (1 - v)) + self.offset)))

    def query(self, text: str) -> Query:
        counts = Counter(words_of(text.lower()))
        known = self.terms.get
        terms = np.array([known(w, -1) for w in counts], np.int64)
        tf = np.fromiter(counts.values(), np.float64, len(counts))
        found = terms >= 0
        return terms[found], tf[found], float(((1 + np.log(tf[~found])) ** 2).sum())

    def score(self, some: list[str]) -> list[tuple[float, list[int]]]:
        """(score, ids of the neighbours, best first) of each text."""
        if not len(self.index.ids):
            return [(0.0, [])] * len(some)
        return [(self.calibrated(vote), self.index.ids[places].tolist()) for vote, places in self.index.votes([self.query(t) for t in some])]


def learn(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """The model of a bounded sample of labelled documents, whose word counts come to the driver."""
    return Model(word_counts(examples(docs, labels, max_examples)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples, best first) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        own = sent.value
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            found = own.score(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, score double, evidence array<long>")


def keep_non_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        own = sent.value
        for batch in (b.slice(x, SLICE_ROWS) for b in batches for x in range(0, b.num_rows, SLICE_ROWS)):
            yield batch.filter(pa.array([v < threshold for v, _ in own.score(texts(batch.column(at)))], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")

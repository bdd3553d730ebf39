"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order 5: any text of any language is scored
without unknown symbols, an n-gram is exactly one long, and by construction a
context has at most 256 continuations and a suffix 256 extensions, so no join
key of the model can be hot.

Documents are dealt into blocks of `BLOCK_BYTES` by doc_id and travel compressed. A block
counts its own distinct n-grams (those of trusted documents with their counts);
the counts are summed by n-gram over all blocks, a table that grows with the
corpus and is never collected. Continuation counts, context totals, discounts
(of each order, from its counts of counts) and probabilities are joins of such
sharded tables. Each block gets back the log probabilities of just its own
n-grams and scores its documents. Each pass shuffles the blocks; the first
shuffle is deleted with the checkpoint of the counts, before the second begins.

A document's score is bits a byte, shrunk toward its language's trusted mean by
`PRIOR_BYTES` so that very short texts are not judged by a few bytes. It is
rejected beyond its language's threshold: a high quantile of the trusted
documents of that language, times a slack. The model hardly knows a language
with under `MIN_TRUSTED` trusted documents, and scores those it was made from
too low, so there the threshold is shrunk, the more the fewer they are, toward
`UNKNOWN_BITS`, the cost of a byte without any model; in a language without
trusted documents nothing is rejected.

Defined results: a null text is the empty text, which is never rejected; a null
language is a language of its own; without trusted documents nothing is
rejected and scores are null; a row without doc_id is never trusted, and
`keep_quality` keeps it; repeated rows are scored each for itself, in one block;
scores that tie with the threshold are not rejected; very long texts are scored
whole, in the block that holds them; an empty table gives an empty table; of the
columns only those named are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint_alone as checkpoint
from stonefold.llm.common import claim, release, spread, texts

ORDER = 5
PAD = b"\n" * (ORDER - 1)
#: Bytes of text in a block, on average: what a task holds does not grow with the input.
BLOCK_BYTES = 24 << 20
#: N-grams that a block holds before it counts them.
CHUNK_NGRAMS = 1_000_000
PRIOR_BYTES = 64
QUANTILE = 0.99
#: Bits a byte; scores are rounded up to it where they are ranked.
RESOLUTION = 0.001
SLACK = 1.08
MIN_TRUSTED = 30
UNKNOWN_BITS = 8.0


def ngrams(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at each byte of the texts, one text after the other; bytes of each text)."""
    raw = [t.encode() for t in docs]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(PAD + PAD.join(raw), np.uint8)
    n = len(data) - len(PAD)
    grams = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER):
        grams = (grams << 8) | data[k : k + n]
    inside = np.ones(len(grams), bool)
    ends = np.cumsum(lengths + len(PAD)) - len(PAD)  # a text's pad follows it
    for k in range(len(PAD)):
        at = ends[:-1] + k
        inside[at] = False
    return grams[inside], lengths


def blocks(docs: DataFrame, n_blocks: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(block, payload): compressed batches of (doc_id, text, lang), shuffled by block."""
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("kneser_ney")
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            kinds, first = np.unique(block[order], return_index=True)
            payloads = []
            for rows in np.split(order, first[1:]) if len(kinds) else []:
                some = batch.select([1, 2, 3]).take(pa.array(rows))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema) as out:
                    out.write_batch(some)
                payloads.append(squeeze.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return rows.mapInArrow(run, "block int, payload binary").repartition("block")


def unpack(payloads: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for payload in payloads:
        with pa.ipc.open_stream(expand.decompress(payload.as_py())) as batches:
            yield from batches


class Counter:
    """Sums counts of longs in bounded memory of distinct values."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.n_held += len(keys)
        if self.n_held >= CHUNK_NGRAMS:
            self.settle()

    def settle(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.held, np.zeros(0, np.int64)]), return_counts=True)
        both = np.concatenate([self.keys, keys])
        self.keys, which = np.unique(both, return_inverse=True)
        self.counts = np.bincount(which, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        self.held, self.n_held = [], 0


def block_counts(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, counts): distinct n-grams of each block, compressed, with their count in its trusted documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("kneser_ney")
        known = set(right.column("doc_id").to_pylist())
        counters = Counter(), Counter()
        for batch in unpack(left.column("payload")):
            split: tuple[list[str], list[str]] = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                split[doc_id in known].append(text)
            for some, counter in zip(split, counters, strict=True):
                if some:
                    counter.add(ngrams(some)[0])
        for c in counters:
            c.settle()
        other, own = counters
        only = np.setdiff1d(other.keys, own.keys, assume_unique=True)
        g, n = np.concatenate([own.keys, only]), np.concatenate([own.counts, np.zeros(len(only), np.int64)])
        order = np.argsort(g)
        steps = np.diff(g[order], prepend=0)  # small numbers, which compress well
        squeezed = zstandard.ZstdCompressor(level=3).compress(steps.tobytes() + n[order].tobytes())
        some = [left.column("block")[0].as_py()] if left.num_rows else []
        return pa.table({"block": pa.array(some, pa.int32()), "counts": pa.array([squeezed] * len(some), pa.binary())})

    return packed.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block int, counts binary")


def counted(counts: DataFrame) -> DataFrame:
    """(block, g, n) of `block_counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, squeezed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                steps, n = np.frombuffer(expand.decompress(squeezed.as_py()), np.int64).reshape(2, -1)
                g = np.cumsum(steps)
                for at in range(0, len(g), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g[some]), block, np.int32)), pa.array(g[some]), pa.array(n[some])], names=["block", "g", "n"])

    return counts.mapInArrow(run, "block int, g long, n long")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What is taken off a count of one, two, and three or more, from the counts of counts."""
    n = [0, *counts.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()]
    if not n[1]:
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else i / 2 for i in (1, 2, 3))


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p) of every n-gram of `counts(g, c)`, those with c = 0 included: interpolated modified Kneser-Ney."""
    d = [F.lit(x) for x in discounts(counts)]
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).when(F.col("c") > 2, d[2]).otherwise(F.lit(0.0))
    context = counts.where("c > 0").groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("mass"))
    own = counts.select("g", F.shiftright("g", 8).alias("h"), (F.col("c") - cut).alias("kept")).join(context, "h", "left")
    lower = F.lit(1 / 256)
    if order > 1:
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
        shorter = checkpoint(counts.groupBy(suffix.alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")))
        own = own.withColumn("s", suffix).join(probabilities(shorter, order - 1).select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        lower = F.col("lower")
    return own.select("g", F.coalesce((F.col("kept") + F.col("mass") * lower) / F.col("total"), lower).alias("p"))


def score_blocks(packed: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, bits) of every document, from its block's `known(block, g, bits)`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim("kneser_ney")
        g, bits = (right.column(c).to_numpy() for c in ("g", "bits"))
        order = np.argsort(g)
        g, bits = g[order], bits[order]
        ids, langs, sizes, sums = [], [], [], []
        for batch in unpack(left.column("payload")):
            grams, lengths = ngrams(texts(batch.column(1)))
            at = np.searchsorted(g, grams)
            if len(grams) and (len(g) == 0 or not np.array_equal(g[np.minimum(at, len(g) - 1)], grams)):
                raise AssertionError("a block lacks an n-gram of its own documents")
            running = np.concatenate([[0.0], np.cumsum(bits[at], dtype=np.float64)])
            ends = np.cumsum(lengths)
            ids.append(batch.column(0))
            langs.append(batch.column(2).cast(pa.string()))
            sizes.append(lengths)
            sums.append(running[ends] - running[ends - lengths])
        if not ids:
            return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n_bytes": pa.array([], pa.int64()), "bits": pa.array([], pa.float64())})
        return pa.table({"doc_id": pa.chunked_array(ids), "lang": pa.chunked_array(langs), "n_bytes": np.concatenate(sizes), "bits": np.concatenate(sums)})

    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, lang string, n_bytes long, bits double")


def by_language(rows: DataFrame, value: Column) -> DataFrame:
    """(lang, value) of every language of `rows`: `value`, an aggregate, of its trusted rows, or of all trusted ones where they are few."""
    overall = rows.where("trusted").agg(value).first()[0]
    own = rows.groupBy("lang").agg(value.alias("own"), F.count_if("trusted").alias("n"))
    return own.select("lang", F.when(F.col("n") >= MIN_TRUSTED, F.col("own")).otherwise(F.lit(overall).cast("double")).alias("value"))


def quantiles(rows: DataFrame, q: float) -> DataFrame:
    """lang, value and n: the exact nearest-rank quantile of `score`, rounded up to `RESOLUTION`, and the rows of each language.

    Ranks run over counts of rounded scores, some thousands a language however
    many rows there are, so the result does not hang on partitions.
    """
    bins = rows.groupBy("lang", F.ceil(F.col("score") / RESOLUTION).alias("bin")).agg(F.count("*").alias("here"))
    of_lang = Window.partitionBy("lang")
    ranked = bins.select("lang", "bin", F.sum("here").over(of_lang.orderBy("bin")).alias("upto"), F.sum("here").over(of_lang).alias("n"))
    return ranked.where(F.col("upto") >= F.ceil(F.col("n") * q)).groupBy("lang").agg((F.min("bin") * RESOLUTION).alias("value"), F.max("n").alias("n"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, score (bits a byte, shrunk), perplexity (a byte), threshold and rejected of every row."""
    docs = spread(docs)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = int(-(-size // BLOCK_BYTES)) or 1
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    packed = blocks(docs, n_blocks, id_col, text_col, lang_col)
    dealt = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id")
    requests = counted(checkpoint(block_counts(packed, dealt)))
    counts = checkpoint(requests.groupBy("g").agg(F.sum("n").alias("c")))
    release(docs.sparkSession)
    known = requests.select("block", "g").join(probabilities(counts), "g").select("block", "g", (-F.log2("p")).cast("float").alias("bits"))
    raw = score_blocks(packed, known).join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    raw = checkpoint(raw.withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    del requests, counts, known
    release(docs.sparkSession)
    of_trusted = lambda c: F.when(F.col("trusted"), F.col(c))
    # joins of plain tables, so that adaptive execution can split a hot language
    means = checkpoint(by_language(raw, F.sum(of_trusted("bits")) / F.sum(of_trusted("n_bytes"))).withColumnRenamed("value", "mean"))
    scored = raw.alias("r").join(means.alias("s"), F.expr("r.lang <=> s.lang")).select("r.*", ((F.col("bits") + F.col("mean") * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)).alias("score"))
    scored = checkpoint(scored)
    del raw, means
    release(docs.sparkSession)
    limits = quantiles(scored.where("trusted"), QUANTILE).select("lang", (F.col("value") * SLACK).alias("own"), "n")
    weight = F.least(F.col("n") / MIN_TRUSTED, F.lit(1.0))
    widened = F.greatest("own", F.col("own") * weight + UNKNOWN_BITS * (1 - weight))
    # a row for each language, with a null threshold where nothing is trusted
    limits = scored.select(F.col("lang").alias("language")).distinct().join(limits, F.expr("language <=> lang"), "left").select(F.col("language").alias("lang"), widened.alias("threshold"))
    out = scored.alias("r").join(checkpoint(limits).alias("t"), F.expr("r.lang <=> t.lang"))
    rejected = F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)) & (F.col("n_bytes") > 0)
    return out.select("doc_id", "r.lang", "n_bytes", "score", F.pow(F.lit(2.0), "score").alias("perplexity"), "threshold", rejected.alias("rejected"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as of good quality."""
    return labels.where("quality = 1").select("doc_id")


def keep_quality(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected; rows of one doc_id go only if all of them are rejected."""
    verdicts = classify(docs, trusted_ids)
    gone = verdicts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rejected").alias("gone")).where("gone").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    found = classify(table(spark, sf_dir, "documents"), trusted_labels(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "lang", "n_bytes", F.round("score", 4).alias("bits_per_byte"), F.round("perplexity", 3).alias("perplexity"), "rejected", (~F.col("rejected")).alias("kept"))

"""The corpus pipeline: five stages of the operators in `stonefold.llm`, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return rows of `docs`
with all their columns; the last returns where each piece of each document is
packed.

Defined results, of every stage and of the whole: a null text is the empty text,
which the first two stages keep, the third keeps once and the fourth groups with
texts without words; rows without doc_id pass the first two stages by their own
text and are never dropped as copies of another id by the fourth; repeated rows
are judged alike, and one stays after the third; of ties the row with the largest
doc_id stays in the third, the least in the fourth; very long texts are read
whole; an empty table gives an empty table; extra columns pass through all but
the last stage, whatever their names.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stonefold.llm import exact_dedup, kneser_ney, near_copies, packing, toxicity
from stonefold.llm.common import checkpoint, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is beyond their language's threshold."""
    return kneser_ney.keep_quality(docs, kneser_ney.trusted_labels(table(spark, sf_dir, "labels")))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic."""
    return toxicity.keep_non_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more of 5-word shingles; SimHash is a candidate search."""
    return near_copies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", non_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

#: Perplexity, learned scores and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where all of Spark runs on it and none is named, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpus-pipeline-")


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written as Parquet in the shared folder and read again.

    Each run has a folder of its own, which is deleted at its end: the result,
    a few numbers a piece, is a checkpoint by then, which Spark removes with the
    last plan that reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            rows = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                rows.write.parquet(path := f"{folder}/{i}-{name}")
                docs = spark.read.parquet(path)
        return checkpoint(rows)
    finally:
        remove(spark, folder)

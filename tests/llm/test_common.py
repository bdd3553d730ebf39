import time

from pyspark.sql import functions as F

from stonefold.llm import kneser_ney as kn
from stonefold.llm.common import SHUFFLE_CLEANUP, checkpoint_alone, release


def shuffle_bytes(spark):
    """Bytes of each shuffle file on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def left(spark, before, most=0):
    """Bytes of shuffles that were not there `before`; deletion is not waited for by Spark, so for up to 5 s here."""
    for _ in range(50):
        if (n := sum(size for name, size in shuffle_bytes(spark).items() if name not in before)) <= most:
            break
        time.sleep(0.1)
    return n


def sums(spark):
    return spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))


def test_a_checkpoint_leaves_no_shuffles(spark):
    before, setting = shuffle_bytes(spark), spark.conf.get(SHUFFLE_CLEANUP)
    plain = sums(spark)
    kept = checkpoint_alone(plain)
    assert left(spark, before) == 0 and spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert kept.columns == plain.columns and sorted(kept.collect()) == sorted(plain.collect()) == sorted(plain.collect())


def test_released_shuffles_are_gone_at_once(spark):
    release(spark)
    for _ in range(4):
        before = shuffle_bytes(spark)
        plain = sums(spark)
        plain.collect()
        assert any(name not in before for name in shuffle_bytes(spark))
        del plain
        release(spark)
        assert left(spark, before) == 0


def test_quality_classifier_holds_its_texts_in_one_shuffle_at_a_time(spark, monkeypatch):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f" {i}")), 256) for i in range(40)]).alias("text"), F.lit("en").alias("lang"))
    size = texts.agg(F.sum(F.length("text"))).first()[0]
    before, held = shuffle_bytes(spark), []

    def watched(df):
        held.append(left(spark, before, size // 20))
        return checkpoint_alone(df)

    monkeypatch.setattr(kn, "checkpoint", watched)
    rows = kn.classify(texts, spark.range(0, 400, 2).toDF("doc_id")).collect()
    # hexadecimal digits shrink to half; whatever precedes a checkpoint, no texts are left
    assert len(rows) == 400 and len(held) >= 8 and max(held) <= size // 20, (size, held)

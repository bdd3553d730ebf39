"""Directory walks and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefold.functions import paths
from stonefold.operators.base import sql

MAX_DEPTH = 64


def manifest(spark: SparkSession, folder: str, digest: bool = True) -> DataFrame:
    """path, size, mtime and SHA-256 of every file below a folder, through Spark's binaryFile source; without the digest, contents are not read. Spark leaves out names that begin with a dot or underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.regexp_replace("path", "^[a-z]+:/*", "/")
    columns = [rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*columns, *([F.sha2("content", 256).alias("digest")] if digest else []))


def first_links(entries: DataFrame, order: str = "path") -> DataFrame:
    """Regular files, each inode once: of entries with several links the first in order stays, those with one link all do."""
    return sql(f"SELECT * FROM (SELECT *, CASE WHEN nlink > 1 THEN row_number() OVER (PARTITION BY dev, ino ORDER BY {order}) ELSE 1 END AS nth FROM {{e}} WHERE kind = 'file') WHERE nth = 1", e=entries).drop("nth")


def slot_walk(entries: DataFrame) -> DataFrame:
    """Per slot: files (each inode once), bytes, links skipped, symlinks and special files, and files by category."""
    files = first_links(entries, "slot, path").withColumn("category", paths.corpus_category(F.col("path")))
    counts = sql("SELECT slot, count_if(kind = 'symlink') AS symlinks, count_if(kind NOT IN ('file', 'symlink', 'dir')) AS special, count_if(kind = 'file') AS file_names FROM {e} GROUP BY slot", e=entries)
    own = files.groupBy("slot").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), *[F.count_if(F.col("category") == c).alias(f"n_{c.strip('.')}") for c in ("target", "node_modules", ".git", "source")])
    return counts.join(own, "slot", "left").na.fill(0).withColumn("hardlink_dupes", F.col("file_names") - F.col("files")).drop("file_names")


def classes(entries: DataFrame) -> DataFrame:
    """Files and bytes by class, with errors apart: an entry that could not be read is counted by its error, and the walk is then not complete."""
    rows = first_links(entries.where("error IS NULL")).withColumn("class", paths.trial_category(F.col("path")))
    bad = entries.where("error IS NOT NULL").groupBy(F.concat(F.lit("error:"), "error").alias("class")).agg(F.count("*").alias("files"), F.lit(0).cast("long").alias("bytes"))
    return rows.groupBy("class").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).union(bad)


def sizes(entries: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Bytes and number of the files at most so deep; links are not followed."""
    return entries.where((F.col("kind") == "file") & (F.size(F.split("path", "/")) <= most)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))

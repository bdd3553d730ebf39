"""JSON-lines logs, checkpoints with check sums, and staged ingests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefold.operators.base import sql


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line that is an object; blank lines and others are dropped."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{"))
    return rows.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def split_by_kind(rows: DataFrame, kind: str = "kind", order: str = "ts") -> dict[str, DataFrame]:
    """A log of mixed rows: the last meta and verdict, and all compares, restarts and cases."""
    last = lambda k: sql(f"SELECT x.* FROM (SELECT max_by(struct(*), {order}) AS x FROM {{r}} WHERE {kind} = '{k}') WHERE x IS NOT NULL", r=rows)
    return {k: last(k) for k in ("meta", "verdict")} | {k: rows.where(F.col(kind) == k) for k in ("compare", "restart", "case")}


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append those rows whose key is not there, so a run that is resumed writes nothing twice; how many were written."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.schema(rows.schema).json(path).select(*key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.dropDuplicates(key)
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


def open_run(spark: SparkSession, folder: str, label: str, want: dict, resume: bool) -> str:
    """The log of a run, which begins with its meta row.

    To resume is to go on with the newest log of that label whose meta row says
    the same of root, counts, corpus_sha and gates; else a new log is begun.
    """
    same = json.dumps({k: want.get(k) for k in ("root", "counts", "corpus_sha", "gates")}, sort_keys=True)
    if resume:
        try:
            logs = spark.read.schema("kind string, label string, same string, began timestamp, path string").json(f"{folder}/run-*")
            found = logs.where((F.col("kind") == "meta") & (F.col("label") == label) & (F.col("same") == same)).agg(F.max(F.struct("began", "path")).path).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        if found:
            return found
    path = f"{folder}/run-{uuid.uuid4().hex}"
    meta = spark.range(1).select(F.lit("meta").alias("kind"), F.lit(label).alias("label"), F.lit(same).alias("same"), F.lit(json.dumps(want, sort_keys=True)).alias("want"), F.current_timestamp().alias("began"), F.lit(path).alias("path"))
    meta.coalesce(1).write.json(path)
    return path


def signature(rows: DataFrame) -> str:
    """Number of rows and a sum of hashes, whatever their order."""
    n, sign = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return f"{n}:{sign}"


def save_corpus(tables: dict[str, DataFrame], pools: list[str], path: str) -> None:
    """A checkpoint of the corpus maps (chunks, files, inodes): a folder of its own, then one header row that makes it the newest."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/{uuid.uuid4().hex}"
    signs = {}
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
        signs[name] = signature(spark.read.parquet(f"{folder}/{name}"))
    header = spark.range(1).select(F.lit(json.dumps(pools)).alias("pools"), F.lit(json.dumps(signs)).alias("signs"), F.lit(folder).alias("folder"), F.current_timestamp().alias("saved"))
    header.coalesce(1).write.mode("append").json(f"{path}/headers")


def load_corpus(spark: SparkSession, path: str, pools: list[str]) -> dict[str, DataFrame] | None:
    """The maps of the newest checkpoint, or None where there is none; an error if it is of other pools or not what was written."""
    try:
        headers = spark.read.schema("pools string, signs string, folder string, saved timestamp").json(f"{path}/headers")
        newest = headers.agg(F.max(F.struct("saved", "folder", "pools", "signs"))).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        newest = None
    if newest is None:
        return None
    if json.loads(newest.pools) != pools:
        raise ValueError(f"the checkpoint is of the pools {newest.pools}")
    tables = {name: spark.read.parquet(f"{newest.folder}/{name}") for name in json.loads(newest.signs)}
    for name, sign in json.loads(newest.signs).items():
        if signature(tables[name]) != sign:
            raise ValueError(f"the checkpoint's {name} are not what was written")
    return tables


def save_index(entries: DataFrame, path: str) -> None:
    """Write an index whole with its check sum; Spark's commit makes it visible at once."""
    sign = F.sum(F.xxhash64(*entries.columns).cast("decimal(38,0)"))
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    entries.sparkSession.read.parquet(f"{path}/entries").agg(F.count("*").alias("n"), F.coalesce(sign, F.lit(0)).cast("string").alias("sign")).coalesce(1).write.mode("overwrite").parquet(f"{path}/check")


def load_index(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame]) -> DataFrame:
    """The index if its check sum holds, else what `rebuild` makes by scanning the packs."""
    try:
        entries, check = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/check").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return rebuild()
    found = entries.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*entries.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return entries if check and (check["n"], check["sign"]) == tuple(found) else rebuild()


class Stopped(RuntimeError):
    """The caller's hook ended the work; nothing was published."""


def ingest(source: DataFrame, folder: str, publish: Callable[[str], None], faults: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame | None = None, progress: Callable[[int, int], bool] | None = None, steps: int = 8) -> dict[str, int]:
    """Stage a tree, verify what was written against the source, then publish; a fault stops before.

    With `progress` the tree is staged in so many steps, each a scan of the
    source; it is called with the bytes staged and the bytes in all, and stops
    the ingest by a false answer.

    The report: files, bytes and, of distinct contents (`digest`) that `known`
    lacks, their number (new) and bytes (stored).
    """
    if progress is None:
        source.write.mode("overwrite").parquet(folder)
    else:
        step = F.pmod(F.xxhash64("path"), F.lit(steps))
        sizes = {r.step: r.size or 0 for r in source.groupBy(step.alias("step")).agg(F.sum("size").alias("size")).collect()}
        done, total = 0, sum(sizes.values())
        for i in range(steps):
            if not progress(done, total):
                raise Stopped(f"stopped after {done} of {total} bytes")
            source.where(step == i).write.mode("append" if i else "overwrite").parquet(folder)
            done += sizes.get(i, 0)
        if not progress(done, total):
            raise Stopped(f"stopped after {done} of {total} bytes")
    staged = source.sparkSession.read.parquet(folder)
    found = faults(source, staged).take(5)
    if found:
        raise ValueError(f"the staged tree differs: {found}")
    fresh = staged.where("digest IS NOT NULL").groupBy("digest").agg(F.max("size").alias("size"))
    if known is not None:
        fresh = fresh.join(known.select("digest"), "digest", "left_anti")
    total, new = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size")).first() for x in (staged, fresh))
    publish(folder)
    return {"files": total["n"], "bytes": total["size"], "new": new["n"], "stored": new["size"]}


def seek(table: DataFrame, key: str, at) -> DataFrame:
    """Rows at or after a key, in key order."""
    return table.where(F.col(key) >= F.lit(at)).orderBy(key)


def prefix_scan(table: DataFrame, key: str, start: str, prefix: str, most: int) -> DataFrame:
    """Up to `most` rows from a key on that share a prefix, in key order; both conditions reach the scan."""
    return table.where((F.col(key) >= F.lit(start)) & F.col(key).startswith(prefix)).orderBy(key).limit(most)


def point_get(table: DataFrame, key: str, at) -> DataFrame:
    return table.where(F.col(key) == F.lit(at))

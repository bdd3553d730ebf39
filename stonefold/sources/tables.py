"""The driver's tables and the logical tables of a store that they stand in for.

Stand-ins: documents are files (source is the slot, lang the category), lineitem
rows are the extents of file l_orderkey, orders are inodes of snapshot
o_custkey, parts are blocks, suppliers packs, customers snapshots, conversation
turns directory entries, events the operation log, page URLs paths, and labels
the outcomes of two test arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Spark SQL of each logical table over the driver's table that it reads.
VIEWS = {
    "files": ("documents", "SELECT doc_id AS ino, CAST(substr(source, 4) AS INT) AS pool, source AS slot, lang AS category, text AS content, CAST(octet_length(text) AS BIGINT) AS size FROM {t}"),
    "chunks": ("lineitem", "SELECT l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS ord, l_partkey AS block, l_suppkey AS pack, CAST(l_quantity AS BIGINT) AS len FROM {t}"),
    "inodes": ("orders", "SELECT o_orderkey AS ino, o_custkey AS snapshot, o_orderstatus AS kind, o_orderdate AS mtime, o_orderpriority AS prio FROM {t}"),
    "blocks": ("part", "SELECT p_partkey AS id, p_size AS ulen, p_type AS codec FROM {t}"),
    "packs": ("supplier", "SELECT s_suppkey AS id, s_name AS name FROM {t}"),
    "snapshots": ("customer", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS pool FROM {t}"),
    "dirents": ("conversations", "SELECT conv_id AS dir, turn + 1 AS cookie, concat(role, '-', CAST(turn AS STRING)) AS name, role AS kind FROM {t}"),
    "oplog": ("events", "SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, user_id AS key, event_type AS op, value, props FROM {t}"),
    "paths": ("pages", "SELECT page_id AS id, regexp_replace(url, '^[a-z]+://', '') AS path FROM {t}"),
    "outcomes": ("labels", "SELECT doc_id AS test, quality AS arm_a, toxic AS arm_b FROM {t}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the logical tables."""
    source, text = VIEWS[name]
    return spark.sql(text, t=table(spark, sf_dir, source))


def duckdb_views(*names: str) -> str:
    """The logical tables as the common table expressions of a DuckDB query."""
    out = []
    for name in names:
        source, text = VIEWS[name]
        text = text.replace("{t}", source).replace("octet_length(text)", "octet_length(encode(text))").replace("regexp_replace(url, '^[a-z]+://', '')", "regexp_replace(url, '^[a-z]+://', '')")
        out.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ", ".join(out)

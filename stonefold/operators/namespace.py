"""Namespace reads and edits over inode and entry tables.

Tables: `entries(dir, name, cookie, child, kind)` and `inodes(ino, kind, mode,
nlink, size, target, parent)`. An edit is a table of requests; it gives the new
tables, and requests that cannot be carried out come back with their error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators import graph
from stonefold.operators.base import sql
from stonefold.operators.order import running

#: Error numbers of Linux.
ERRNO = {
    "NotFound": 2,
    "Io": 5,
    "Corrupt": 5,
    "Retry": 11,
    "PermissionDenied": 13,
    "Exists": 17,
    "CrossDevice": 18,
    "NotDir": 20,
    "IsDir": 21,
    "InvalidArgument": 22,
    "FileTooBig": 27,
    "NoSpace": 28,
    "ReadOnly": 30,
    "TooManyLinks": 31,
    "Range": 34,
    "NameTooLong": 36,
    "NotEmpty": 39,
    "NoAttr": 61,
    "NotSupported": 95,
    "Stale": 116,
}
SPECIAL = ("fifo", "socket", "char", "block")


def getattr_of(inodes: DataFrame, *columns: str) -> DataFrame:
    """Attributes of inodes, a projection that reaches the scan."""
    return inodes.select("ino", *columns)


def readlink(inodes: DataFrame, ino: int) -> DataFrame:
    """The target of a link, or the error that it is none."""
    return inodes.where(F.col("ino") == ino).select("ino", F.when(F.col("kind") == "symlink", F.col("target")).alias("target"), F.when(F.col("kind") != "symlink", "InvalidArgument").alias("error"))


def lookup(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries asked for (dir, name) with the attributes of their inodes; `.` is the directory, a miss tells whether the directory is there."""
    return sql(
        """SELECT r.dir, r.name, CASE WHEN r.name = '.' THEN r.dir ELSE e.child END AS child, i.kind,
             CASE WHEN i.ino IS NOT NULL THEN NULL WHEN d.dir IS NULL THEN 'NotDir' ELSE 'NotFound' END AS error
           FROM {r} r LEFT JOIN {e} e ON r.dir = e.dir AND r.name = e.name LEFT JOIN (SELECT DISTINCT dir FROM {e}) d ON r.dir = d.dir
           LEFT JOIN {i} i ON i.ino = CASE WHEN r.name = '.' THEN r.dir ELSE e.child END""",
        r=requests,
        e=entries,
        i=inodes,
    )


def page(entries: DataFrame, directory: int, after: int, most: int) -> DataFrame:
    """Keyset page: up to `most` entries with cookies above `after`, and whether it ends there (one more is read to know)."""
    some = entries.where((F.col("dir") == directory) & (F.col("cookie") > after)).orderBy("cookie").limit(most + 1)
    return sql(f"SELECT dir, cookie, name, ended FROM (SELECT *, row_number() OVER (ORDER BY cookie) AS place, count(*) OVER () <= {most} AS ended FROM {{s}}) WHERE place <= {most}", s=some)


def page_with_attributes(entries: DataFrame, inodes: DataFrame, directory: int, after: int, most: int) -> DataFrame:
    """A page joined to its inodes; entries whose inode is gone are skipped."""
    return page(entries, directory, after, most).join(entries.select("dir", "cookie", "child"), ["dir", "cookie"]).join(inodes, F.col("child") == F.col("ino"))


def space(used: DataFrame, capacity: int, block: int) -> DataFrame:
    """Blocks used, rounded up, and free, never below 0, of `used(bytes)`."""
    return used.select(F.ceil(F.col("bytes") / block).alias("used"), F.greatest(F.lit(capacity // block) - F.ceil(F.col("bytes") / block), F.lit(0)).alias("free"))


def children(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> DataFrame:
    """New children (dir, name, kind, mode, target) as entries, numbered after the largest inode and each directory's largest cookie; taken names are errors."""
    asked = sql(
        """SELECT r.dir, r.name, r.kind, r.mode, r.target, coalesce(c.last, 0) AS last, e.name IS NOT NULL AS taken
           FROM {r} r LEFT JOIN {e} e ON r.dir = e.dir AND r.name = e.name LEFT JOIN (SELECT dir, max(cookie) AS last FROM {e} GROUP BY dir) c ON r.dir = c.dir""",
        r=requests,
        e=entries,
    )
    return sql(
        """SELECT f.dir, name, kind, mode, target, (SELECT coalesce(max(ino), 0) FROM {i}) + place AS child, last + place - first + 1 AS cookie, CAST(NULL AS STRING) AS error
             FROM {f} f JOIN (SELECT dir, min(place) AS first FROM {f} GROUP BY dir) d ON f.dir = d.dir
           UNION ALL SELECT dir, name, kind, mode, target, NULL, NULL, 'Exists' FROM {a} WHERE taken""",
        f=running(asked.where("NOT taken"), [F.col("dir"), F.col("name")]),
        a=asked,
        i=inodes,
    )


def create(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, inodes, errors) after files, directories, links and nodes are made; a new directory has two links and its parent one more."""
    made = children(entries, inodes, requests)
    fine = made.where("error IS NULL")
    more = fine.where("kind = 'd'").groupBy(F.col("dir").alias("ino")).agg(F.count("*").alias("more"))
    old = inodes.join(more, "ino", "left").withColumn("nlink", F.col("nlink") + F.coalesce("more", F.lit(0))).select(*inodes.columns)
    values = {"ino": F.col("child"), "nlink": F.when(F.col("kind") == "d", 2).otherwise(1), "size": F.lit(0), "parent": F.col("dir")}
    new = fine.select(*[values.get(c, F.col(c)).cast(inodes.schema[c].dataType).alias(c) for c in inodes.columns])
    return entries.unionByName(fine.select(*[F.col(c).cast(entries.schema[c].dataType) for c in entries.columns])), old.unionByName(new), made.where("error IS NOT NULL").select("dir", "name", "error")


def link(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, inodes) after new names (dir, name, child) for existing inodes; taken names and directories are left out."""
    fine = requests.join(entries.select("dir", "name"), ["dir", "name"], "left_anti").join(inodes.where("kind <> 'd'").select(F.col("ino").alias("child"), "kind"), "child")
    last = entries.groupBy("dir").agg(F.max("cookie").alias("last"))
    named = sql("SELECT f.dir, f.name, coalesce(l.last, 0) + row_number() OVER (PARTITION BY f.dir ORDER BY f.name) AS cookie, f.child, f.kind FROM {f} f LEFT JOIN {l} l ON f.dir = l.dir", f=fine, l=last)
    return entries.unionByName(named.select(*[F.col(c).cast(entries.schema[c].dataType) for c in entries.columns])), relinked(inodes, named.groupBy("child").agg(F.count("*").alias("delta")))


def relinked(inodes: DataFrame, deltas: DataFrame) -> DataFrame:
    return inodes.join(deltas.withColumnRenamed("child", "ino"), "ino", "left").withColumn("nlink", (F.col("nlink") + F.coalesce("delta", F.lit(0))).cast(inodes.schema["nlink"].dataType)).select(*inodes.columns)


def unlink(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, inodes) without the names (dir, name); an inode goes with its last name. Directories stay."""
    gone = entries.where("kind <> 'd'").join(requests.select("dir", "name"), ["dir", "name"], "left_semi")
    left = relinked(inodes, gone.groupBy("child").agg((-F.count("*")).alias("delta")))
    return entries.join(gone.select("dir", "name"), ["dir", "name"], "left_anti"), left.where("kind = 'd' OR nlink > 0")


def rmdir(entries: DataFrame, inodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, inodes) without the empty directories named; others stay."""
    gone = entries.where("kind = 'd'").join(requests.select("dir", "name"), ["dir", "name"], "left_semi").join(entries.select(F.col("dir").alias("child")), "child", "left_anti")
    parents = gone.groupBy(F.col("dir").alias("child")).agg((-F.count("*")).alias("delta"))
    return entries.join(gone.select("dir", "name"), ["dir", "name"], "left_anti").select(*entries.columns), relinked(inodes.join(gone.select(F.col("child").alias("ino")), "ino", "left_anti"), parents)


def rename(entries: DataFrame, request: tuple[int, str, int, str], replace: bool = True) -> tuple[DataFrame, str | None]:
    """(entries, error) after one move (dir, name, to_dir, to_name); a directory never moves into itself or below."""
    src, name, dst, to = request
    found = entries.where((F.col("dir") == src) & (F.col("name") == name)).select("child", "kind").first()
    if found is None:
        return entries, "NotFound"
    if found["kind"] == "d":
        parents = entries.where("kind = 'd'").select(F.col("child").alias("pid"), F.col("dir").alias("ppid"))
        if not graph.ancestry(parents, dst).where(F.col("pid") == found["child"]).isEmpty():
            return entries, "InvalidArgument"
    taken = (F.col("dir") == dst) & (F.col("name") == to)
    if not replace and not entries.where(taken).isEmpty():
        return entries, "Exists"
    moved = (F.col("dir") == src) & (F.col("name") == name)
    last = entries.where(F.col("dir") == dst).agg(F.coalesce(F.max("cookie"), F.lit(0))).first()[0]
    kept = entries.where(~taken | moved)
    return kept.withColumns({"dir": F.when(moved, dst).otherwise(F.col("dir")), "name": F.when(moved, to).otherwise(F.col("name")), "cookie": F.when(moved, last + 1).otherwise(F.col("cookie"))}), None


def setattr_of(inodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Inodes with the columns of `changes(ino, ...)` where they are not null; null keeps."""
    columns = [c for c in changes.columns if c != "ino"]
    new = changes.select("ino", *[F.col(c).alias(f"new_{c}") for c in columns])
    return inodes.join(new, "ino", "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in inodes.columns])


def upsert_attributes(attributes: DataFrame, changes: DataFrame) -> DataFrame:
    """Extended attributes (ino, name, value) after `changes`; a null value removes."""
    kept = attributes.join(changes.select("ino", "name"), ["ino", "name"], "left_anti")
    return kept.select("ino", "name", "value").union(changes.where("value IS NOT NULL").select("ino", "name", "value"))


def set_content(extents: DataFrame, content: DataFrame) -> DataFrame:
    """Extents after whole chunk lists are replaced, by file; of several for one file the last (`seq`) wins."""
    last = sql("SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY seq DESC) AS age FROM {c}) WHERE age = 1", c=content)
    return extents.join(content.select("file").distinct(), "file", "left_anti").select(*extents.columns).union(last.select(*extents.columns))


def batch(tables: tuple[DataFrame, ...], edits) -> tuple[DataFrame, ...]:
    """All edits or none: each takes and gives the tables; an exception leaves the tables as they were."""
    now = tables
    for edit in edits:
        now = edit(*now)
    return now

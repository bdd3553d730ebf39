"""Snapshots as versions of a table directory.

A store is a folder with the rows of each version and a marker for it: `v1`,
`v2`, ... A version is written whole under a name of its own, then its marker is
created, which fails if another writer was first, so a version is seen whole or
not at all and is never filled twice. Ids are never given out again: each
version also holds the largest one that ever was. All file access goes through
Spark's own file system layer; it must create files exclusively.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefold.functions.paths import snapshot_name_fault
from stonefold.operators import graph
from stonefold.sources.logs import ingest

COLUMNS = "id long, name string, root string, parent long"
#: End of the name of a clone that a swap has staged; no other name may have it.
STAGED = ".swap~"


class Snapshots:
    """Named roots: create, fork, rename, replace, swap, promote, remove; each is one atomic version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        fs, path = self._path("")
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.getLen() > 0 and s.isFile()] if fs.exists(path) else []
        return sorted((v for v in found if v[0] == "v" and v[1:].isdigit()), key=lambda v: int(v[1:]))

    def _rows(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], COLUMNS)
        fs, path = self._path(version)
        stream = fs.open(path)
        try:
            data = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(COLUMNS).parquet(f"{self.folder}/{data}")

    def _last(self) -> str | None:
        return next(reversed(self.versions()), None)

    def table(self, version: str | None = None) -> DataFrame:
        """All snapshots of the last committed version, or of the one given."""
        return self._rows(version or self._last()).where("name IS NOT NULL")

    def commit(self, rows: DataFrame, after: str | None = None) -> str:
        """Write `rows` as the version after `after` (default: the last one); FileExistsError if another writer did."""
        last = after or self._last()
        most = self._rows(last).select("id").union(rows.select("id")).agg(F.max("id")).first()[0]
        mark = self.spark.createDataFrame([(most, None, None, None)], COLUMNS)
        data = f"data-{uuid.uuid4().hex}"
        rows.select("id", "name", "root", "parent").union(mark).write.parquet(f"{self.folder}/{data}")
        name = f"v{int(last[1:]) + 1 if last else 1}"
        fs, path = self._path(name)
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                raise
            raise FileExistsError(f"{name}: another writer was first") from e
        try:
            out.write(bytearray(data.encode()))
        finally:
            out.close()
        return name

    def _check(self, name: str) -> None:
        fault = "reserved" if name.endswith(STAGED) else self.spark.range(1).select(snapshot_name_fault(F.lit(name))).first()[0]
        if fault:
            raise ValueError(f"{name!r}: {fault}")

    def find(self, name: str):
        return self.table().where(F.col("name") == name).first()

    def _new(self, name: str, root: str, parent: int | None) -> int:
        if not name.endswith(STAGED):
            self._check(name)
        if self.find(name):
            raise FileExistsError(name)
        new = (self._rows(self._last()).agg(F.max("id")).first()[0] or 0) + 1
        self.commit(self.table().union(self.spark.createDataFrame([(new, name, root, parent)], COLUMNS)))
        return new

    def create(self, name: str) -> int:
        """An empty tree."""
        self._check(name)
        return self._new(name, "empty", None)

    def fork(self, source: str, name: str) -> int:
        """A writable clone: the same root under a new id, no data copied."""
        row = self._existing(source)
        return self._new(name, row["root"], row["id"])

    def _existing(self, name: str):
        row = self.find(name)
        if row is None:
            raise FileNotFoundError(name)
        return row

    def write(self, name: str, root: str) -> None:
        """Point a snapshot at another root."""
        row = self._existing(name)
        self.commit(self.table().withColumn("root", F.when(F.col("id") == row["id"], root).otherwise(F.col("root"))))

    def rename(self, old: str, new: str) -> None:
        """The same id under a new name."""
        self._check(new)
        row = self._existing(old)
        if self.find(new):
            raise FileExistsError(new)
        self.commit(self.table().withColumn("name", F.when(F.col("id") == row["id"], new).otherwise(F.col("name"))))

    def replace(self, name: str, target: str) -> None:
        """Take over the name `target`; what had it goes, in the same version."""
        row = self._existing(name)
        rest = self.table().where((F.col("name") != target) | (F.col("id") == row["id"]))
        self.commit(rest.withColumn("name", F.when(F.col("id") == row["id"], target).otherwise(F.col("name"))))

    def remove(self, name: str, held: bool = False) -> None:
        """Refused while in use."""
        row = self._existing(name)
        if held:
            raise PermissionError(f"{name} is in use")
        self.commit(self.table().where(F.col("id") != row["id"]))

    def swap(self, source: str, target: str) -> int:
        """Reset `target` to a fresh clone of `source`.

        The clone is staged in one version, under a name that is the record of
        the intent; the next version moves the name. `recover` finishes a swap
        that was interrupted between the two.
        """
        self.recover()
        self._check(target)
        new = self.fork(source, target + STAGED)
        self.replace(target + STAGED, target)
        return new

    def promote(self, source: str, base: str) -> int:
        """Publish a clone of `source` as the base."""
        return self.swap(source, base) if self.find(base) else self.fork(source, base)

    def recover(self) -> None:
        """Roll staged swaps forward."""
        for row in self.table().where(F.col("name").endswith(STAGED)).orderBy("id").collect():  # one at most, as swaps recover first
            self.replace(row["name"], row["name"].removesuffix(STAGED))

    def lineage(self, name: str) -> DataFrame:
        """A snapshot and its ancestors."""
        rows = self.table()
        up = graph.ancestry(rows.select(F.col("id").alias("pid"), F.col("parent").alias("ppid")), self._existing(name)["id"])
        return up.join(rows, F.col("pid") == F.col("id")).select("id", "name", "depth")


def refresh_base(snaps: Snapshots, base: str, source: DataFrame, folder: str, provenance: dict[str, str], faults: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame | None = None) -> dict[str, int]:
    """Ingest a checkout into a folder of its own and make it the root of the base; what had the name goes in the same version.

    The provenance (revision, origin and the like) stands beside the tree before
    the base is replaced, so no published base is without one. A fault of the
    staged tree leaves the base as it was.
    """

    def publish(staged: str) -> None:
        row = snaps.spark.createDataFrame([(staged, k, v) for k, v in sorted(provenance.items())], "root string, name string, value string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{staged}.provenance")
        snaps.recover()
        snaps._new(base + STAGED, staged, None)
        snaps.replace(base + STAGED, base)

    snaps._check(base)
    return ingest(source, folder, publish, faults, known)

"""Consistency checks over the tables of a store; each returns its findings, none means sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators import graph
from stonefold.operators.base import sql


def index_damage(index: DataFrame, verified: DataFrame) -> DataFrame:
    """Index entries (id, pack, off) without a verified record there, and ids that several records hold."""
    return sql(
        """SELECT i.id, 'missing' AS kind, 1L AS n FROM {i} i LEFT ANTI JOIN {v} v ON i.id = v.id AND i.pack = v.pack AND i.off = v.off
           UNION ALL SELECT id, 'duplicate', count(*) FROM {v} GROUP BY id HAVING count(*) > 1""",
        i=index,
        v=verified,
    )


def refcount_mismatch(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids whose stored reference count differs from the references there are, in both directions."""
    return sql(
        "SELECT coalesce(s.id, e.id) AS id, coalesce(s.refs, 0) AS stored, coalesce(e.refs, 0) AS counted FROM {s} s FULL OUTER JOIN (SELECT id, count(*) AS refs FROM {e} GROUP BY id) e ON s.id = e.id WHERE coalesce(s.refs, 0) <> coalesce(e.refs, 0)",
        s=stored,
        e=edges,
    )


def index_disagreement(by_name: DataFrame, by_cookie: DataFrame, key: str = "dir") -> DataFrame:
    """Groups whose two indexes are not the same multiset of rows (counts, and sums of row hashes)."""
    columns = ", ".join(c for c in by_name.columns)
    side = "SELECT {k}, count(*) AS n, sum(CAST(xxhash64({c}) AS DECIMAL(38,0))) AS h FROM {{{t}}} GROUP BY {k}"
    return sql(
        f"SELECT coalesce(a.{key}, b.{key}) AS {key}, coalesce(a.n, 0) AS by_name, coalesce(b.n, 0) AS by_cookie FROM ({side.format(k=key, c=columns, t='a')}) a FULL OUTER JOIN ({side.format(k=key, c=columns, t='b')}) b ON a.{key} = b.{key} WHERE NOT (a.n <=> b.n AND a.h <=> b.h)",
        a=by_name,
        b=by_cookie,
    )


def graph_faults(inodes: DataFrame, names: DataFrame, root: int) -> DataFrame:
    """Namespace faults of inodes (ino, kind, nlink, parent) and names (dir, child): link counts, orphans, wrong parents, unreachable directories.

    A file has as many links as names, a directory two and one for each
    subdirectory. Directories are walked by a frontier loop over checkpointed
    tables: any depth and number, and cycles end.
    """
    dirs = sql("SELECT dir AS parent, child FROM {n} JOIN {i} i ON child = i.ino WHERE i.kind = 'd'", n=names, i=inodes)
    reach = graph.reachable(dirs, inodes.sparkSession.createDataFrame([(root,)], "id long")).select(F.col("id").alias("ino"))
    return sql(
        f"""WITH links AS (SELECT child AS ino, count(*) AS names, max(dir) AS dir FROM {{n}} GROUP BY child),
            subs AS (SELECT dir AS ino, count_if(kind = 'd') AS subs FROM {{n}} JOIN {{i}} i ON child = i.ino GROUP BY dir)
            SELECT i.ino, f.fault FROM {{i}} i LEFT JOIN links l USING (ino) LEFT JOIN subs s USING (ino) LEFT JOIN (SELECT ino AS seen FROM {{r}}) ON ino = seen
            LATERAL VIEW explode(filter(array(
              CASE WHEN i.ino <> {root} AND l.names IS NULL THEN 'orphan' END,
              CASE WHEN i.kind <> 'd' AND coalesce(l.names, 0) <> i.nlink THEN 'link count' WHEN i.kind = 'd' AND coalesce(s.subs, 0) + 2 <> i.nlink THEN 'link count' END,
              CASE WHEN i.kind = 'd' AND i.ino <> {root} AND l.dir IS NOT NULL AND l.dir <> i.parent THEN 'parent' END,
              CASE WHEN i.kind = 'd' AND seen IS NULL THEN 'unreachable' END), x -> x IS NOT NULL)) f AS fault""",
        i=inodes,
        n=names,
        r=reach,
    )


def capped(findings: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` findings; the cap is the feature, as in a report."""
    return findings.orderBy(*order.split(", ")).limit(most)

"""File extents: offsets, range reads, overlays, and edits of chunk lists.

Extents are rows (file, ord, block, len); a null block is a hole. All edits give
the new extents of the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stonefold.operators.base import sql

MAX_HOLE = 1 << 30
#: Files are cut into buckets of so many bytes for range joins.
BUCKET = 64


def offsets(chunks: DataFrame) -> DataFrame:
    """Extents with their offset, the sum of the lengths before them."""
    return sql("SELECT file, ord, block, len, sum(len) OVER (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING) - len AS off FROM {c}", c=chunks)


def range_read(extents: DataFrame, start: int, end: int) -> DataFrame:
    """The part of each extent that lies in [start, end)."""
    return sql(f"SELECT file, ord, block, greatest(off, {start}) AS from_off, least(off + len, {end}) - greatest(off, {start}) AS n, greatest(off, {start}) - off AS skip FROM {{e}} WHERE off < {end} AND off + len > {start}", e=extents)


def chunk_range(extents: DataFrame, start: int, end: int) -> DataFrame:
    """Extents that begin in [start, end)."""
    return extents.where(f"off >= {start} AND off < {end}")


def partly_covered(extents: DataFrame, start: int, end: int) -> DataFrame:
    """Extents that [start, end) covers in part."""
    return extents.where(f"off < {end} AND off + len > {start} AND NOT (off >= {start} AND off + len <= {end})")


def overlaps(ranges: DataFrame, extents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Parts of extents in each range (file, lo, hi): an equality join on byte buckets; a pair is taken in its first common one."""
    return sql(
        f"""SELECT r.file, r.lo, r.hi, e.ord, e.block, greatest(r.lo, e.off) AS from_off, least(r.hi, e.off + e.len) - greatest(r.lo, e.off) AS n
            FROM (SELECT *, explode(sequence(lo DIV {bucket}, greatest(lo, hi - 1) DIV {bucket})) AS b FROM {{r}} WHERE hi > lo) r
            JOIN (SELECT *, explode(sequence(off DIV {bucket}, (off + len - 1) DIV {bucket})) AS b FROM {{e}} WHERE len > 0) e
              ON r.file = e.file AND r.b = e.b AND e.off < r.hi AND e.off + e.len > r.lo AND r.b = greatest(r.lo, e.off) DIV {bucket}""",
        r=ranges,
        e=extents,
    )


def merged(writes: DataFrame, key: str = "file") -> DataFrame:
    """Touching or overlapping intervals (key, lo, hi) joined into islands."""
    return sql(
        f"""SELECT {key}, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (
              SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
                SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {{w}}))
            GROUP BY {key}, island""",
        w=writes,
    )


def coverage(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per file: bytes in blocks, in holes, and beyond or short of its size."""
    return sql(
        """SELECT s.file, size, coalesce(sum(len) FILTER (WHERE block IS NOT NULL), 0) AS covered, coalesce(sum(len) FILTER (WHERE block IS NULL AND len IS NOT NULL), 0) AS holes, size - coalesce(sum(len), 0) AS short
           FROM {s} s LEFT JOIN {e} e ON s.file = e.file GROUP BY s.file, size""",
        s=sizes,
        e=extents,
    )


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extents of `new` that `old` lacks at their place, and those of `old` that go: what a rewrite must touch."""
    return sql(
        """SELECT coalesce(n.file, o.file) AS file, coalesce(n.off, o.off) AS off, CASE WHEN o.file IS NULL THEN 'put' WHEN n.file IS NULL THEN 'drop' ELSE 'replace' END AS change
           FROM {n} n FULL OUTER JOIN {o} o ON n.file = o.file AND n.off = o.off
           WHERE NOT (n.block <=> o.block AND n.len <=> o.len)""",
        n=new,
        o=old,
    )


def truncate(extents: DataFrame, size: int) -> DataFrame:
    """Extents cut at `size`; a block that is cut must be chunked again (`rechunk`), a hole is shortened."""
    return sql(f"SELECT file, ord, block, off, least(len, {size} - off) AS len, off + len > {size} AND block IS NOT NULL AS rechunk FROM {{e}} WHERE off < {size}", e=extents)


def punch(extents: DataFrame, start: int, end: int) -> DataFrame:
    """[start, end) made a hole: inner extents go unread, blocks at the edges are cut and must be chunked again."""
    return sql(
        f"""SELECT file, block, off, len, false AS rechunk FROM {{e}} WHERE off + len <= {start} OR off >= {end}
            UNION ALL SELECT file, block, off, {start} - off, block IS NOT NULL FROM {{e}} WHERE off < {start} AND off + len > {start}
            UNION ALL SELECT file, block, {end}, off + len - {end}, block IS NOT NULL FROM {{e}} WHERE off < {end} AND off + len > {end}
            UNION ALL SELECT file, CAST(NULL AS BIGINT), {start}, least({end}, max(off + len)) - {start}, false FROM {{e}} GROUP BY file HAVING max(off + len) > {start}""",
        e=extents,
    )


def splice(extents: DataFrame, edits: DataFrame, versions: DataFrame) -> DataFrame:
    """Range replacement with compare-and-swap: `edits` (file, expected, lo, hi, block, len), `versions` (file, version).

    A conflict, or a range whose ends are not extent boundaries, is a result
    and changes nothing.
    """
    return sql(
        """SELECT d.file, CASE WHEN v.version IS NULL THEN 'missing' WHEN v.version <> d.expected THEN 'conflict' WHEN NOT (b.lo_ok AND b.hi_ok) THEN 'unaligned' ELSE 'spliced' END AS outcome,
                  CASE WHEN v.version = d.expected AND b.lo_ok AND b.hi_ok THEN v.version + 1 ELSE v.version END AS version
           FROM {d} d LEFT JOIN {v} v ON d.file = v.file
           LEFT JOIN (SELECT x.file, x.lo, max(e.off = x.lo) OR max(e.off + e.len) = x.lo AS lo_ok, max(e.off + e.len = x.hi) AS hi_ok FROM {d} x JOIN {e} e ON x.file = e.file GROUP BY x.file, x.lo) b
             ON d.file = b.file AND d.lo = b.lo""",
        d=edits,
        v=versions,
        e=extents,
    )


def spliced(extents: DataFrame, edits: DataFrame, versions: DataFrame) -> DataFrame:
    """The extents (file, block, off, len) after `splice`: where it succeeded, [lo, hi) is the new one and what comes after is moved; other files stay as they are."""
    done = sql("SELECT d.* FROM {d} d JOIN {o} o ON d.file = o.file WHERE o.outcome = 'spliced'", d=edits, o=splice(extents, edits, versions))
    return sql(
        """SELECT e.file, e.block, CASE WHEN d.file IS NOT NULL AND e.off >= d.hi THEN e.off - (d.hi - d.lo) + d.len ELSE e.off END AS off, e.len FROM {e} e LEFT JOIN {d} d ON e.file = d.file
           WHERE d.file IS NULL OR e.off + e.len <= d.lo OR e.off >= d.hi UNION ALL SELECT file, block, lo, len FROM {d} WHERE len > 0""",
        e=extents,
        d=done,
    )


def hole_refs(lengths: DataFrame, most: int = MAX_HOLE) -> DataFrame:
    """A length as holes of at most `most` bytes each."""
    return sql(f"SELECT id, k AS ord, least({most}, len - k * {most}) AS len FROM {{l}} LATERAL VIEW explode(sequence(0L, (len - 1) DIV {most})) AS k WHERE len > 0", l=lengths)


def invalid_refs(chunks: DataFrame, most_block: int, most_hole: int = MAX_HOLE) -> DataFrame:
    """Chunk references that break a rule: hole flag and id disagree, or a length is out of bounds."""
    return sql(
        f"SELECT *, CASE WHEN hole <> (block IS NULL) THEN 'flag' WHEN len <= 0 THEN 'empty' WHEN NOT hole AND len > {most_block} THEN 'block too long' WHEN hole AND len > {most_hole} THEN 'hole too long' END AS why FROM {{c}}",
        c=chunks,
    ).where("why IS NOT NULL")

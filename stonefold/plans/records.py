"""Queries of log parsers, packs, namespace checks and snapshot edits over the stand-in tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stonefold.operators import consistency, dedup, extents, namespace, store
from stonefold.operators.base import sql
from stonefold.operators.graph import shared_folder
from stonefold.operators.snapshots import Snapshots
from stonefold.plans.registry import Registry
from stonefold.sources import logs, packs, parsers
from stonefold.sources.tables import view

query = Registry()

#: Three kinds of test output by id: complete, without a plan, and with faults.
TAP = "CASE id % 3 WHEN 0 THEN concat('1..', 3, '\\n', 'ok 1 a', '\\n', 'not ok 2 b', '\\n', 'ok 3 # TODO c') WHEN 1 THEN concat('ok 1 early', '\\n', 'noise') ELSE concat('noise', '\\n', '1..2', '\\n', 'ok 1 # skip s', '\\n', 'what', '\\n', 'Bail out! now') END"


@query(" SELECT id, CASE id % 3 WHEN 0 THEN 3 WHEN 2 THEN 2 END AS plan, CAST(CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS ok, CAST(CASE id % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS not_ok, CAST(CASE id % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS todo, CAST(CASE id % 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS skip, CAST(CASE id % 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS bail_out, CAST(CASE id % 3 WHEN 0 THEN 0 ELSE 2 END AS BIGINT) AS malformed FROM blocks", "blocks")
def tap_streams(spark, d):
    """Test output: plan, counts, malformed lines (2.1.22)."""
    return parsers.tap(view(spark, d, "blocks").select("id", F.expr(TAP).alias("text")))


CONSOLE = "CASE id % 6 WHEN 0 THEN concat('g/1 3s ok', '\\n', 'Passed all 1 tests') WHEN 1 THEN concat('g/1 [not run] no feature', '\\n', 'Not run: g/1', '\\n', 'Passed all 1 tests') WHEN 2 THEN concat('g/1 bad', '\\n', 'Failed 1 of 1 tests') WHEN 3 THEN 'garbage' WHEN 4 THEN concat('g/1 [not run] x', '\\n', 'Passed all 1 tests') ELSE concat('g/1 3s', '\\n', 'Passed all 1 tests') END"


@query(" SELECT id, CASE WHEN id % 6 = 5 THEN 'TIMEOUT' ELSE CASE id % 6 WHEN 0 THEN CASE WHEN id % 4 = 0 THEN 'NO_RESULT' ELSE 'PASS' END WHEN 1 THEN 'NOT_RUN' WHEN 2 THEN 'FAIL' ELSE 'NO_RESULT' END END AS status, CASE id % 6 WHEN 1 THEN 'no feature' WHEN 4 THEN 'x' END AS reason FROM blocks", "blocks")
def console_statuses(spark, d):
    """Console text and exit code to a status (2.1.23)."""
    return parsers.console(view(spark, d, "blocks").select("id", F.lit("g/1").alias("case"), F.expr(CONSOLE).alias("text"), F.expr("CASE WHEN id % 6 = 5 THEN 124 WHEN id % 4 = 0 THEN 1 ELSE 0 END").alias("rc")))


LSOF = "concat('p', id, '\\n', 'cproc', '\\n', 'fcwd', '\\n', 'n/mnt/s', '\\n', 'f3u', '\\n', 'n/mnt/s/a', '\\n', 'f4', '\\n', 'n/mnt/sx', '\\n', 'p', id + 1, '\\n', 'f5', '\\n', 'n/mnt/s/b')"


@query(" SELECT id, id AS pid, 'proc' AS command, 'cwd' AS fd, 'cwd' AS kind, '/mnt/s' AS path FROM blocks UNION ALL SELECT id, id, 'proc', '3u', 'lock', '/mnt/s/a' FROM blocks UNION ALL SELECT id, id + 1, '', '5', 'fd', '/mnt/s/b' FROM blocks", "blocks")
def lsof_holds(spark, d):
    """Tagged lines folded into holds under a prefix (2.1.24, 2.3.12)."""
    return parsers.lsof(view(spark, d, "blocks").select("id", F.expr(LSOF).alias("text")), "/mnt/s")


@query(" SELECT id, 2 AS n, CASE id % 3 WHEN 0 THEN 'zodd' WHEN 1 THEN 'nearly' ELSE 'p0' END AS line FROM blocks WHERE id > 0", "blocks")
def lsof_malformed(spark, d):
    """Malformed input is a fault, not an empty answer (2.1.24)."""
    text = F.expr("concat('p', id, '\\n', CASE id % 3 WHEN 0 THEN 'zodd' WHEN 1 THEN 'nearly' ELSE 'p0' END)")
    return parsers.lsof_faults(view(spark, d, "blocks").where("id > 0").select("id", text.alias("text")))


@query(", l AS (SELECT id AS pid, CASE WHEN id % 4 = 0 THEN 'cwd' ELSE CAST(id % 4 AS VARCHAR) END AS fd, CASE id % 3 WHEN 0 THEN '/mnt/s' WHEN 1 THEN '/mnt/s/f' ELSE '/mnt/st' END AS path FROM blocks) SELECT pid, path, CASE WHEN fd = 'cwd' THEN 'cwd' ELSE 'fd' END AS kind FROM l WHERE path <> '/mnt/st' UNION ALL SELECT pid, path, 'lock' FROM l WHERE path <> '/mnt/st' AND fd <> 'cwd' AND pid % 5 = 0", "blocks")
def proc_holds(spark, d):
    """Working directories, descriptors and locks under a prefix (2.1.25)."""
    b = view(spark, d, "blocks")
    links = sql("SELECT id AS pid, CASE WHEN id % 4 = 0 THEN 'cwd' ELSE CAST(id % 4 AS STRING) END AS fd, CASE id % 3 WHEN 0 THEN '/mnt/s' WHEN 1 THEN '/mnt/s/f' ELSE '/mnt/st' END AS path, 8 AS major, 1 AS minor, id AS inode FROM {b}", b=b)
    return parsers.proc_holds(links, sql("SELECT 8 AS major, 1 AS minor, id AS inode FROM {b} WHERE id % 5 = 0", b=b), "/mnt/s")


@query(" SELECT id, id + 3 AS idle, id * 3 + 3 + 28 AS total FROM blocks", "blocks")
def cpu_ticks(spark, d):
    """Idle and total ticks of a statistics text (2.1.26)."""
    return parsers.cpu_ticks(view(spark, d, "blocks").select("id", F.expr("concat('cpu  ', id, ' ', id, ' 1 ', id, ' 3 7 9 11 100 100', '\\n', 'cpu0 1 2')").alias("text")))


@query(", u AS (SELECT DISTINCT content FROM files) SELECT sha256(content) AS id, CAST(octet_length(encode(content)) AS BIGINT) AS ulen, true AS sound FROM u", "files")
def pack_scan(spark, d):
    """Blocks written to packs and scanned back, each verified (2.1.5, 2.1.9, 2.1.10)."""
    blocks = view(spark, d, "files").select("content").distinct()
    return packs.scan(packs.write(blocks)).select("id", "ulen", (F.col("kind") == "record").alias("sound"))


@query(", u AS (SELECT DISTINCT content FROM files) SELECT sha256(content) AS id, CAST(octet_length(encode(content)) AS BIGINT) AS ulen, true AS sound FROM u", "files")
def pack_deep_scan(spark, d):
    """The same with every record's content read and hashed (2.1.6)."""
    blocks = view(spark, d, "files").select("content").distinct()
    return packs.scan(packs.write(blocks), deep=True).select("id", "ulen", (F.col("kind") == "record").alias("sound"))


@query(", u AS (SELECT DISTINCT content FROM files) SELECT sha256(content) AS id, CAST(octet_length(encode(content)) AS BIGINT) AS ulen FROM u", "files")
def index_checkpoint(spark, d):
    """An index saved and loaded by its check sum; a wrong one would give no rows (2.1.11, 2.1.12)."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    entries = packs.scan(packs.write(view(spark, d, "files").select("content").distinct())).select("id", "ulen")
    logs.save_index(entries, path)
    return logs.load_index(spark, path, lambda: spark.createDataFrame([], entries.schema))


@query(" SELECT 'chunks' AS part, count(*) AS n, CAST(sum(len) AS BIGINT) AS size FROM chunks UNION ALL SELECT 'inodes', count(*), CAST(sum(ino) AS BIGINT) FROM inodes", "chunks", "inodes")
def corpus_checkpoint(spark, d):
    """Maps saved under one header and resumed for the same pools (2.1.21)."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    logs.save_corpus({"chunks": view(spark, d, "chunks").select("len"), "inodes": view(spark, d, "inodes").select("ino")}, ["main"], path)
    maps = logs.load_corpus(spark, path, ["main"])
    return sql("SELECT 'chunks' AS part, count(*) AS n, sum(len) AS size FROM {c} UNION ALL SELECT 'inodes', count(*), sum(ino) FROM {i}", c=maps["chunks"], i=maps["inodes"])


@query(", u AS (SELECT DISTINCT sha256(content) AS id FROM files) SELECT CASE WHEN substr(id, 1, 1) IN ('0', '1') THEN 'added' WHEN substr(id, 1, 1) = '2' THEN 'replaced' ELSE 'known' END AS outcome, count(*) AS n FROM u GROUP BY 1", "files")
def pack_salvage(spark, d):
    """What a rescan adds to or replaces in an index (2.1.7)."""
    files = view(spark, d, "files")
    index = sql("SELECT id, substr(id, 1, 1) <> '2' AS readable FROM (SELECT DISTINCT sha2(content, 256) AS id FROM {f}) WHERE substr(id, 1, 1) NOT IN ('0', '1')", f=files)
    return packs.salvage(packs.scan(packs.write(files.select("content").distinct())), index).select("outcome", "n")


@query(" SELECT id, id * 10 AS len, id = (SELECT max(id) FROM packs) AS active FROM packs ORDER BY id", "packs")
def pack_listing(spark, d):
    """Packs by id; other names are left out (2.1.8)."""
    p = view(spark, d, "packs")
    return packs.listing(sql("SELECT concat('/store/pack-', id, '.log') AS path, id * 10 AS length FROM {p} UNION ALL SELECT '/store/other', 1L FROM {p}", p=p))


TREE = "SELECT id AS ino, CASE WHEN id * 2 <= (SELECT max(id) FROM {b}) THEN 'd' ELSE 'f' END AS kind, id DIV 2 AS parent FROM {b} WHERE id > 0"


@query(", m AS (SELECT max(id) AS m FROM blocks), t AS (SELECT id AS ino, CASE WHEN id * 2 <= m THEN 'd' ELSE 'f' END AS kind FROM blocks, m WHERE id > 0) SELECT ino, 'link count' AS fault FROM t WHERE kind = 'f' AND ino % 10 = 3 UNION ALL SELECT ino, 'orphan' FROM t WHERE ino = 77 UNION ALL SELECT ino, 'link count' FROM t WHERE kind = 'f' AND ino = 77 AND ino % 10 <> 3 UNION ALL SELECT ino, 'link count' FROM t WHERE ino = 38 UNION ALL (WITH RECURSIVE below(ino) AS (SELECT CAST(77 AS BIGINT) UNION ALL SELECT t.ino FROM t JOIN below ON t.ino // 2 = below.ino) SELECT ino, 'unreachable' FROM below JOIN t USING (ino) WHERE kind = 'd')", "blocks")
def namespace_check(spark, d):
    """Link counts, orphans and unreachable directories of a tampered tree (2.3.7)."""
    b = view(spark, d, "blocks")
    tree = sql(TREE, b=b)
    kids = sql("SELECT parent AS ino, count_if(kind = 'd') AS subs FROM {t} GROUP BY parent", t=tree)
    inodes = sql("SELECT t.ino, kind, parent, CASE WHEN kind = 'd' THEN 2 + coalesce(subs, 0) WHEN t.ino % 10 = 3 THEN 2 ELSE 1 END AS nlink FROM {t} t LEFT JOIN {k} k ON t.ino = k.ino", t=tree, k=kids)
    return consistency.graph_faults(inodes, sql("SELECT parent AS dir, ino AS child FROM {t} WHERE ino > 1 AND ino <> 77", t=tree), 1)


def tree_entries(spark, d):
    return sql("SELECT parent AS dir, concat('n', ino) AS name, ino AS cookie, ino AS child, kind FROM {t} WHERE ino > 1", t=sql(TREE, b=view(spark, d, "blocks")))


@query(" SELECT CASE WHEN id = 9 THEN 3 ELSE id // 2 END AS dir, CASE WHEN id = 9 THEN 'moved' ELSE 'n' || id END AS name, id AS child FROM blocks WHERE id > 1", "blocks")
def rename_entry(spark, d):
    """A move, which a directory cannot make into itself (2.10.5)."""
    e = tree_entries(spark, d)
    same, error = namespace.rename(e, (1, "n2", 9, "x"))
    moved, _ = namespace.rename(same, (4, "n9", 3, "moved"))
    return moved.select("dir", "name", "child").where(F.lit(error == "InvalidArgument"))


@query(", m AS (SELECT max(id) AS m FROM blocks) SELECT id // 2 AS dir, id AS child FROM blocks, m WHERE id > 1 AND NOT (id * 2 > m AND id % 2 = 0)", "blocks")
def rmdir_entries(spark, d):
    """Empty directories go, others stay (2.10.4)."""
    e = tree_entries(spark, d)
    e = e.withColumn("kind", F.when(F.col("child") % 2 == 0, "d").otherwise(F.col("kind")))
    inodes = e.selectExpr("child AS ino", "kind", "2L AS nlink")
    return namespace.rmdir(e, inodes, e.where("child % 2 = 0").select("dir", "name"))[0].select("dir", "child")


@query(" SELECT id AS ino, CASE WHEN id % 2 = 0 THEN codec END AS target, CASE WHEN id % 2 = 1 THEN 'InvalidArgument' END AS error FROM blocks WHERE id = 8", "blocks")
def readlink(spark, d):
    """A link's target (2.2.2)."""
    return namespace.readlink(view(spark, d, "blocks").selectExpr("id AS ino", "CASE WHEN id % 2 = 0 THEN 'symlink' ELSE 'file' END AS kind", "codec AS target"), 8)


@query(" SELECT file, ord, block, len FROM chunks WHERE file % 3 > 0 UNION ALL SELECT DISTINCT file, 1, CAST(2 AS BIGINT), CAST(9 AS BIGINT) FROM chunks WHERE file % 3 = 0", "chunks")
def set_content(spark, d):
    """Whole chunk lists replaced, the last writer wins (2.10.7)."""
    c = view(spark, d, "chunks").select("file", "ord", "block", "len")
    new = sql("SELECT DISTINCT file, 1 AS ord, CAST(s AS BIGINT) AS block, 9L AS len, s AS seq FROM {c} LATERAL VIEW explode(array(1, 2)) AS s WHERE file % 3 = 0", c=c)
    return namespace.set_content(c, new)


@query(" SELECT id, 'S-' || name AS name, pool FROM snapshots WHERE id % 5 > 0 UNION ALL SELECT id + 1000000, name || '.fork', pool FROM snapshots WHERE id % 10 = 1", "snapshots")
def snapshot_edits(spark, d):
    """Snapshots forked, renamed and removed in one batch of edits (2.10.10 to 2.10.14)."""
    s = view(spark, d, "snapshots")

    def fork(t):
        return (t.union(t.where("id % 10 = 1").selectExpr("id + 1000000", "concat(name, '.fork')", "pool")),)

    def rename(t):
        return (t.withColumn("name", F.when(F.col("id") < 1000000, F.concat(F.lit("S-"), "name")).otherwise(F.col("name"))),)

    def remove(t):
        return (t.where("id % 5 > 0 OR id >= 1000000"),)

    return namespace.batch((s,), [fork, rename, remove])[0]


@query("SELECT CAST(id AS BIGINT) AS id, name, root, CAST(parent AS BIGINT) AS parent FROM (VALUES (1, 'base', 'r1', NULL), (4, 'published', 'r3', 2), (5, 'work', 'r1', 1), (7, 'fresh', 'r1', 5)) t(id, name, root, parent)")
def snapshot_lifecycle(spark, d):
    """Created, forked, written, renamed, replaced, swapped, promoted and removed snapshots; no id comes back (2.10.11 to 2.10.17)."""
    s = Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    s.create("base")
    s.write("base", "r1")
    s.fork("base", "old")
    s.write("old", "r2")
    s.create("work")
    s.write("old", "r3")
    s.promote("old", "published")
    s.swap("base", "work")
    s.rename("old", "gone")
    s.remove("gone")
    s.fork("work", "aside")
    s.remove("aside")
    s.fork("work", "fresh")
    return s.table()


@query(" SELECT id, name, pool FROM snapshots WHERE id <= 100", "snapshots")
def durable_snapshots(spark, d):
    """Only what the last durable commit holds (2.1.18)."""
    s = view(spark, d, "snapshots").withColumn("committed", F.col("id"))
    return logs.seek(s.where("committed <= 100"), "id", 0).drop("committed")


@query(" SELECT op AS kind, count(*) AS n FROM oplog WHERE op IN ('click', 'purchase', 'view') GROUP BY op UNION ALL SELECT op, CAST(1 AS BIGINT) FROM oplog WHERE op IN ('signup', 'error') GROUP BY op", "oplog")
def jsonl_split(spark, d):
    """A log of mixed rows: the last of some kinds, all of others (2.1.31)."""
    names = {"signup": "meta", "error": "verdict", "click": "compare", "purchase": "restart", "view": "case"}
    rows = view(spark, d, "oplog").select(F.col("seq").alias("ts"), "op", F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("op")].alias("kind"))
    parts = logs.split_by_kind(rows)
    out = [p.groupBy(F.col("op").alias("kind")).agg(F.count("*").alias("n")) for p in parts.values()]
    first = out[0]
    for more in out[1:]:
        first = first.union(more)
    return first


@query(" SELECT key, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM oplog", "oplog")
def json_rows(spark, d):
    """Parsed JSON rows (2.1.19)."""
    return view(spark, d, "oplog").select("key", "props", F.from_json("props", "k BIGINT").k.alias("k"))


@query(", c AS (SELECT ino, slot, pool, category, sha256(substr(content, CAST(k * 512 + 1 AS BIGINT), 512)) AS id FROM (SELECT *, unnest(range(0, (length(content) - 1) // 512 + 1)) AS k FROM files WHERE length(content) > 0)), u AS (SELECT id, count(DISTINCT pool) AS n_pools FROM c GROUP BY id) SELECT n_pools, count(*) AS n_unique FROM u GROUP BY n_pools", "files")
def chunk_sharing(spark, d):
    """Unique chunks by how many pools share them (2.4.2)."""
    return dedup.sharing_histogram(dedup.fixed_chunks(view(spark, d, "files"), 512)).select("n_pools", "n_unique")


@query(" SELECT block AS id, pack FROM chunks WHERE pack % 2 = 0 GROUP BY block, pack", "chunks")
def unacknowledged_damage(spark, d):
    """Damage that was not accepted before (2.10.21)."""
    damage = view(spark, d, "chunks").selectExpr("block AS id", "pack").distinct()
    return store.unacknowledged(damage, damage.where("pack % 2 = 1"))


@query(" SELECT file, CAST(sum(len) AS BIGINT) AS size, count(*) AS extents FROM chunks GROUP BY file", "chunks")
def file_sizes(spark, d):
    """Size and number of extents of each file (2.2.1)."""
    return extents.offsets(view(spark, d, "chunks")).groupBy("file").agg(F.max(F.col("off") + F.col("len")).alias("size"), F.count("*").alias("extents"))

"""Queries of deduplication, storage, liveness and extents over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.functions import chunking, scalars
from stonefold.operators import consistency, dedup, extents, store
from stonefold.operators.base import sql
from stonefold.plans.registry import Registry
from stonefold.sources.tables import view

query = Registry()


OBJECTS = ", o AS (SELECT *, sha256(content) AS id FROM files)"


def objects(spark, d) -> DataFrame:
    return dedup.objects(view(spark, d, "files"))


@query(OBJECTS + ", u AS (SELECT id, max(size) AS size, count(*) AS n FROM o GROUP BY id) SELECT CAST(sum(n) AS BIGINT) AS n_objects, count(*) AS n_unique, CAST(sum(n * size) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes, round(CAST(sum(n * size) AS DOUBLE) / greatest(CAST(sum(size) AS DOUBLE), 1), 6) AS ratio FROM u", "files")
def dedup_report(spark, d):
    """Whole-object deduplication: totals and ratio (2.4.2)."""
    return dedup.totals(objects(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(OBJECTS + ", u AS (SELECT id, slot, category, max(size) AS size, count(*) AS n FROM o GROUP BY ALL) SELECT slot, category, CAST(sum(n) AS BIGINT) AS n_objects, count(DISTINCT id) AS n_unique, CAST(sum(n * size) AS BIGINT) AS raw_bytes FROM u GROUP BY GROUPING SETS ((), (slot), (category))", "files")
def dedup_by_source_lang(spark, d):
    """Totals for all, each slot and each category in one pass (2.4.2)."""
    return dedup.by_slot_and_category(objects(spark, d))


@query(OBJECTS + " SELECT category, count(*) AS n_unique, CAST(sum(size) AS BIGINT) AS unique_bytes FROM (SELECT category, id, max(size) AS size FROM o GROUP BY ALL) GROUP BY category", "files")
def unique_by_category(spark, d):
    """Unique bytes of each category; an object counts in every one that holds it (2.4.2)."""
    return dedup.unique_by(objects(spark, d), "category")


@query(OBJECTS + " SELECT n_pools, count(*) AS n_unique, CAST(sum(size) AS BIGINT) AS unique_bytes FROM (SELECT id, count(DISTINCT pool) AS n_pools, max(size) AS size FROM o GROUP BY id) GROUP BY n_pools", "files")
def sharing_histogram(spark, d):
    """Unique bytes by how many pools share them (2.4.2)."""
    return dedup.sharing_histogram(objects(spark, d))


@query(OBJECTS + ", u AS (SELECT id, count(DISTINCT pool) AS n, max(size) AS size FROM o GROUP BY id) SELECT CAST(sum(n * size) AS BIGINT) AS per_pool_unique, CAST(sum(size) AS BIGINT) AS global_unique, CAST(sum((n - 1) * size) AS BIGINT) AS savings FROM u", "files")
def cross_pool_savings(spark, d):
    """Bytes that sharing between pools saves (2.4.2)."""
    return dedup.cross_pool_savings(objects(spark, d))


FIRST = OBJECTS + ", f AS (SELECT slot, size, row_number() OVER (PARTITION BY id ORDER BY pool, ino) AS nth FROM o), s AS (SELECT slot, count(*) AS n_objects, CAST(sum(size) AS BIGINT) AS raw_bytes, count(*) FILTER (nth = 1) AS n_new, CAST(coalesce(sum(size) FILTER (nth = 1), 0) AS BIGINT) AS new_bytes FROM f GROUP BY slot)"


@query(FIRST + " SELECT * FROM s", "files")
def first_seen_attribution(spark, d):
    """An object's bytes charge the slot that brings it first (2.1.1, 2.5.1)."""
    return dedup.first_seen(objects(spark, d), "pool, ino")


@query(FIRST + ", k AS (SELECT *, CAST(regexp_extract(slot, '[0-9]+$') AS BIGINT) AS place FROM s) SELECT slot, CAST(sum(raw_bytes) OVER w AS BIGINT) AS raw_so_far, CAST(sum(new_bytes) OVER w AS BIGINT) AS unique_so_far, round(CAST(sum(raw_bytes) OVER w AS DOUBLE) / CAST(sum(new_bytes) OVER w AS DOUBLE), 6) AS ratio_so_far FROM k WINDOW w AS (ORDER BY place, slot ROWS UNBOUNDED PRECEDING)", "files")
def running_corpus_totals(spark, d):
    """Running totals over slots in numeric order (2.4.18, 2.6.3)."""
    return dedup.running_totals(dedup.first_seen(objects(spark, d), "pool, ino")).withColumn("ratio_so_far", F.round("ratio_so_far", 6))


@query(FIRST + ", k AS (SELECT *, CAST(regexp_extract(slot, '[0-9]+$') AS BIGINT) AS place FROM s) SELECT slot, new_bytes, round(CAST(100 * new_bytes AS DOUBLE) / nullif(first_value(new_bytes) OVER (ORDER BY place, slot), 0), 2) AS pct_of_first FROM k", "files")
def marginal_slot_cost(spark, d):
    """New bytes of a slot as a share of the first slot's (2.4.28)."""
    return dedup.marginal_cost(dedup.first_seen(objects(spark, d), "pool, ino"))


@query(OBJECTS + " SELECT id, count(*) AS n, CAST((count(*) - 1) * max(size) AS BIGINT) AS wasted FROM o GROUP BY id HAVING count(*) > 1", "files")
def whole_doc_duplicates(spark, d):
    """Objects that occur more than once (2.1.1, 2.4.22)."""
    return dedup.duplicates(objects(spark, d))


@query(", c AS (SELECT ino, slot, substr(content, CAST(k * 512 + 1 AS BIGINT), 512) AS chunk FROM (SELECT *, unnest(range(0, (length(content) - 1) // 512 + 1)) AS k FROM files WHERE length(content) > 0)), u AS (SELECT chunk, max(octet_length(encode(chunk))) AS size, count(*) AS n FROM c GROUP BY chunk) SELECT CAST(sum(n) AS BIGINT) AS n_objects, count(*) AS n_unique, CAST(sum(n * size) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes FROM u", "files")
def fixed_chunk_dedup(spark, d):
    """Deduplication of chunks of 512 characters (2.9.1 fixed, 2.4.2)."""
    return dedup.totals(dedup.fixed_chunks(view(spark, d, "files"), 512)).drop("ratio")


@query()
def cdc_chunk_dedup(spark, d):
    """Deduplication of content-defined chunks, sizes scaled to short files (2.1.2, 2.1.28, 2.9.1, 2.9.4)."""
    chunks = chunking.chunk(view(spark, d, "files").select("ino", "slot", "content"), "content", 256, 1024, 4096)
    return sql("SELECT sum(n) AS chunks, count(*) AS unique_chunks, sum(n * size) AS raw_bytes, sum(size) AS unique_bytes, sum(stored) AS stored_bytes FROM (SELECT id, count(*) AS n, max(size) AS size, max(stored) AS stored FROM {c} GROUP BY id)", c=chunks)


@query(OBJECTS + ", s AS (SELECT DISTINCT id FROM o WHERE pool < 10), i AS (SELECT id, size, row_number() OVER (PARTITION BY id ORDER BY size) AS nth FROM o WHERE pool >= 10) SELECT count(*) AS puts, count(*) FILTER (nth = 1 AND s.id IS NULL) AS new_blocks, count(*) FILTER (nth > 1 OR s.id IS NOT NULL) AS dedup_hits, CAST(coalesce(sum(size) FILTER (nth > 1 OR s.id IS NOT NULL), 0) AS BIGINT) AS dedup_bytes FROM i LEFT JOIN s ON i.id = s.id", "files")
def put_blocks(spark, d):
    """Insert-if-absent of the later pools' objects into the earlier ones' (2.4.22, 2.4.23)."""
    rows = objects(spark, d)
    return dedup.put(rows.where("pool < 10"), rows.where("pool >= 10"))


@query(OBJECTS + " SELECT id, size FROM (SELECT DISTINCT id, size FROM o)", "files")
def interned_objects(spark, d):
    """The content-addressed table after all objects went in (2.4.22)."""
    rows = objects(spark, d).select("id", "size")
    return dedup.intern(rows.limit(0), rows)


LIVE = ", live AS (SELECT DISTINCT block AS id FROM chunks JOIN inodes ON file = ino WHERE kind = 'F')"
PLAN = LIVE + ", plan AS (SELECT pack, count(*) AS records, CAST(coalesce(sum(len) FILTER (live.id IS NOT NULL), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(len) FILTER (live.id IS NULL), 0) AS BIGINT) AS dead_bytes FROM chunks LEFT JOIN live ON block = live.id GROUP BY pack), planned AS (SELECT *, CAST(dead_bytes AS DOUBLE) / nullif(live_bytes + dead_bytes, 0) AS dead_ratio FROM plan)"
ACCESS = ", cold AS (SELECT pack, CAST(sum(coalesce(last, 0)) AS BIGINT) // count(*) AS coldness FROM chunks LEFT JOIN (SELECT key AS id, max(seq) AS last FROM oplog GROUP BY key) a ON block = a.id GROUP BY pack)"
#: Stand-in thresholds for small packs.
RATIO, DEAD, FREEZE, BUDGET = 0.02, 100, 800, 50_000


def live(spark, d) -> DataFrame:
    return sql("SELECT DISTINCT block AS id FROM {c} JOIN {i} ON file = ino WHERE kind = 'F'", c=view(spark, d, "chunks"), i=view(spark, d, "inodes"))


def accesses(spark, d) -> DataFrame:
    return view(spark, d, "oplog").selectExpr("key AS id", "seq AS at")


@query(" SELECT (SELECT count(*) FROM blocks) AS blocks, (SELECT CAST(sum(ulen) AS BIGINT) FROM blocks) AS uncompressed, CAST(sum(len) AS BIGINT) AS pack_bytes, count(DISTINCT pack) AS packs, count(*) AS puts, count(*) - count(DISTINCT block) AS dedup_hits FROM chunks", "chunks", "blocks")
def store_stats(spark, d):
    """Store statistics (2.4.1)."""
    return store.stats(view(spark, d, "chunks"), view(spark, d, "blocks"))


@query(PLAN + " SELECT pack, records, live_bytes, dead_bytes, round(dead_ratio, 6) AS dead_ratio FROM planned", "chunks", "inodes")
def pack_plan(spark, d):
    """Live and dead bytes of each pack (2.4.3, 2.4.4, 2.12.7)."""
    return store.pack_plan(view(spark, d, "chunks"), live(spark, d)).withColumn("dead_ratio", F.round("dead_ratio", 6))


@query(PLAN + f" SELECT pack, dead_bytes FROM planned WHERE pack < {FREEZE} AND dead_ratio >= {RATIO} AND dead_bytes >= {DEAD}", "chunks", "inodes")
def gc_candidates(spark, d):
    """Packs worth rewriting, none at or above the freeze point (2.6.2)."""
    return store.candidates(store.pack_plan(view(spark, d, "chunks"), live(spark, d)), FREEZE, RATIO, DEAD).select("pack", "dead_bytes")


@query(PLAN + ACCESS + f", c AS (SELECT planned.*, coldness FROM planned JOIN cold USING (pack) WHERE pack < {FREEZE} AND dead_ratio >= {RATIO} AND dead_bytes >= {DEAD}), r AS (SELECT pack, live_bytes, dead_bytes, CAST(row_number() OVER w AS INTEGER) AS place, coalesce(sum(live_bytes) OVER (ORDER BY coldness, dead_bytes DESC, pack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS copied FROM c WINDOW w AS (ORDER BY coldness, dead_bytes DESC, pack)) SELECT pack, place, live_bytes, dead_bytes FROM r WHERE copied < {BUDGET}", "chunks", "inodes", "oplog")
def gc_budget(spark, d):
    """Candidates in order of coldness and dead bytes, within the copy budget (2.6.2)."""
    chunks = view(spark, d, "chunks")
    return store.within_budget(store.candidates(store.pack_plan(chunks, live(spark, d)), FREEZE, RATIO, DEAD), store.coldness(chunks, accesses(spark, d)), BUDGET).withColumn("place", F.col("place").cast("int"))


@query(PLAN + ACCESS + f", c AS (SELECT planned.*, coldness FROM planned JOIN cold USING (pack) WHERE pack < {FREEZE} AND dead_ratio >= {RATIO} AND dead_bytes >= {DEAD}), r AS (SELECT *, coalesce(sum(live_bytes) OVER (ORDER BY coldness, dead_bytes DESC, pack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c) SELECT (SELECT count(*) FROM planned) AS packs, (SELECT count(*) FROM c) AS candidates, count(*) AS rewritten, CAST(coalesce(sum(live_bytes), 0) AS BIGINT) AS copied, CAST(coalesce(sum(dead_bytes), 0) AS BIGINT) AS reclaimed, CAST(coalesce(sum(dead_bytes), 0) - coalesce(sum(live_bytes), 0) AS BIGINT) AS net FROM r WHERE done < {BUDGET}", "chunks", "inodes", "oplog")
def gc_cycle(spark, d):
    """One collection's report (2.11.14)."""
    return store.collect(view(spark, d, "chunks"), live(spark, d), accesses(spark, d), FREEZE, BUDGET, RATIO, DEAD)


@query(PLAN + " SELECT pack, dead_bytes - live_bytes AS net FROM plan", "chunks", "inodes")
def gc_net(spark, d):
    """Net bytes of rewriting each pack, which may be negative (2.4.5)."""
    return store.net_reclaimed(store.pack_plan(view(spark, d, "chunks"), live(spark, d)))


@query(ACCESS + " SELECT pack, coldness FROM cold", "chunks", "oplog")
def pack_coldness(spark, d):
    """Integer mean of last accesses, repeats counted, missing as 0 (2.4.6, 2.11.10)."""
    return store.coldness(view(spark, d, "chunks"), accesses(spark, d))


@query(LIVE + " SELECT id FROM live WHERE id NOT IN (SELECT id FROM blocks WHERE ulen <= 25)", "chunks", "inodes", "blocks")
def missing_live_blocks(spark, d):
    """Live ids that a store of the small blocks lacks (2.3.3)."""
    return store.missing_live(live(spark, d), view(spark, d, "blocks").where("ulen <= 25"))


@query(", l AS (SELECT DISTINCT block AS id FROM chunks JOIN inodes ON file = ino WHERE kind = 'P') SELECT id, ulen, codec FROM blocks WHERE id NOT IN (SELECT id FROM l)", "chunks", "inodes", "blocks")
def unreferenced_blocks(spark, d):
    """Blocks that no file in the pending state refers to (2.3.3)."""
    some = sql("SELECT DISTINCT block AS id FROM {c} JOIN {i} ON file = ino WHERE kind = 'P'", c=view(spark, d, "chunks"), i=view(spark, d, "inodes"))
    return store.unreferenced(view(spark, d, "blocks"), some)


@query(LIVE + " SELECT DISTINCT block AS id, CASE WHEN block IN (SELECT id FROM live) THEN 'live' ELSE 'condemned' END AS fate FROM chunks WHERE pack = 7", "chunks", "inodes")
def compaction_begin(spark, d):
    """One pack's ids, live or condemned (2.10.24)."""
    return store.split_pack(view(spark, d, "chunks"), 7, live(spark, d))


@query(LIVE + ", o AS (SELECT pack, ord, file, len, row_number() OVER (PARTITION BY pack ORDER BY file, ord) AS n FROM chunks WHERE block IN (SELECT id FROM live)), walk AS (SELECT pack, n, len AS used, 0 AS batch FROM o WHERE n = 1 UNION ALL SELECT o.pack, o.n, CASE WHEN w.used > 0 AND w.used + o.len > 1000 THEN o.len ELSE w.used + o.len END, CASE WHEN w.used > 0 AND w.used + o.len > 1000 THEN w.batch + 1 ELSE w.batch END FROM walk w JOIN o ON o.pack = w.pack AND o.n = w.n + 1) SELECT o.pack, ord, file, len, CAST(batch AS BIGINT) AS batch FROM o JOIN walk w ON o.pack = w.pack AND o.n = w.n", "chunks", "inodes")
def compaction_copy(spark, d):
    """Live records of each pack in batches that never exceed the byte budget (2.10.19)."""
    chunks = view(spark, d, "chunks")
    return store.copy_batches(chunks.join(live(spark, d).withColumnRenamed("id", "block"), "block", "left_semi"), 1000)


@query(", c AS (SELECT DISTINCT pack, block FROM chunks WHERE block NOT IN (SELECT block FROM chunks JOIN inodes ON file = ino WHERE kind = 'P' AND ino % 2 = 0)), l AS (SELECT DISTINCT block AS id FROM chunks JOIN inodes ON file = ino WHERE kind = 'P') SELECT pack, count(*) AS condemned, count(id) AS revived, count(id) = 0 AS discard FROM c LEFT JOIN l ON block = id GROUP BY pack", "chunks", "inodes")
def compaction_discard(spark, d):
    """Packs that may be unlinked, as no condemned id became live (2.10.20): condemned is what the even files of one kind did not refer to."""
    some = sql("SELECT DISTINCT block AS id FROM {c} JOIN {i} ON file = ino WHERE kind = 'P'", c=view(spark, d, "chunks"), i=view(spark, d, "inodes"))
    before = sql("SELECT DISTINCT block FROM {c} JOIN {i} ON file = ino WHERE kind = 'P' AND ino % 2 = 0", c=view(spark, d, "chunks"), i=view(spark, d, "inodes"))
    return store.discardable(view(spark, d, "chunks").join(before, "block", "left_anti").select("pack", "block").distinct(), some)


@query(" SELECT block AS id FROM chunks JOIN inodes ON file = ino WHERE kind IN ('O', 'P') GROUP BY block", "chunks", "inodes")
def live_set_union(spark, d):
    """Union of two roots' live sets (2.7.2, 2.7.4, 2.4.7, 2.12.2)."""
    rows = sql("SELECT block AS id, kind FROM {c} JOIN {i} ON file = ino", c=view(spark, d, "chunks"), i=view(spark, d, "inodes"))
    return store.live_set(rows.where("kind = 'O'"), rows.where("kind = 'P'"))


@query(" SELECT DISTINCT key AS id FROM oplog WHERE op = 'error'", "oplog")
def pinned_union(spark, d):
    """Ids that any poll pinned (2.7.1)."""
    return store.pinned(view(spark, d, "oplog").where("op = 'error'").selectExpr("key AS id"))


@query(" SELECT snapshot AS root, count(*) AS marks FROM inodes WHERE snapshot IN (SELECT id FROM snapshots WHERE pool < 5) GROUP BY snapshot", "inodes", "snapshots")
def retained_marks(spark, d):
    """Recorded sets whose root is still durable (2.7.3)."""
    marks = view(spark, d, "inodes").selectExpr("snapshot AS root", "ino AS id")
    return store.retained(marks, view(spark, d, "snapshots").where("pool < 5").selectExpr("id AS root")).groupBy("root").agg(F.count("*").alias("marks"))


@query(" SELECT block AS id, refs - 1 AS stored, refs AS counted FROM (SELECT block, count(*) AS refs FROM chunks GROUP BY block) WHERE block % 50 = 0", "chunks")
def refcount_mismatch(spark, d):
    """Stored against recomputed reference counts, some tampered with (2.3.5)."""
    chunks = view(spark, d, "chunks")
    stored = chunks.groupBy(F.col("block").alias("id")).agg((F.count("*") - F.when(F.col("block") % 50 == 0, 1).otherwise(0)).alias("refs"))
    return consistency.refcount_mismatch(stored, chunks.selectExpr("block AS id"))


@query(" SELECT dir, count(*) AS by_name, count(*) FILTER (cookie <> 2) AS by_cookie FROM dirents WHERE dir % 3 = 0 GROUP BY dir HAVING count(*) FILTER (cookie = 2) > 0", "dirents")
def dirent_index_check(spark, d):
    """Two indexes of one relation compared as multisets, some tampered with (2.3.6)."""
    rows = view(spark, d, "dirents")
    return consistency.index_disagreement(rows, rows.where("NOT (dir % 3 = 0 AND cookie = 2)"))


@query(", i AS (SELECT block AS id, min(pack) AS pack, min(ord) AS off FROM chunks GROUP BY block), v AS (SELECT * FROM i WHERE id % 11 <> 0) SELECT id, 'missing' AS kind, CAST(1 AS BIGINT) AS n FROM i WHERE id % 11 = 0", "chunks")
def fsck_index(spark, d):
    """Index entries without a verified record (2.3.4, 2.10.21)."""
    index = view(spark, d, "chunks").groupBy(F.col("block").alias("id")).agg(F.min("pack").alias("pack"), F.min("ord").alias("off"))
    return consistency.index_damage(index, index.where("id % 11 <> 0"))


OFF = ", e AS (SELECT file, ord, block, len, CAST(sum(len) OVER (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS off FROM chunks)"


@query(OFF + " SELECT file, ord, block, len, off FROM e", "chunks")
def extent_offsets(spark, d):
    """Prefix sums of extent lengths (2.5.2, 2.1.16)."""
    return extents.offsets(view(spark, d, "chunks"))


@query(OFF + " SELECT file, ord, block, greatest(off, 20) AS from_off, least(off + len, 60) - greatest(off, 20) AS n, greatest(off, 20) - off AS skip FROM e WHERE off < 60 AND off + len > 20", "chunks")
def range_read(spark, d):
    """Parts of extents in a byte range (2.3.8, 2.15 read)."""
    return extents.range_read(extents.offsets(view(spark, d, "chunks")), 20, 60)


@query(OFF + " SELECT file, ord, off FROM e WHERE off >= 20 AND off < 60", "chunks")
def chunk_range(spark, d):
    """Extents that begin in a range (2.3.9)."""
    return extents.chunk_range(extents.offsets(view(spark, d, "chunks")), 20, 60).select("file", "ord", "off")


@query(OFF + " SELECT file, ord, off, len FROM e WHERE off < 60 AND off + len > 20 AND NOT (off >= 20 AND off + len <= 60)", "chunks")
def partial_cover(spark, d):
    """Extents covered in part (2.3.11)."""
    return extents.partly_covered(extents.offsets(view(spark, d, "chunks")), 20, 60).select("file", "ord", "off", "len")


@query(OFF + ", r AS (SELECT ino AS file, ino % 40 AS lo, ino % 40 + 35 AS hi FROM inodes WHERE kind = 'P') SELECT r.file, lo, hi, ord, greatest(lo, off) AS from_off, least(hi, off + len) - greatest(lo, off) AS n FROM r JOIN e ON r.file = e.file AND off < hi AND off + len > lo", "chunks", "inodes")
def overlay_overlap(spark, d):
    """Range join of dirty ranges and extents by byte buckets (2.3.10)."""
    ranges = sql("SELECT ino AS file, ino % 40 AS lo, ino % 40 + 35 AS hi FROM {i} WHERE kind = 'P'", i=view(spark, d, "inodes"))
    return extents.overlaps(ranges, extents.offsets(view(spark, d, "chunks"))).drop("block")


MERGED = """, w AS (SELECT pack, off * 7 + e.file % 500 AS lo, off * 7 + e.file % 500 + e.len AS hi FROM e JOIN chunks USING (file, ord)),
g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY pack ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY pack ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT pack, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM s GROUP BY pack, island"""


@query(OFF + MERGED, "chunks")
def interval_merge(spark, d):
    """Touching or overlapping extents merged (2.5.6)."""
    chunks = view(spark, d, "chunks")
    writes = sql("SELECT c.pack, e.off * 7 + e.file % 500 AS lo, e.off * 7 + e.file % 500 + e.len AS hi FROM {e} e JOIN {c} c ON e.file = c.file AND e.ord = c.ord", e=extents.offsets(chunks), c=chunks)
    return extents.merged(writes, "pack")


@query(" SELECT ino AS file, CAST(100 AS BIGINT) AS size, CAST(coalesce(sum(len) FILTER (block % 9 <> 0), 0) AS BIGINT) AS covered, CAST(coalesce(sum(len) FILTER (block % 9 = 0), 0) AS BIGINT) AS holes, CAST(100 - coalesce(sum(len), 0) AS BIGINT) AS short FROM inodes LEFT JOIN chunks ON ino = file GROUP BY ino", "inodes", "chunks")
def holes_and_coverage(spark, d):
    """Bytes in blocks and holes against sizes (2.2.10, 2.3.6)."""
    rows = sql("SELECT file, CASE WHEN block % 9 <> 0 THEN block END AS block, len FROM {c}", c=view(spark, d, "chunks"))
    return extents.coverage(rows, view(spark, d, "inodes").selectExpr("ino AS file", "100L AS size"))


@query(OFF + ", n AS (SELECT file, off, CASE WHEN ord = 2 THEN block + 1 ELSE block END AS block, len FROM e WHERE ord <> 4) SELECT coalesce(n.file, e.file) AS file, coalesce(n.off, e.off) AS off, CASE WHEN e.file IS NULL THEN 'put' WHEN n.file IS NULL THEN 'drop' ELSE 'replace' END AS change FROM n FULL OUTER JOIN e ON n.file = e.file AND n.off = e.off WHERE n.block IS DISTINCT FROM e.block OR n.len IS DISTINCT FROM e.len", "chunks")
def extent_placement(spark, d):
    """What a rewrite of chunk lists must touch (2.5.3, 2.10.7)."""
    old = extents.offsets(view(spark, d, "chunks"))
    return extents.changed(old, old.where("ord <> 4").withColumn("block", F.when(F.col("ord") == 2, F.col("block") + 1).otherwise(F.col("block"))))


@query(OFF + " SELECT file, ord, block, off, least(len, 50 - off) AS len, off + len > 50 AS rechunk FROM e WHERE off < 50", "chunks")
def truncate_extents(spark, d):
    """Chunk lists cut at a size (2.10.22, 2.10.6)."""
    return extents.truncate(extents.offsets(view(spark, d, "chunks")), 50)


@query(OFF + " SELECT file, block, off, len, false AS rechunk FROM e WHERE off + len <= 20 OR off >= 60 UNION ALL SELECT file, block, off, 20 - off, true FROM e WHERE off < 20 AND off + len > 20 UNION ALL SELECT file, block, 60, off + len - 60, true FROM e WHERE off < 60 AND off + len > 60 UNION ALL SELECT file, NULL, 20, least(60, max(off + len)) - 20, false FROM e GROUP BY file HAVING max(off + len) > 20", "chunks")
def punch_hole(spark, d):
    """A range made a hole (2.10.23)."""
    return extents.punch(extents.offsets(view(spark, d, "chunks")), 20, 60).withColumns({"off": F.col("off").cast("long"), "len": F.col("len").cast("long")})


@query(OFF + ", b AS (SELECT file, list(off) || list(off + len) AS ends FROM e GROUP BY file), x AS (SELECT ino AS file, ino % 4 AS version, ino % 3 AS expected, CASE WHEN ino % 2 = 0 THEN 0 ELSE 1 END AS lo, (SELECT max(off) FROM e WHERE file = ino) AS hi FROM inodes) SELECT x.file, CASE WHEN version <> expected THEN 'conflict' WHEN NOT coalesce(list_contains(ends, lo) AND list_contains(ends, hi) AND hi > 0, false) THEN 'unaligned' ELSE 'spliced' END AS outcome, CASE WHEN version = expected AND coalesce(list_contains(ends, lo) AND list_contains(ends, hi) AND hi > 0, false) THEN version + 1 ELSE version END AS version FROM x JOIN b ON x.file = b.file", "chunks", "inodes")
def splice_content(spark, d):
    """Range replacement under compare-and-swap; a conflict is a result (2.10.8)."""
    old, inodes = extents.offsets(view(spark, d, "chunks")), view(spark, d, "inodes")
    edits = sql("SELECT ino AS file, ino % 3 AS expected, CASE WHEN ino % 2 = 0 THEN 0 ELSE 1 END AS lo, m.hi FROM {i} JOIN (SELECT file, max(off) AS hi FROM {e} GROUP BY file) m ON ino = m.file", i=inodes, e=old)
    return extents.splice(old, edits, inodes.selectExpr("ino AS file", "ino % 4 AS version"))


@query(OFF + ", x AS (SELECT file, min(off) FILTER (off > 0) AS lo, max(off) AS hi, file % 3 AS expected, file % 4 AS version FROM e GROUP BY file HAVING count(*) > 2), ok AS (SELECT * FROM x WHERE expected = version) SELECT file, off, block, len FROM e WHERE file NOT IN (SELECT file FROM ok) UNION ALL SELECT e.file, off, block, len FROM e JOIN ok ON e.file = ok.file WHERE off < lo UNION ALL SELECT file, lo, -1, 7 FROM ok UNION ALL SELECT e.file, lo + 7, block, len FROM e JOIN ok ON e.file = ok.file WHERE off = hi", "chunks")
def spliced_extents(spark, d):
    """The chunk lists after range replacement: the middle of each file becomes one chunk of seven bytes, the last is moved (2.10.8)."""
    old = extents.offsets(view(spark, d, "chunks")).select("file", "block", "off", "len")
    edits = sql("SELECT file, file % 3 AS expected, min(off) FILTER (WHERE off > 0) AS lo, max(off) AS hi, -1L AS block, 7L AS len FROM {e} GROUP BY file HAVING count(*) > 2", e=old)
    out = extents.spliced(old, edits, sql("SELECT DISTINCT file, file % 4 AS version FROM {e}", e=old))
    return out.select("file", F.col("off").cast("long").alias("off"), "block", F.col("len").cast("long").alias("len"))


@query(" SELECT file, ord, 'block too long' AS why FROM chunks WHERE len > 45 ORDER BY file, ord LIMIT 50", "chunks")
def capped_report(spark, d):
    """The first 50 findings of a check, in order; the cap is the feature (2.6.5, 2.6.6)."""
    rows = view(spark, d, "chunks").withColumn("hole", F.lit(False))
    return consistency.capped(extents.invalid_refs(rows, 45), "file, ord", 50).select("file", "ord", "why")


@query(" SELECT id, k AS ord, least(1000, ulen * 300 - k * 1000) AS len FROM (SELECT *, unnest(range(0, (ulen * 300 - 1) // 1000 + 1)) AS k FROM blocks)", "blocks")
def hole_refs(spark, d):
    """Lengths as holes of bounded size (2.9.8)."""
    return extents.hole_refs(view(spark, d, "blocks").selectExpr("id", "CAST(ulen AS BIGINT) * 300 AS len"), 1000)


@query(" SELECT file, ord, CASE WHEN (ord % 5 = 0) <> (block % 9 = 0) THEN 'flag' WHEN ord % 5 <> 0 AND len > 45 THEN 'block too long' WHEN ord % 5 = 0 AND len > 40 THEN 'hole too long' END AS why FROM chunks WHERE (ord % 5 = 0) <> (block % 9 = 0) OR ord % 5 <> 0 AND len > 45 OR ord % 5 = 0 AND len > 40", "chunks")
def chunk_ref_faults(spark, d):
    """Chunk references that break a rule (2.2.11)."""
    rows = sql("SELECT file, ord, CASE WHEN block % 9 <> 0 THEN block END AS block, len, ord % 5 = 0 AS hole FROM {c}", c=view(spark, d, "chunks"))
    return extents.invalid_refs(rows, 45, 40).select("file", "ord", "why")


@query(", b AS (SELECT *, id % 3 > 0 AND id % 1000 > 0 AS fits FROM blocks) SELECT id, sha256(codec) AS block_id, CASE WHEN fits THEN (id % 1000 << 40) | (id * 7919) END AS packed, CASE WHEN fits THEN id % 1000 END AS snapshot, CASE WHEN fits THEN id * 7919 END AS inode, (id << 32) | 5 AS device, id AS major, CAST(5 AS BIGINT) AS minor FROM b", "blocks")
def identity_functions(spark, d):
    """Block ids, packed inodes and devices, there and back (2.9.2, 2.9.5, 2.9.6, 2.9.7)."""
    rows = view(spark, d, "blocks").select("id", scalars.block_id(F.col("codec")).alias("block_id"), scalars.pack_inode(F.when(F.col("id") % 3 > 0, F.col("id") % 1000).otherwise(-1), F.col("id") * 7919).alias("packed"), scalars.make_device(F.col("id"), F.lit(5)).alias("device"))
    snapshot, inode = scalars.unpack_inode(F.col("packed"))
    major, minor = scalars.device_parts(F.col("device"))
    return rows.select("*", snapshot.alias("snapshot"), inode.alias("inode"), major.alias("major"), minor.alias("minor"))


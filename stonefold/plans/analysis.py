"""Queries of comparisons, statistics, graphs, namespaces, functions and logs over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.functions import paths, scalars
from stonefold.operators import compare, graph, namespace, stats
from stonefold.operators.base import sql
from stonefold.plans.registry import Registry
from stonefold.sources import logs, parsers, walk
from stonefold.sources.tables import table, view
from stonefold.streaming import operators as streams

query = Registry()


# ---- two arms

STATUS = "CASE {c} % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT_RUN' WHEN 3 THEN 'PASS' ELSE 'TIMEOUT' END"
STATUS_B = "CASE {c} % 7 WHEN 0 THEN 'PASS_EMULATED' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'NOT_RUN' WHEN 3 THEN 'NO_RESULT' ELSE 'PASS' END"


@query(" SELECT test, CASE WHEN arm_a = 1 THEN 'worse' ELSE 'better' END AS label FROM outcomes WHERE arm_a <> arm_b", "outcomes")
def ordinal_diff(spark, d):
    """Positions where one arm alone passes (2.3.14)."""
    rows = view(spark, d, "outcomes")
    arm = lambda c: rows.select("test", F.lit(1).alias("n"), (F.col(c) == 1).alias("ok"))
    return compare.ordinal_rows(arm("arm_a"), arm("arm_b")).select("test", "label")


def statuses(spark, d) -> DataFrame:
    return sql(f"SELECT test, {STATUS.format(c='test')} AS a, {STATUS_B.format(c='(test + arm_a)')} AS b FROM {{o}}", o=view(spark, d, "outcomes"))


LABELS = f", s AS (SELECT test, {STATUS.format(c='test')} AS a, {STATUS_B.format(c='(test + arm_a)')} AS b FROM outcomes), l AS (SELECT test, a, b, CASE WHEN 'NO_RESULT' IN (a, b) THEN 'invalid' WHEN a = 'PASS' AND b = 'PASS' THEN 'both_pass' WHEN a = 'PASS' AND b = 'PASS_EMULATED' THEN 'emulated' WHEN a = 'PASS' AND b = 'NOT_RUN' THEN 'gap' WHEN a = 'PASS' THEN 'worse' WHEN b IN ('PASS', 'PASS_EMULATED') THEN 'better' WHEN a = b AND a = 'FAIL' THEN 'both_fail' WHEN a = b AND a = 'NOT_RUN' THEN 'both_not_run' ELSE 'other' END AS label FROM s)"


@query(LABELS + " SELECT * FROM l", "outcomes")
def two_arm_labels(spark, d):
    """Label of each pair of statuses (2.3.19)."""
    return compare.labelled_pairs(statuses(spark, d))


@query(LABELS + " SELECT count(*) FILTER (label = 'both_pass') AS both_pass, count(*) FILTER (label = 'worse') AS worse, count(*) FILTER (label = 'gap') AS gap, count(*) FILTER (label = 'better') AS better, CASE WHEN count(*) FILTER (label = 'invalid') > 0 THEN 'INVALID' WHEN count(*) FILTER (label = 'gap') > 0 THEN 'UNMEASURABLE' WHEN count(*) FILTER (label = 'worse') > 0 THEN 'FAIL' ELSE 'PASS' END AS state FROM l", "outcomes")
def differential_receipt(spark, d):
    """Label counts and the state by precedence (2.4.17)."""
    return compare.receipt(compare.labelled_pairs(statuses(spark, d)))


OPS = ", x AS (SELECT key % 40 AS test, op, seq, CASE WHEN seq % 2 = 0 THEN 'native' ELSE 'tested' END AS arm, value > 50 AS ok FROM oplog), k AS (SELECT *, row_number() OVER (PARTITION BY arm, test, op ORDER BY seq) AS occurrence, count(*) OVER (PARTITION BY arm, test, op) AS times FROM x), p AS (SELECT coalesce(a.test, b.test) AS test, coalesce(a.op, b.op) AS op, coalesce(a.occurrence, b.occurrence) AS occurrence, a.ok AS native_ok, b.ok AS tested_ok, CASE WHEN b.seq IS NULL THEN 'only native' WHEN a.seq IS NULL THEN 'only tested' WHEN a.times <> b.times THEN 'multiplicity' END AS why FROM (SELECT * FROM k WHERE arm = 'native') a FULL OUTER JOIN (SELECT * FROM k WHERE arm = 'tested') b ON a.test = b.test AND a.op = b.op AND a.occurrence = b.occurrence)"


def assertions(spark, d) -> DataFrame:
    return sql("SELECT key % 40 AS test, op, seq AS n, CASE WHEN seq % 2 = 0 THEN 'native' ELSE 'tested' END AS arm, value > 50 AS ok FROM {o}", o=view(spark, d, "oplog"))


@query(OPS + " SELECT test, op, CAST(occurrence AS INTEGER) AS occurrence, native_ok, tested_ok, why FROM p", "oplog")
def identity_pairing(spark, d):
    """Assertions of two arms paired by operation and occurrence (2.3.15, 2.5.5)."""
    return compare.identity_pairs(assertions(spark, d), "native", "tested")


@query(OPS + " SELECT CASE WHEN why IS NOT NULL THEN 'unpairable' WHEN native_ok AND NOT tested_ok THEN 'regression' WHEN tested_ok AND NOT native_ok THEN 'looser' ELSE 'same' END AS label, count(*) AS n FROM p GROUP BY 1", "oplog")
def arm_rollup(spark, d):
    """Regressions, looser, equal and unpairable assertions (2.3.16)."""
    return compare.rollup(compare.identity_pairs(assertions(spark, d), "native", "tested"))


ACCEPTED = ", w AS (SELECT test, test % 3 AS n, 'detail ' || test AS detail FROM outcomes WHERE arm_a > arm_b), a AS (SELECT test + test % 2 AS test, test % 3 AS n, 'known' AS reason FROM outcomes WHERE test % 4 < 2)"


@query(ACCEPTED + " SELECT test, n, CASE WHEN max(reason) IS NULL THEN 'uncovered' ELSE 'waived' END AS state, max(reason) AS reason FROM w LEFT JOIN a USING (test, n) GROUP BY test, n UNION ALL SELECT test, n, 'stale', reason FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.test = a.test AND w.n = a.n)", "outcomes")
def accepted_divergence(spark, d):
    """Waived, uncovered and stale divergences (2.3.17)."""
    o = view(spark, d, "outcomes")
    worse = sql("SELECT test, test % 3 AS n, concat('detail ', test) AS detail FROM {o} WHERE arm_a > arm_b", o=o)
    accepted = sql("SELECT test + test % 2 AS test, test % 3 AS n, '^detail' AS pattern, 'known' AS reason FROM {o} WHERE test % 4 < 2", o=o)
    return compare.reconcile(worse, accepted)


@query(" SELECT test, CASE WHEN regexp_matches('detail ' || test, '7$') THEN 'seven' WHEN regexp_matches('detail ' || test, '^detail 1') THEN 'one' END AS reason FROM outcomes", "outcomes")
def derived_divergence(spark, d):
    """The first rule that fits each row (2.3.18)."""
    rows = sql("SELECT test, concat('detail ', test) AS detail FROM {o}", o=view(spark, d, "outcomes"))
    return compare.derive(rows, [("7$", "seven"), ("^detail 1", "one")]).select("test", "reason")


OUTCOME = "CASE {c} % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'refused' WHEN 2 THEN 'failed' ELSE 'passed' END"


@query(f", r AS (SELECT test, {OUTCOME.format(c='test')} AS a, {OUTCOME.format(c='(test // 2)')} AS b, test % 4 = 0 AS other FROM outcomes) SELECT test, CASE WHEN a = 'skipped' OR b = 'skipped' THEN 'INVALID' WHEN a = 'refused' OR b = 'refused' OR a = 'failed' THEN 'UNMEASURABLE' WHEN b = 'failed' THEN 'FAIL' WHEN other THEN 'UNMEASURABLE' ELSE 'PASS' END AS verdict FROM r", "outcomes")
def two_arm_verdict(spark, d):
    """Verdict of each case; unequal residue is never a pass (2.3.20)."""
    rows = sql(f"SELECT test, {OUTCOME.format(c='test')} AS native, {OUTCOME.format(c='(test DIV 2)')} AS tested, array('a', 'b', 'b') AS native_residue, CASE WHEN test % 4 = 0 THEN array('a', 'b') ELSE array('b', 'a', 'b') END AS tested_residue FROM {{o}}", o=view(spark, d, "outcomes"))
    return compare.case_verdict(rows)


@query(" SELECT seq // 4 AS gate, CASE WHEN bool_or(op = 'error') THEN 'INVALID' WHEN bool_or(op = 'purchase') THEN 'FAIL' WHEN bool_or(op = 'signup') THEN 'UNMEASURABLE' ELSE 'PASS' END AS bench, CASE WHEN bool_or(op = 'error') THEN 'INVALID' WHEN bool_or(op = 'signup') THEN 'UNMEASURABLE' WHEN bool_or(op = 'purchase') THEN 'FAIL' ELSE 'PASS' END AS receipt FROM oplog GROUP BY 1", "oplog")
def verdict_precedence(spark, d):
    """States by the two orders of precedence, kept apart (2.4.29)."""
    rows = sql("SELECT seq DIV 4 AS gate, CASE op WHEN 'error' THEN 'INVALID' WHEN 'purchase' THEN 'FAIL' WHEN 'signup' THEN 'UNMEASURABLE' ELSE 'PASS' END AS verdict FROM {o}", o=view(spark, d, "oplog"))
    return compare.worst(rows, compare.BENCH_PRECEDENCE, "gate").select("gate", F.col("state").alias("bench")).join(compare.worst(rows, compare.RECEIPT_PRECEDENCE, "gate").select("gate", F.col("state").alias("receipt")), "gate")


@query(" SELECT key % 50 AS run, CASE WHEN bool_or(op = 'error' AND value > 90) THEN 'INVALID' WHEN bool_or(op = 'purchase' AND value > 90) THEN 'FAIL' WHEN bool_or(op = 'signup' AND value > 90) THEN 'UNMEASURABLE' ELSE 'PASS' END AS state, count(*) FILTER (op = 'view') AS coverage FROM oplog WHERE value > 90 OR op = 'view' GROUP BY 1", "oplog")
def suite_verdict(spark, d):
    """State of a run from the kinds of its reasons; coverage never changes it (2.4.29)."""
    rows = sql("SELECT key % 50 AS run, CASE op WHEN 'error' THEN 'integrity' WHEN 'purchase' THEN 'divergence' WHEN 'signup' THEN 'capability' WHEN 'view' THEN 'coverage' ELSE 'other' END AS kind FROM {o} WHERE value > 90 OR op = 'view'", o=view(spark, d, "oplog"))
    return compare.suite_verdict(rows)


@query(" SELECT CASE WHEN arm_a > arm_b THEN 'worse' WHEN test % 5 = 0 THEN 'fifth' WHEN arm_b = 1 THEN 'toxic' ELSE 'rest' END AS bucket, count(*) AS n FROM outcomes GROUP BY 1", "outcomes")
def exclusive_partition(spark, d):
    """First-match-wins buckets that add up (2.4.16)."""
    return compare.partition_histogram(view(spark, d, "outcomes"), [("worse", "arm_a > arm_b"), ("fifth", "test % 5 = 0"), ("toxic", "arm_b = 1")])


@query(" SELECT coalesce(a.gate, b.gate) AS gate, CASE WHEN a.gate IS NULL THEN 'native' ELSE 'tested' END AS missing, array_to_string(coalesce(a.s, b.s), ',') AS sources FROM (SELECT ino % 70 AS gate, list_sort(list(DISTINCT slot)) AS s FROM files WHERE ino % 70 < 60 GROUP BY 1) a FULL OUTER JOIN (SELECT ino % 70 AS gate, list_sort(list(DISTINCT slot)) AS s FROM files WHERE ino % 70 > 10 GROUP BY 1) b ON a.gate = b.gate WHERE a.gate IS NULL OR b.gate IS NULL", "files")
def coverage_gaps(spark, d):
    """Gates that one arm lacks (2.3.21)."""
    files = view(spark, d, "files").selectExpr("ino % 70 AS gate", "slot AS source", "ino")
    return compare.coverage_gaps(files.where("gate < 60"), files.where("gate > 10")).withColumn("sources", F.array_join("sources", ","))


@query(" SELECT name, 'computed only' AS side FROM (SELECT kind AS name FROM dirents WHERE cookie < 6 EXCEPT ALL SELECT kind FROM dirents WHERE cookie < 5) UNION ALL SELECT name, 'reviewed only' FROM (SELECT kind AS name FROM dirents WHERE cookie < 5 EXCEPT ALL SELECT kind FROM dirents WHERE cookie < 6)", "dirents")
def allowlist_drift(spark, d):
    """Multiset difference both ways (2.3.30)."""
    rows = view(spark, d, "dirents").selectExpr("kind AS name", "cookie")
    return compare.drift(rows.where("cookie < 6").select("name"), rows.where("cookie < 5").select("name"))


#: Files of even inodes against those of the next odd one; a seventh lie at other paths, and all are in both trees a second time.
TREES = ", both_trees AS (SELECT 1000000000 + ino AS path, category AS kind, size, sha256(content) AS digest FROM files), a AS (SELECT CASE WHEN ino // 2 % 7 = 0 THEN -1 - ino // 2 ELSE ino // 2 END AS path, category AS kind, size, sha256(content) AS digest FROM files WHERE ino % 2 = 0 UNION ALL SELECT * FROM both_trees), b AS (SELECT ino // 2 AS path, category AS kind, size, sha256(content) AS digest FROM files WHERE ino % 2 = 1 UNION ALL SELECT * FROM both_trees)"


def trees(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = sql("SELECT ino DIV 2 AS path, category AS kind, size, sha2(content, 256) AS digest, ino FROM {f}", f=view(spark, d, "files"))
    both = rows.withColumn("path", 1000000000 + F.col("ino")).drop("ino")
    a = rows.where("ino % 2 = 0").drop("ino").withColumn("path", F.when(F.col("path") % 7 == 0, -1 - F.col("path")).otherwise(F.col("path")))
    return a.union(both), rows.where("ino % 2 = 1").drop("ino").union(both)


@query(TREES + ", x AS (SELECT coalesce(a.kind, b.kind) AS kind, greatest(coalesce(a.size, 0), coalesce(b.size, 0)) AS size, CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' WHEN a.size <> b.size THEN 'size' WHEN a.digest <> b.digest THEN 'content' ELSE 'same' END AS label FROM a FULL OUTER JOIN b ON a.path = b.path) SELECT kind, label, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY kind, label", "files")
def tree_diff(spark, d):
    """Two trees by kind and label (2.3.25)."""
    return compare.tree_diff(*trees(spark, d))


@query(TREES + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' ELSE 'removed' END AS change, NULL AS old, NULL AS new FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL UNION ALL SELECT a.path, 'kind', a.kind, b.kind FROM a JOIN b ON a.path = b.path WHERE a.kind <> b.kind UNION ALL SELECT a.path, 'size', CAST(a.size AS VARCHAR), CAST(b.size AS VARCHAR) FROM a JOIN b ON a.path = b.path WHERE a.size <> b.size", "files")
def manifest_diff(spark, d):
    """Added, removed and changed fields (2.3.26, 2.3.27)."""
    return compare.manifest_diff(*trees(spark, d), "path", ["kind", "size"])


STREAMS = ", s AS (SELECT key, op, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS pos FROM oplog), x AS (SELECT coalesce(a.key // 2, b.key // 2) AS pair, coalesce(a.pos, b.pos) AS pos, a.op AS native_op, b.op AS tested_op FROM (SELECT * FROM s WHERE key % 2 = 0) a FULL OUTER JOIN (SELECT * FROM s WHERE key % 2 = 1) b ON a.key // 2 = b.key // 2 AND a.pos = b.pos WHERE a.op IS DISTINCT FROM b.op)"


@query(STREAMS + " SELECT CAST(pair AS BIGINT) AS pair, CAST(pos AS INTEGER) AS pos, native_op, tested_op, coalesce(native_op = 'view', false) AS capability FROM x WHERE (pair, pos) IN (SELECT pair, min(pos) FROM x GROUP BY pair)", "oplog")
def first_divergence(spark, d):
    """First position where the streams of each two neighbouring keys differ (2.3.28)."""
    s = sql("SELECT CAST(key DIV 2 AS BIGINT) AS pair, key % 2 AS side, op, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS pos FROM {o}", o=view(spark, d, "oplog"))
    return compare.first_divergence(s.where("side = 0"), s.where("side = 1"), sql("SELECT DISTINCT op FROM {o} WHERE op = 'view'", o=view(spark, d, "oplog")), "pair")


@query(" SELECT op, count(*) FILTER (key % 2 = 0) - count(*) FILTER (key % 2 = 1) AS delta, op IN ('view', 'click') AS explained FROM oplog GROUP BY op HAVING count(*) FILTER (key % 2 = 0) <> count(*) FILTER (key % 2 = 1)", "oplog")
def delta_attribution(spark, d):
    """Differing operation counts, explained or not (2.3.29)."""
    o = view(spark, d, "oplog")
    deltas = o.groupBy("op").agg((F.count_if(F.col("key") % 2 == 0) - F.count_if(F.col("key") % 2 == 1)).alias("delta"))
    return compare.attributed(deltas, o.where("op IN ('view', 'click')").select("op").distinct())


@query(", p AS (SELECT ino AS name, CASE ino % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'applied' ELSE 'removed' END AS level, size FROM files), o AS (SELECT ino AS name, size + CASE WHEN ino % 11 = 0 THEN 1 ELSE 0 END AS size FROM files WHERE ino % 7 > 0) SELECT p.name, level, CASE WHEN level = 'removed' THEN CASE WHEN o.name IS NULL THEN 'ok' ELSE 'came back' END WHEN o.name IS NULL THEN CASE WHEN level = 'durable' THEN 'lost' ELSE 'ok' END WHEN o.size <> p.size THEN 'damaged' ELSE 'ok' END AS state FROM p LEFT JOIN o ON p.name = o.name", "files")
def receipt_readback(spark, d):
    """Receipts against what is there (2.3.33)."""
    f = view(spark, d, "files")
    promised = sql("SELECT ino AS name, CASE ino % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'applied' ELSE 'removed' END AS level, size, 'x' AS digest FROM {f}", f=f)
    observed = sql("SELECT ino AS name, size + CASE WHEN ino % 11 = 0 THEN 1 ELSE 0 END AS size, 'x' AS digest FROM {f} WHERE ino % 7 > 0", f=f)
    return compare.readback(promised, observed)


@query(" SELECT id AS name FROM snapshots WHERE id % 2 = 0 AND id % 5 = 0", "snapshots")
def snapshot_names_check(spark, d):
    """Durable names that a listing lacks (2.3.34)."""
    s = view(spark, d, "snapshots").selectExpr("id AS name", "CASE WHEN id % 2 = 0 THEN 'durable' ELSE 'applied' END AS level")
    return compare.unlisted(s, s.where("name % 5 > 0"))


@query(" SELECT id AS repo, CASE WHEN id % 10 = 0 THEN 'no record' WHEN id % 10 = 1 THEN 'no head' WHEN id % 10 = 2 THEN 'unresolved' WHEN id % 10 = 3 THEN 'stale' ELSE 'fresh' END AS state, id % 10 > 3 AS fresh FROM snapshots", "snapshots")
def base_freshness(spark, d):
    """Whether a base's commit is the head; unknown is not fresh (2.2.19)."""
    s = view(spark, d, "snapshots")
    bases = sql("SELECT id AS repo, CASE WHEN id % 10 > 0 THEN name END AS commit FROM {s}", s=s)
    heads = sql("SELECT id AS repo, CASE id % 10 WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE name END AS commit FROM {s} WHERE id % 10 <> 1", s=s)
    return compare.freshness(bases, heads)


# ---- statistics


@query(" SELECT op, median(value) AS median, min(value) AS lo, max(value) AS hi, count(value) AS n FROM oplog GROUP BY op", "oplog")
def arm_medians(spark, d):
    """Median and spread (2.4.8, 2.4.9)."""
    return stats.medians(view(spark, d, "oplog"), "op")


@query(" SELECT key, CASE WHEN bool_or(seq % 300 = 0) THEN 'unknown' ELSE CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR) END AS peak FROM oplog GROUP BY key", "oplog")
def peak_load(spark, d):
    """Largest value, unknown if any is (2.4.10)."""
    rows = sql("SELECT key, CASE WHEN seq % 300 > 0 THEN value END AS value FROM {o}", o=view(spark, d, "oplog"))
    return stats.peak_or_unknown(rows, "key").select("key", F.when(F.isnan("peak"), "unknown").otherwise(F.floor("peak").cast("string")).alias("peak"))


@query(", a AS (SELECT row_number() OVER (ORDER BY seq) AS rep, value AS v FROM oplog WHERE op = 'error'), b AS (SELECT row_number() OVER (ORDER BY seq) AS rep, value AS v FROM oplog WHERE op = 'signup') SELECT CAST(rep AS INTEGER) AS rep, round(b.v / a.v, 6) AS ratio FROM a JOIN b USING (rep) WHERE a.v <> 0", "oplog")
def rep_ratios_by_position(spark, d):
    """Ratios of repetitions paired by position (2.4.11)."""
    o = view(spark, d, "oplog")
    return stats.positional_ratios(o.where("op = 'error'"), o.where("op = 'signup'"), "seq").select(F.col("rep").cast("int").alias("rep"), F.round("ratio", 6).alias("ratio"))


@query(" SELECT op, list_sort(list(value))[least(count(*) - 1, (95 * count(*)) // 100) + 1] AS p95 FROM oplog GROUP BY op", "oplog")
def nearest_rank_p95(spark, d):
    """Nearest-rank p95, not percentile_disc (2.4.12)."""
    return stats.nearest_rank_p95(view(spark, d, "oplog"), "op")


@query(" SELECT key % 30 AS gate, median(value) FILTER (op = 'click') AS base, median(value) FILTER (op = 'view') AS other, round(median(value) FILTER (op = 'view') / nullif(median(value) FILTER (op = 'click'), 0), 6) AS ratio FROM oplog GROUP BY 1", "oplog")
def ratio_of_medians(spark, d):
    """Ratio of two arms' medians by gate (2.4.13)."""
    rows = view(spark, d, "oplog").selectExpr("key % 30 AS gate", "op AS arm", "value")
    return stats.ratio_of_medians(rows, "gate", "arm", "click", "view").withColumn("ratio", F.round("ratio", 6))


@query(", r AS (SELECT key AS gate, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS arm, 20 + value AS value FROM oplog), g AS (SELECT gate, count(*) FILTER (arm = 'a') AS na, count(*) FILTER (arm = 'b') AS nb, median(value) FILTER (arm = 'a') AS ma, min(value) FILTER (arm = 'a') AS la, max(value) FILTER (arm = 'a') AS ha, min(value) FILTER (arm = 'b') AS lb, max(value) FILTER (arm = 'b') AS hb FROM r GROUP BY gate) SELECT gate, CASE WHEN na < 3 OR nb < 3 THEN 'reps' WHEN ma < 30 THEN 'floor' WHEN la <= 0 OR ha > 4 * la OR lb <= 0 OR hb > 4 * lb THEN 'spread' WHEN NOT (hb <= 2 * la OR lb > 2 * ha) THEN 'flip' END AS why FROM g", "oplog")
def ratio_noise_floor(spark, d):
    """Why two arms cannot be ruled on (2.2.14)."""
    rows = view(spark, d, "oplog").selectExpr("key AS gate", "CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS arm", "20 + value AS value")
    return stats.noise_floor(rows, spread_max=4.0, min_reps=3, floor=30.0)


@query(", p AS (SELECT op AS phase, key % 25 AS rep, max(value) FILTER (seq % 3 = 0) AS a, max(value) FILTER (seq % 3 = 1) AS b, max(value) FILTER (seq % 3 = 2) AS t, max(value) AS load FROM oplog WHERE value > 1 GROUP BY 1, 2) SELECT phase, count(*) AS reps, round(median(t / ((a + b) / 2)), 6) AS ratio, round(min(t / ((a + b) / 2)), 6) AS ratio_lo, round(max(t / ((a + b) / 2)), 6) AS ratio_hi, round(median(b / a), 6) AS noise, round(median(t - (a + b) / 2), 6) AS added, max(load) AS max_load, CASE WHEN max(load) <= 1000 AND abs(median(b / a) - 1) <= 0.05 THEN 'VALID' ELSE 'PROVISIONAL' END AS verdict FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL GROUP BY phase", "oplog")
def live_trial_summary(spark, d):
    """Ratios of the reps that all three arms have, and validity (2.4.14)."""
    rows = sql("SELECT op AS phase, key % 25 AS rep, CASE seq % 3 WHEN 0 THEN 'native_a' WHEN 1 THEN 'native_b' ELSE 'tested' END AS arm, value AS wall_s, value AS load FROM {o} WHERE value > 1", o=view(spark, d, "oplog"))
    out = stats.trial_summary(rows, 1000.0, 0.05)
    return out.select("phase", "reps", *[F.round(c, 6).alias(c) for c in ("ratio", "ratio_lo", "ratio_hi", "noise", "added")], "max_load", "verdict")


@query(", r AS (SELECT op AS arm, CASE WHEN seq % 9 > 0 THEN seq % 10 END AS plan, seq % 8 AS ok, seq % 3 AS not_ok, seq % 2 AS skip, seq % 5 AS todo, CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END AS bail_out, CASE WHEN seq % 20 = 0 THEN 1 ELSE 0 END AS rc, seq % 40 = 0 AS timed_out FROM oplog) SELECT arm, count(*) AS scripts, CAST(sum(plan) AS BIGINT) AS planned, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(not_ok) AS BIGINT) AS not_ok, CAST(sum(skip) AS BIGINT) AS skip, CAST(sum(todo) AS BIGINT) AS todo, CAST(sum(bail_out) AS BIGINT) AS bail_out, count(*) FILTER (rc <> 0) AS nonzero, count(*) FILTER (timed_out) AS timed_out, count(*) FILTER (plan IS NULL) AS no_plan, count(*) FILTER (plan <> ok + not_ok) AS short, count(*) FILTER (not_ok = 0 AND rc = 0 AND plan = ok) AS clean FROM r GROUP BY arm", "oplog")
def arm_totals(spark, d):
    """Conditional counters over test records (2.4.15)."""
    return stats.arm_totals(sql("SELECT op AS arm, CASE WHEN seq % 9 > 0 THEN seq % 10 END AS plan, seq % 8 AS ok, seq % 3 AS not_ok, seq % 2 AS skip, seq % 5 AS todo, CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END AS bail_out, CASE WHEN seq % 20 = 0 THEN 1 ELSE 0 END AS rc, seq % 40 = 0 AS timed_out FROM {o}", o=view(spark, d, "oplog")))


@query(" SELECT op, count(*) FILTER (value <= 50) AS n, count(*) FILTER (value > 50) AS skipped FROM oplog GROUP BY op", "oplog")
def op_counts(spark, d):
    """Operations by name, skipped ones apart (2.4.25)."""
    return stats.op_counts(view(spark, d, "oplog").selectExpr("op", "value > 50 AS skip"))


@query(" SELECT category AS arm, CAST(sum(size) FILTER (ino % 50 > 0) AS BIGINT) AS bytes, count(*) FILTER (ino % 50 > 0 AND size > 5000) AS over, bool_or(ino % 50 = 0) AS partial FROM files GROUP BY 1", "files")
def budget_report(spark, d):
    """Bytes by arm and cases over the budget (2.4.26)."""
    return stats.budget_report(view(spark, d, "files").selectExpr("category AS arm", "CASE WHEN ino % 50 > 0 THEN size END AS size"), 5000)


@query(" SELECT key % 4 AS workload, op AS metric, seq % 3 AS layout, median(value) FILTER (value <= 80) AS median, min(value) FILTER (value <= 80) AS lo, max(value) FILTER (value <= 80) AS hi, count(*) FILTER (value > 80) AS flagged FROM oplog GROUP BY 1, 2, 3", "oplog")
def load_filtered_summary(spark, d):
    """Medians of quiet rows; loaded ones are counted (2.4.27)."""
    return stats.load_filtered(view(spark, d, "oplog").selectExpr("key % 4 AS workload", "op AS metric", "seq % 3 AS layout", "value", "value AS load"), 80.0)


@query(", r AS (SELECT key AS run, op AS proc, count(*) AS n FROM oplog GROUP BY 1, 2) SELECT proc, median(n) AS median, count(*) AS runs FROM r WHERE run % 9 > 0 GROUP BY proc", "oplog")
def op_profile(spark, d):
    """Median count of each procedure over good runs (2.4.31)."""
    runs = sql("SELECT run, run % 9 > 0 AS ok, map_from_entries(collect_list(struct(op, n))) AS counts FROM (SELECT key AS run, op, count(*) AS n FROM {o} GROUP BY key, op) GROUP BY run", o=view(spark, d, "oplog"))
    return stats.procedure_profile(runs)


@query(", s AS (SELECT key, seq, sum(CAST(floor(value) AS BIGINT) % 10) OVER w AS idle, sum(CAST(floor(value) AS BIGINT) % 20) OVER w AS total FROM oplog WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, lag(idle) OVER (PARTITION BY key ORDER BY seq) AS i0, lag(total) OVER (PARTITION BY key ORDER BY seq) AS t0 FROM s) SELECT key, seq, round(100.0 * CAST(idle - i0 AS DOUBLE) / CAST(total - t0 AS DOUBLE), 6) AS idle_pct FROM l WHERE total > t0", "oplog")
def counter_deltas(spark, d):
    """Idle share between samples; an interval without ticks has no row (2.5.4)."""
    snaps = sql("SELECT key, seq, sum(CAST(floor(value) AS BIGINT) % 10) OVER w AS idle, sum(CAST(floor(value) AS BIGINT) % 20) OVER w AS total FROM {o} WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)", o=view(spark, d, "oplog"))
    return stats.idle_percents(snaps, "key", "seq").withColumn("idle_pct", F.round("idle_pct", 6))


CPU = ", b AS (SELECT ino AS pid, ino % 3 AS st, size AS ticks FROM files WHERE ino % 4 > 0), a AS (SELECT ino AS pid, ino % 3 + CASE WHEN ino % 5 = 0 THEN 1 ELSE 0 END AS st, size + ino % 100 AS ticks FROM files), c AS (SELECT a.pid, a.st AS starttime, round(100.0 * CAST(a.ticks - coalesce(b.ticks, 0) AS DOUBLE) / 500.0, 6) AS cpu FROM a LEFT JOIN b ON a.pid = b.pid AND a.st = b.st)"


def cpu(spark, d) -> DataFrame:
    f = view(spark, d, "files")
    before = sql("SELECT ino AS pid, ino % 3 AS starttime, size AS ticks FROM {f} WHERE ino % 4 > 0", f=f)
    after = sql("SELECT ino AS pid, ino % 3 + CASE WHEN ino % 5 = 0 THEN 1 ELSE 0 END AS starttime, size + ino % 100 AS ticks FROM {f}", f=f)
    return stats.cpu_deltas(before, after, 5.0, 100.0).withColumn("cpu", F.round("cpu", 6))


@query(CPU + " SELECT * FROM c", "files")
def snapshot_delta_join(spark, d):
    """CPU between two samples; a new process counts in full (2.3.23)."""
    return cpu(spark, d)


@query(CPU + " SELECT pid, cpu, round(sum(cpu) OVER (), 3) AS foreign_total FROM c WHERE pid % 7 > 0 ORDER BY cpu DESC, pid LIMIT 3", "files")
def foreign_cpu(spark, d):
    """The three largest foreign processes and the total (2.3.22, 2.6.4); the limit is the report."""
    own = view(spark, d, "files").where("ino % 7 = 0").selectExpr("ino AS pid")
    return stats.foreign_cpu(cpu(spark, d), own).withColumn("foreign_total", F.round("foreign_total", 3))


@query(", r AS (SELECT key, seq, CASE WHEN op = 'view' THEN 'native' ELSE op END AS side, value FROM oplog), x AS (SELECT *, last_value(CASE WHEN side = 'native' THEN seq END IGNORE NULLS) OVER w AS base_at, last_value(CASE WHEN side = 'native' THEN value END IGNORE NULLS) OVER w AS base_value FROM r WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, row_number() OVER (PARTITION BY key, base_at ORDER BY seq) AS nth FROM x WHERE side <> 'native' AND base_at IS NOT NULL) SELECT key, side, base_value, value, round(value / nullif(base_value, 0), 6) AS ratio FROM y WHERE nth = 1", "oplog")
def paired_asof_ratio(spark, d):
    """Each row with the base row before it, which is taken once (2.3.24, as-of)."""
    rows = sql("SELECT key, seq, CASE WHEN op = 'view' THEN 'native' ELSE op END AS side, value FROM {o}", o=view(spark, d, "oplog"))
    out = stats.paired_with_preceding(rows.withColumn("value", F.col("value")), "key", "seq", "native")
    return out.withColumn("ratio", F.round("ratio", 6))


@query(", s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS v FROM oplog), r AS (SELECT key AS id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS t0, min(CAST(floor(epoch(ts)) AS BIGINT)) + 1800 AS t1 FROM oplog GROUP BY key) SELECT id, min(v) AS lo, max(v) AS hi, count(v) AS n FROM r LEFT JOIN s ON t BETWEEN t0 - 5 AND t1 + 5 GROUP BY id", "oplog")
def interval_load_join(spark, d):
    """Samples within each run's padded interval, by time buckets (2.3.31)."""
    o = view(spark, d, "oplog")
    return stats.load_during(sql("SELECT key AS id, min(unix_seconds(ts)) AS t0, min(unix_seconds(ts)) + 1800 AS t1 FROM {o} GROUP BY key", o=o), sql("SELECT unix_seconds(ts) AS t, value AS v FROM {o}", o=o), 5)


@query(", p AS (SELECT op AS workload, key AS rep, max(value) FILTER (seq % 2 = 0) AS n, max(value) FILTER (seq % 2 = 1) AS t, max(value) AS load FROM oplog GROUP BY 1, 2) SELECT workload, round(median(t / n), 6) AS ratio, round(min(t / n), 6) AS lo, round(max(t / n), 6) AS hi, count(*) FILTER (load > 90) AS loaded FROM p WHERE n > 0 AND t IS NOT NULL GROUP BY workload", "oplog")
def rep_keyed_ratio(spark, d):
    """Ratio of the arms by workload and rep (2.3.32)."""
    rows = sql("SELECT op AS workload, key AS rep, CASE WHEN seq % 2 = 0 THEN 'native' ELSE 'tested' END AS arm, value, value AS load FROM {o}", o=view(spark, d, "oplog"))
    return stats.rep_ratios(rows, 90.0).select("workload", *[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")], "loaded")


@query(" SELECT key AS pid, count(*) AS holds FROM oplog GROUP BY key HAVING bool_or(op <> 'error') AND NOT bool_or(op = 'error')", "oplog")
def unseen_holds(spark, d):
    """Processes with a hold that is no working directory and none that is (2.4.30)."""
    return stats.only_unseen_holds(sql("SELECT key AS pid, CASE WHEN op = 'error' THEN 'cwd' ELSE 'fd' END AS kind FROM {o}", o=view(spark, d, "oplog")))


@query(" SELECT op AS name, count(*) FILTER (value > 50) AS closed, count(*) AS total FROM oplog GROUP BY op", "oplog")
def plan_completion(spark, d):
    """Closed items of nested phases (2.4.19)."""
    return stats.completion(sql("SELECT op AS name, collect_list(struct(value > 50 AS closed)) AS items FROM {o} GROUP BY op", o=view(spark, d, "oplog")))


U = "(CAST('0x' || substr(md5('1:' || '{side}' || ':' || s || ':' || id || ':' || rep), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
NOISE = "sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"
NOISE_SQL = (
    "WITH r AS (SELECT id, s, rep, [0.01, 0.1, 0.3][s + 1] AS sigma FROM range(2000) t(id), range(3) x(s), range(1, 6) y(rep)), n AS (SELECT sigma, id, 23.0 * exp(sigma * "
    + NOISE.format(u=U.format(side="au"), v=U.format(side="av")) + ") AS a, 23.5 * exp(sigma * " + NOISE.format(u=U.format(side="bu"), v=U.format(side="bv"))
    + ") AS b FROM r), e AS (SELECT sigma, id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM n GROUP BY ALL)"
    " SELECT CAST(sigma AS DOUBLE) AS sigma, count(*) FILTER (hb <= 2.0 * la) / 2000 AS pass, count(*) FILTER (hb > 2.0 * la AND lb > 2.0 * ha) / 2000 AS fail, count(*) FILTER (hb > 2.0 * la AND lb <= 2.0 * ha) / 2000 AS undecided FROM e GROUP BY sigma"
)


@query(NOISE_SQL)
def noise_simulation(spark, d):
    """Verdict shares under simulated noise (2.4.24); it makes its own rows."""
    return stats.noise_simulation(spark, [0.01, 0.1, 0.3], 2000)


# ---- graphs

EDGES = ", edges AS (SELECT id AS parent, id * 2 AS child FROM blocks WHERE id * 2 <= (SELECT max(id) FROM blocks) UNION ALL SELECT id, id * 3 FROM blocks WHERE id * 3 <= (SELECT max(id) FROM blocks))"


def edges(spark, d) -> DataFrame:
    b = view(spark, d, "blocks")
    return sql("SELECT id AS parent, id * 2 AS child FROM {b} WHERE id * 2 <= (SELECT max(id) FROM {b}) UNION ALL SELECT id, id * 3 FROM {b} WHERE id * 3 <= (SELECT max(id) FROM {b})", b=b)


@query(EDGES + ", walk(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT child, depth + 1 FROM walk JOIN edges ON parent = id) SELECT id, min(depth) AS depth FROM walk GROUP BY id", "blocks")
def reachability(spark, d):
    """Nodes that a root reaches, shared subtrees once (2.8.1)."""
    return graph.reachable(edges(spark, d), sql("SELECT DISTINCT 1L AS id FROM {b} LIMIT 1", b=view(spark, d, "blocks")))


@query(EDGES + ", walk(root, id) AS (SELECT id, id FROM blocks WHERE id IN (1, 5, 7) UNION SELECT root, child FROM walk JOIN edges ON parent = id) SELECT root, count(*) AS marked FROM walk GROUP BY root", "blocks")
def incremental_marks(spark, d):
    """Mark sets: known roots reused, new ones walked, gone ones dropped (2.8.2)."""
    e = edges(spark, d)
    roots = view(spark, d, "blocks").where("id IN (1, 5, 7)").select("id")
    none = roots.limit(0).selectExpr("id AS root", "id")
    before = graph.mark(e, view(spark, d, "blocks").where("id IN (1, 9)").select("id"), none)
    return graph.mark(e, roots, before).groupBy("root").agg(F.count("*").alias("marked"))


@query(EDGES + " SELECT child, count(*) AS refs FROM edges GROUP BY child", "blocks")
def reference_counts(spark, d):
    """In-degree of each node (2.8.3)."""
    return graph.in_degree(edges(spark, d))


@query(", up(pid, depth) AS (SELECT CAST(197 AS BIGINT), 0 UNION ALL SELECT pid // 2, depth + 1 FROM up WHERE pid > 1) SELECT pid, min(depth) AS depth FROM up GROUP BY pid", "blocks")
def process_ancestry(spark, d):
    """A process and its ancestors (2.8.4)."""
    return graph.ancestry(sql("SELECT id AS pid, CASE WHEN id > 1 THEN id DIV 2 END AS ppid FROM {b}", b=view(spark, d, "blocks")), 197)


@query(" SELECT id FROM blocks WHERE id % 3 > 0 ORDER BY id LIMIT 256", "blocks")
def reap_batch(spark, d):
    """The next bounded batch to free (2.8.5); the limit is the step."""
    b = view(spark, d, "blocks").select("id")
    return graph.reap(b, b.where("id % 3 = 0"), 256)


@query(EDGES + ", walk(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT child, depth + 1 FROM walk JOIN edges ON parent = id WHERE depth < 3) SELECT id, min(depth) AS depth, id IN (SELECT parent FROM edges) AS resolved FROM walk GROUP BY id", "blocks")
def include_closure(spark, d):
    """Closure to a fixed depth (2.8.6)."""
    return graph.bounded_closure(edges(spark, d), view(spark, d, "blocks").where("id = 1").select("id"), 3)


@query(EDGES + ", freed(id) AS (SELECT unnest([2, 3]) UNION SELECT child FROM freed JOIN edges ON parent = id), g AS (SELECT DISTINCT id FROM freed) SELECT child AS id, CAST(count(*) - CASE WHEN child = 30 THEN 1 ELSE 0 END AS BIGINT) AS refs FROM edges WHERE child NOT IN (SELECT id FROM g) GROUP BY child", "blocks")
def refcount_settle(spark, d):
    """Counts after net deltas (2.4.21): the only references to 2 and 3 go, and with them level by level all that hangs on these alone; 30 loses one of two."""
    e = edges(spark, d)
    deltas = spark.createDataFrame([(2, -2), (2, 1), (3, -1), (30, -1)], "id long, delta long")
    return graph.settle(graph.in_degree(e).select(F.col("child").alias("id"), "refs"), deltas, e).select("id", "refs")


NODES = ", n AS (SELECT 'r' AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, 'root' AS name, CAST(NULL AS VARCHAR) AS content UNION ALL SELECT 'r' || r_regionkey, 'r', 1, r_name, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, c_name, c_mktsegment FROM customer), h3 AS (SELECT *, sha256('f' || content) AS hash, 1 AS files, length(content) AS bytes FROM n WHERE depth = 3), h2 AS (SELECT n.id, n.parent, n.name, coalesce((SELECT sha256('d' || string_agg('f' || octet_length(encode(c.name)) || ':' || c.name || c.hash, '' ORDER BY 'f' || octet_length(encode(c.name)) || ':' || c.name || c.hash)) FROM h3 c WHERE c.parent = n.id), sha256('d')) AS hash, (SELECT coalesce(sum(files), 0) FROM h3 c WHERE c.parent = n.id) AS files, (SELECT coalesce(sum(bytes), 0) FROM h3 c WHERE c.parent = n.id) AS bytes FROM n WHERE depth = 2), h1 AS (SELECT n.id, n.parent, n.name, coalesce((SELECT sha256('d' || string_agg('d' || octet_length(encode(c.name)) || ':' || c.name || c.hash, '' ORDER BY 'd' || octet_length(encode(c.name)) || ':' || c.name || c.hash)) FROM h2 c WHERE c.parent = n.id), sha256('d')) AS hash, (SELECT coalesce(sum(files), 0) FROM h2 c WHERE c.parent = n.id) AS files, (SELECT coalesce(sum(bytes), 0) FROM h2 c WHERE c.parent = n.id) AS bytes FROM n WHERE depth = 1)"


@query("WITH RECURSIVE x AS (SELECT 1)" + NODES + " SELECT 'r' AS id, 'root' AS name, (SELECT sha256('d' || string_agg('d' || octet_length(encode(name)) || ':' || name || hash, '' ORDER BY 'd' || octet_length(encode(name)) || ':' || name || hash)) FROM h1) AS hash, CAST((SELECT sum(files) FROM h1) AS BIGINT) AS files, CAST((SELECT sum(bytes) FROM h1) AS BIGINT) AS bytes")
def merkle_rollup(spark, d):
    """Tree hash, files and bytes, one aggregation a level (2.4.20, 2.9.3)."""
    nodes = sql(
        """SELECT 'r' AS id, CAST(NULL AS STRING) AS parent, 0 AS depth, 'root' AS name, CAST(NULL AS STRING) AS content, 0L AS size
           UNION ALL SELECT concat('r', r_regionkey), 'r', 1, r_name, NULL, 0L FROM {r} UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 2, n_name, NULL, 0L FROM {n}
           UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 3, c_name, c_mktsegment, CAST(length(c_mktsegment) AS BIGINT) FROM {c}""",
        r=table(spark, d, "region"),
        n=table(spark, d, "nation"),
        c=table(spark, d, "customer"),
    )
    return graph.merkle(nodes, 3)


OWNER = ", dirs AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, 'host' AS owner FROM paths UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/en', 'english' FROM paths)"


@query(OWNER + " SELECT id, path, (SELECT arg_max(owner, length(dir)) FROM dirs WHERE starts_with(path, dir || '/')) AS owner FROM paths", "paths")
def longest_prefix_owner(spark, d):
    """Owner of each path by its longest directory prefix, joined by equality (2.3.13, 2.3.12)."""
    p = view(spark, d, "paths")
    dirs = sql("SELECT DISTINCT split_part(path, '/', 1) AS dir, 'host' AS owner FROM {p} UNION ALL SELECT DISTINCT concat(split_part(path, '/', 1), '/en'), 'english' FROM {p}", p=p)
    return graph.owners(p, dirs)


@query(EDGES + ", walk(id) AS (SELECT CAST(64 AS BIGINT) UNION SELECT parent FROM walk JOIN edges ON child = id) SELECT id AS name FROM walk", "blocks")
def reverse_closure(spark, d):
    """What depends on a change, transitively (2.3.13)."""
    e = edges(spark, d)
    return graph.dependents(view(spark, d, "blocks").where("id = 64").selectExpr("id AS name"), e.selectExpr("parent AS name", "child AS on"))


# ---- namespace


@query(" SELECT dir, cookie, name, ended FROM (SELECT *, row_number() OVER (ORDER BY cookie) AS place, count(*) OVER () <= 3 AS ended FROM (SELECT * FROM dirents WHERE dir = 1 AND cookie > 1 ORDER BY cookie LIMIT 4)) WHERE place <= 3", "dirents")
def readdir_page(spark, d):
    """A keyset page (2.6.1); the limit is the page."""
    return namespace.page(view(spark, d, "dirents"), 1, 1, 3)


ENTRIES = ", entries AS (SELECT *, dir * 100 + cookie AS child FROM dirents), inodes2 AS (SELECT child AS ino, kind, cookie % 512 AS mode, CAST(1 AS BIGINT) AS nlink FROM entries WHERE child % 5 > 0)"


def entries(spark, d) -> tuple[DataFrame, DataFrame]:
    e = view(spark, d, "dirents").withColumn("child", F.col("dir") * 100 + F.col("cookie"))
    return e, e.where("child % 5 > 0").selectExpr("child AS ino", "kind", "cookie % 512 AS mode", "1L AS nlink")


@query(ENTRIES + ", r AS (SELECT dir, CASE WHEN dir % 4 = 0 THEN 'nothing' ELSE name END AS name FROM entries WHERE cookie = 2) SELECT r.dir, r.name, child, i.kind, CASE WHEN i.ino IS NULL THEN 'NotFound' END AS error FROM r LEFT JOIN entries e ON r.dir = e.dir AND r.name = e.name LEFT JOIN inodes2 i ON i.ino = child", "dirents")
def lookup_join(spark, d):
    """Entries joined to inodes (2.3.1, 2.2.1)."""
    e, i = entries(spark, d)
    return namespace.lookup(e, i, e.where("cookie = 2").selectExpr("dir", "CASE WHEN dir % 4 = 0 THEN 'nothing' ELSE name END AS name"))


@query(ENTRIES + ", p AS (SELECT * FROM entries WHERE dir = 1 AND cookie > 0 ORDER BY cookie LIMIT 4) SELECT p.dir, p.cookie, p.name, i.kind, i.mode FROM p JOIN inodes2 i ON i.ino = p.child", "dirents")
def readdir_attributes(spark, d):
    """A page with attributes; gone inodes are skipped (2.3.2)."""
    e, i = entries(spark, d)
    return namespace.page_with_attributes(e, i, 1, 0, 4).select("dir", "cookie", "name", "kind", "mode")


@query(" SELECT CAST(ceil(sum(size) / 4096.0) AS BIGINT) AS used, CAST(greatest(262144 - ceil(sum(size) / 4096.0), 0) AS BIGINT) AS free FROM files", "files")
def statfs(spark, d):
    """Blocks used and free (2.2.3)."""
    return namespace.space(view(spark, d, "files").agg(F.sum("size").alias("bytes")), 1 << 30, 4096)


@query(ENTRIES + " SELECT dir, count(*) AS names, CAST(sum(cookie) AS BIGINT) AS cookies FROM (SELECT dir, cookie FROM entries UNION ALL SELECT dir, max(cookie) + 1 FROM entries GROUP BY dir) GROUP BY dir", "dirents")
def create_entries(spark, d):
    """A new file in each directory (2.10.1)."""
    e, i = entries(spark, d)
    i = i.selectExpr("*", "0L AS size", "CAST(NULL AS STRING) AS target", "0L AS parent")
    made, _, _ = namespace.create(e, i, e.select("dir").distinct().selectExpr("dir", "'new' AS name", "'f' AS kind", "420L AS mode", "CAST(NULL AS STRING) AS target"))
    return made.groupBy("dir").agg(F.count("*").alias("names"), F.sum("cookie").alias("cookies"))


@query(ENTRIES + " SELECT child AS ino, CAST(1 + (child % 3 = 0)::INT AS BIGINT) AS nlink FROM entries WHERE child % 5 > 0", "dirents")
def link_inodes(spark, d):
    """A second name for some inodes (2.10.2)."""
    e, i = entries(spark, d)
    _, linked = namespace.link(e, i, e.where("child % 3 = 0").selectExpr("dir", "concat(name, '.2') AS name", "child"))
    return linked.select("ino", "nlink")


@query(ENTRIES + " SELECT dir, count(*) AS names FROM entries WHERE cookie <> 1 GROUP BY dir", "dirents")
def unlink_entries(spark, d):
    """Names removed, their inodes with them (2.10.3)."""
    e, i = entries(spark, d)
    left, _ = namespace.unlink(e, i, e.where("cookie = 1").select("dir", "name"))
    return left.groupBy("dir").agg(F.count("*").alias("names"))


@query(ENTRIES + " SELECT ino, CASE WHEN ino % 3 = 0 THEN 7 ELSE mode END AS mode FROM inodes2", "dirents")
def setattr_inodes(spark, d):
    """Column updates where null keeps (2.10.6)."""
    _, i = entries(spark, d)
    return namespace.setattr_of(i, i.selectExpr("ino", "CASE WHEN ino % 3 = 0 THEN 7L END AS mode")).select("ino", "mode")


@query(" SELECT id AS ino, 'user.b' AS name, CASE WHEN id % 2 = 0 THEN 'new' ELSE codec END AS value FROM blocks WHERE id % 3 > 0 OR id % 2 = 0", "blocks")
def upsert_xattrs(spark, d):
    """Extended attributes set and removed (2.10.9)."""
    b = view(spark, d, "blocks")
    now = b.selectExpr("id AS ino", "'user.b' AS name", "codec AS value")
    return namespace.upsert_attributes(now, b.where("id % 2 = 0 OR id % 3 = 0").selectExpr("id AS ino", "'user.b' AS name", "CASE WHEN id % 2 = 0 THEN 'new' END AS value"))


# ---- functions

PATHS = "CASE id % 6 WHEN 0 THEN 'a/target/node_modules/x.o' WHEN 1 THEN 'a/node_modules/target/.git/x' WHEN 2 THEN '.git/objects/x' WHEN 3 THEN 'build/p/out/libx.rlib' WHEN 4 THEN 'x/incremental/s.rmeta' ELSE path END"


@query(f", p AS (SELECT id, {PATHS} AS path FROM paths) SELECT id, CASE id % 6 WHEN 0 THEN 'target' WHEN 1 THEN 'node_modules' WHEN 2 THEN '.git' ELSE 'source' END AS corpus, CASE id % 6 WHEN 0 THEN 'node_modules' WHEN 1 THEN '.git' WHEN 2 THEN '.git' ELSE 'other' END AS trial, CASE id % 6 WHEN 0 THEN 'o' WHEN 3 THEN 'build-out' WHEN 4 THEN 'incremental' ELSE CASE WHEN starts_with(string_split(path, '/')[-1], '.') THEN 'misc' ELSE 'binary-or-other' END END AS artifact FROM p", "paths")
def path_categories(spark, d):
    """The two path classifiers and the artifact kinds (2.2.4, 2.2.5, 2.2.17)."""
    p = view(spark, d, "paths").withColumn("path", F.expr(PATHS))
    return p.select("id", paths.corpus_category(F.col("path")).alias("corpus"), paths.trial_category(F.col("path")).alias("trial"), paths.artifact_kind(F.col("path")).alias("artifact"))


NAMES = "CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN '.x' WHEN 2 THEN 'a/b' WHEN 3 THEN repeat('n', 250) WHEN 4 THEN repeat('n', 300) WHEN 5 THEN concat('a', chr(7)) WHEN 6 THEN 'a.swap~' ELSE name END"


@query(" SELECT id, CASE id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'leading dot' WHEN 2 THEN 'slash' WHEN 4 THEN 'too long' WHEN 5 THEN 'control' WHEN 6 THEN 'reserved' END AS snapshot, CASE id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'leading dot' WHEN 2 THEN 'slash' WHEN 3 THEN 'base too long' WHEN 4 THEN 'too long' WHEN 5 THEN 'control' WHEN 6 THEN 'reserved' END AS base, CASE id % 8 WHEN 0 THEN 'bad name' WHEN 2 THEN 'bad name' WHEN 4 THEN 'too long' END AS entry FROM packs", "packs")
def name_rules(spark, d):
    """The first rule that a name breaks (2.2.7, 2.2.8, 2.2.9)."""
    p = view(spark, d, "packs").withColumn("name", F.expr(NAMES))
    return p.select("id", paths.snapshot_name_fault(F.col("name")).alias("snapshot"), paths.base_name_fault(F.col("name")).alias("base"), paths.entry_name_fault(F.col("name")).alias("entry"))


@query(", n AS (SELECT CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name FROM (SELECT id, name FROM packs UNION ALL SELECT id, 'Supplier' || id % 20 FROM packs)) SELECT lower(name) AS key, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1", "packs")
def name_collisions(spark, d):
    """Names that collide under their key (2.7.5)."""
    n = sql("SELECT CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name FROM (SELECT id, name FROM {p} UNION ALL SELECT id, concat('Supplier', id % 20) FROM {p})", p=view(spark, d, "packs"))
    return n.groupBy(paths.name_key(F.col("name")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query(" SELECT id, CASE id % 4 WHEN 0 THEN 'harness' WHEN 1 THEN 'inherent_fuse' WHEN 2 THEN 'missing_feature' ELSE 'unclassified' END AS class, CASE id % 4 WHEN 2 THEN 'the case reports the feature unsupported' WHEN 0 THEN 'a command was missing' ELSE '' END AS skips, substr(sha256(codec), 1, 6) AS short_id, CASE WHEN id % 2 = 0 THEN 'x-base' ELSE 'repo-base' END AS base FROM blocks", "blocks")
def reason_classes(spark, d):
    """Ordered pattern classes, log signatures, short ids and base names (2.2.6, 2.2.18, 2.9.13, 2.9.15)."""
    b = sql("SELECT *, CASE id % 4 WHEN 0 THEN 'foo: command not found' WHEN 1 THEN 'needs a block size' WHEN 2 THEN 'O_TMPFILE not supported' ELSE 'other' END AS text, CASE WHEN id % 2 = 0 THEN '/a/x//' ELSE '//' END AS repo FROM {b}", b=view(spark, d, "blocks"))
    return b.select("id", paths.reason_class(F.col("text")).alias("class"), F.array_join(paths.skip_signatures(F.col("text")), ";").alias("skips"), paths.short_id(F.col("codec")).alias("short_id"), paths.base_name(F.col("repo")).alias("base"))


DETAILS = "CASE id % 4 WHEN 0 THEN 'tried ''-u 65534 open f 0644'', expected 0, got EPERM' WHEN 1 THEN 'tried ''0644 mkdir d'', expected EEXIST' WHEN 2 THEN 'nothing' ELSE 'tried ''-x'', got 0 ' END"


@query(" SELECT id, CASE id % 4 WHEN 0 THEN '-u 65534 open f 0644' WHEN 1 THEN '0644 mkdir d' WHEN 3 THEN '-x' END AS op, CASE id % 4 WHEN 0 THEN 'EPERM' WHEN 1 THEN '(empty)' WHEN 2 THEN '(textless)' ELSE '0' END AS outcome, CASE id % 4 WHEN 0 THEN '65534' WHEN 1 THEN 'mkdir' WHEN 2 THEN '(textless)' ELSE '(no syscall)' END AS call, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 17 WHEN 2 THEN 39 ELSE 22 END AS errno FROM blocks", "blocks")
def assertion_texts(spark, d):
    """Operation keys, outcomes, first calls, error numbers (2.9.9 to 2.9.12, 2.9.14)."""
    b = view(spark, d, "blocks").withColumn("t", F.expr(DETAILS.replace("''", "\\'")))
    error = F.expr("CASE id % 4 WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Exists' WHEN 2 THEN 'NotEmpty' ELSE 'InvalidArgument' END")
    return b.select("id", scalars.operation_key(F.col("t")).alias("op"), scalars.outcome_text(F.col("t")).alias("outcome"), scalars.first_call(F.col("t")).alias("call"), scalars.errno(error).alias("errno"))


@query(" SELECT ino, kind IN ('F', 'P') AS special, kind = 'F' AS device, kind = 'F' AND ino % 2 = 1 AS root FROM inodes", "inodes")
def kind_predicates(spark, d):
    """Special and device kinds, and who may make them (2.2.12, 2.2.13)."""
    i = sql("SELECT ino, CASE kind WHEN 'F' THEN 'char' WHEN 'P' THEN 'fifo' ELSE 'file' END AS kind FROM {i}", i=view(spark, d, "inodes"))
    return i.select("ino", scalars.is_special(F.col("kind")).alias("special"), scalars.is_device(F.col("kind")).alias("device"), scalars.needs_root(F.col("kind"), F.col("ino") % 2).alias("root"))


# ---- sources and logs


@query(" SELECT id, path FROM paths WHERE path >= 'm' AND starts_with(path, 'm.') ORDER BY path, id LIMIT 20", "paths")
def prefix_scan(spark, d):
    """Keys from a start that share a prefix (2.1.14, 2.1.13); the limit is the operator's."""
    return logs.prefix_scan(view(spark, d, "paths"), "path", "m", "m.", 10_000).orderBy("path", "id").limit(20)


@query(" SELECT id, name, pool FROM snapshots WHERE id = 7", "snapshots")
def point_get(spark, d):
    """One key's row (2.1.15, 2.1.17)."""
    return logs.point_get(view(spark, d, "snapshots"), "id", 7)


WALK = ", e AS (SELECT slot, category || '/' || CASE ino % 4 WHEN 0 THEN 'target/x' WHEN 1 THEN '.git/y' ELSE 'z' END || '/' || ino AS path, CASE ino % 10 WHEN 0 THEN 'symlink' WHEN 1 THEN 'fifo' ELSE 'file' END AS kind, size, 1 AS dev, CASE WHEN ino % 7 = 0 THEN ino // 70 ELSE ino + 1000000 END AS ino, CASE WHEN ino % 7 = 0 THEN 2 ELSE 1 END AS nlink FROM files), k AS (SELECT * FROM (SELECT *, CASE WHEN nlink > 1 THEN row_number() OVER (PARTITION BY dev, ino ORDER BY slot, path) ELSE 1 END AS nth FROM e WHERE kind = 'file') WHERE nth = 1)"


def walked(spark, d) -> DataFrame:
    return sql("SELECT slot, concat(category, '/', CASE ino % 4 WHEN 0 THEN 'target/x' WHEN 1 THEN '.git/y' ELSE 'z' END, '/', ino) AS path, CASE ino % 10 WHEN 0 THEN 'symlink' WHEN 1 THEN 'fifo' ELSE 'file' END AS kind, size, 1 AS dev, CASE WHEN ino % 7 = 0 THEN ino DIV 70 ELSE ino + 1000000 END AS ino, CASE WHEN ino % 7 = 0 THEN 2 ELSE 1 END AS nlink, CASE WHEN ino % 90 = 3 THEN 'EACCES' END AS error FROM {f}", f=view(spark, d, "files"))


@query(WALK + " SELECT e.slot, count(*) FILTER (kind = 'symlink') AS symlinks, count(*) FILTER (kind = 'fifo') AS special, coalesce(any_value(f.files), 0) AS files, CAST(coalesce(any_value(f.bytes), 0) AS BIGINT) AS bytes, coalesce(any_value(f.t), 0) AS n_target, CAST(0 AS BIGINT) AS n_node_modules, coalesce(any_value(f.g), 0) AS n_git, coalesce(any_value(f.files - f.t - f.g), 0) AS n_source, count(*) FILTER (kind = 'file') - coalesce(any_value(f.files), 0) AS hardlink_dupes FROM e LEFT JOIN (SELECT slot, count(*) AS files, sum(size) AS bytes, count(*) FILTER (path LIKE '%/target/%') AS t, count(*) FILTER (path LIKE '%/.git/%') AS g FROM k GROUP BY slot) f ON e.slot = f.slot GROUP BY e.slot", "files")
def slot_walk(spark, d):
    """Files of each slot, every inode once, by category (2.1.1)."""
    return walk.slot_walk(walked(spark, d))


@query(WALK.replace("FROM files), k", "FROM files WHERE ino % 90 <> 3), k").replace("ORDER BY slot, path", "ORDER BY path") + " SELECT CASE WHEN path LIKE '%/.git/%' THEN '.git' WHEN path LIKE '%/target/%' THEN 'target' ELSE 'other' END AS class, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY 1 UNION ALL SELECT 'error:EACCES', count(*), 0 FROM files WHERE ino % 90 = 3", "files")
def walk_classes(spark, d):
    """Files and bytes by class, errors apart (2.1.3)."""
    return walk.classes(walked(spark, d))


@query(WALK + " SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM e WHERE kind = 'file'", "files")
def size_walk(spark, d):
    """Bytes and number of files to a depth (2.1.4)."""
    return walk.sizes(walked(spark, d))


@query(", l AS (SELECT key AS id, string_agg('k' || seq % 3 || '=' || op, chr(10) ORDER BY seq) AS text FROM oplog GROUP BY key) SELECT key AS id, 'k' || seq % 3 AS key, arg_max(op, seq) AS value, count(*) AS n FROM oplog GROUP BY 1, 2", "oplog")
def key_values(spark, d):
    """key=value lines, the last wins, repeats counted (2.1.32)."""
    return parsers.key_values(sql("SELECT key AS id, array_join(transform(array_sort(collect_list(struct(seq, op))), x -> concat('k', x.seq % 3, '=', x.op)), '\n') AS text FROM {o} GROUP BY key", o=view(spark, d, "oplog")))


@query(" SELECT key AS id, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS INTEGER) AS pos, op, value > 50 AS skip FROM oplog", "oplog")
def operation_stream(spark, d):
    """Recorded operations with exact positions (2.1.29)."""
    return parsers.operations(sql("SELECT key AS id, array_join(transform(array_sort(collect_list(struct(seq, op, value))), x -> concat(CASE WHEN x.value > 50 THEN 'skip ' ELSE '' END, x.op, ' ', x.seq)), '\n') AS text FROM {o} GROUP BY key", o=view(spark, d, "oplog")))


# ---- streams, over a batch


@query(" SELECT key, op, arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS writes FROM oplog GROUP BY key, op", "oplog")
def coalesce_last_write(spark, d):
    """The last write of each key and kind (2.11.2)."""
    return streams.coalesced(view(spark, d, "oplog"))


@query(", g AS (SELECT key FROM oplog GROUP BY key HAVING min(seq) FILTER (op = 'signup') = min(seq) AND max(seq) FILTER (op = 'error') = max(seq)) SELECT key, seq, op FROM oplog WHERE key NOT IN (SELECT key FROM g)", "oplog")
def elide_create_unlink(spark, d):
    """Keys created and removed in one batch leave nothing (2.11.3)."""
    return streams.elided(view(spark, d, "oplog"), "signup", "error").select("key", "seq", "op")


#: Step by step over each key's requests: the entry that a request meets is that of the last one not answered from it.
REPLAYS = ", o AS (SELECT key, op, seq, epoch_us(ts) AS stamp, row_number() OVER (PARTITION BY key, op ORDER BY ts, seq) AS n FROM oplog), walk AS (SELECT key, op, n, stamp AS made, 'new' AS state FROM o WHERE n = 1 UNION ALL SELECT o.key, o.op, o.n, CASE WHEN o.stamp >= w.made + 86400000000 THEN o.stamp ELSE w.made END, CASE WHEN o.stamp >= w.made + 86400000000 THEN 'new' ELSE 'replay' END FROM walk w JOIN o ON o.key = w.key AND o.op = w.op AND o.n = w.n + 1)"


@query(REPLAYS + " SELECT o.key, o.op, o.seq, w.state FROM o JOIN walk w ON o.key = w.key AND o.op = w.op AND o.n = w.n", "oplog")
def replay_dedup(spark, d):
    """Requests as new or replayed; an entry ages from the request that made it (2.11.6, 2.11.7)."""
    return streams.replayed(view(spark, d, "oplog"), 86400).drop("ts")


#: Step by step over each queue's operations: the commit of each (batch), that of the next (number) and what waits after it.
COMMITS = ", o AS (SELECT key, seq, epoch_us(ts) AS t, seq % 10 AS size, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS i FROM oplog), walk AS (SELECT key, seq, i, CAST(0 AS BIGINT) AS batch, CAST(CASE WHEN size > 25 THEN 1 ELSE 0 END AS BIGINT) AS number, CAST(CASE WHEN size > 25 THEN 0 ELSE 1 END AS BIGINT) AS n, CAST(CASE WHEN size > 25 THEN 0 ELSE size END AS BIGINT) AS held, t AS oldest, t AS last FROM o WHERE i = 1 UNION ALL SELECT key, seq, i, batch, batch + CASE WHEN held > 25 THEN 1 ELSE 0 END, CASE WHEN held > 25 THEN 0 ELSE n END, CASE WHEN held > 25 THEN 0 ELSE held END, oldest, last FROM (SELECT key, seq, i, number + CASE WHEN due THEN 1 ELSE 0 END AS batch, CASE WHEN due THEN 1 ELSE n + 1 END AS n, CASE WHEN due THEN size ELSE held + size END AS held, CASE WHEN due OR n = 0 THEN t ELSE oldest END AS oldest, t AS last FROM (SELECT o.key, o.seq, o.i, o.t, o.size, w.number, w.n, w.held, w.oldest, w.n > 0 AND (CASE WHEN w.n >= 4 THEN w.last ELSE w.oldest + 43200000000 END + 21599999999) // 21600000000 * 21600000000 <= o.t AS due FROM walk w JOIN o ON o.key = w.key AND o.i = w.i + 1)))"


@query(COMMITS + " SELECT key, seq, batch FROM walk", "oplog")
def flush_batches(spark, d):
    """The commit that takes each operation: by age, number or bytes (2.11.1, 2.11.5)."""
    return streams.commit_batches(view(spark, d, "oplog").withColumn("size", F.expr("seq % 10")), 21_600_000, 43_200_000, 4, 25)


@query()
def reply_states(spark, d):
    """Calls as new, under way or replayed, in a cache bounded by age, number and bytes (2.11.6, 2.11.7)."""
    calls = sql("SELECT key % 20 AS client, key AS conn, CAST(floor(value) AS BIGINT) AS xid, op AS print, ts, seq FROM {o}", o=view(spark, d, "oplog"))
    both = sql(
        """SELECT client, conn, xid, print, 'call' AS kind, CAST(NULL AS BIGINT) AS size, ts, seq * 2 AS seq FROM {c}
           UNION ALL SELECT client, conn, xid, print, 'reply', CASE WHEN print <> 'error' THEN 100 + seq % 50 END, ts + INTERVAL 1 HOUR, seq * 2 + 1 FROM {c}""",
        c=calls,
    )
    return streams.reply_cache(both, 10 * 86400, 64, 8192).select((F.col("seq") / 2).cast("long").alias("seq"), "state")


@query(" SELECT id, CASE WHEN id % 3 = 0 THEN 'got <name>, expected 0' WHEN id % 3 = 1 THEN 'open <name>/<name> 0644' ELSE 'no name' END AS text FROM blocks", "blocks")
def normalised_texts(spark, d):
    """Assertion texts without the names made for one run (2.9.10)."""
    text = "CASE WHEN id % 3 = 0 THEN concat(' got pjdfstest_', substr(sha2(CAST(id AS STRING), 256), 1, 12), ', expected 0') WHEN id % 3 = 1 THEN concat('open pjdfstest_', sha2(CAST(id AS STRING), 256), '/pjdfstest_0123456 0644 ') ELSE 'no name' END"
    return view(spark, d, "blocks").select("id", scalars.normalised_text(F.expr(text)).alias("text"))


@query(" SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM oplog GROUP BY 1", "oplog")
def sample_windows(spark, d):
    """Tumbling windows of samples (2.11.11)."""
    out = streams.sampled(view(spark, d, "oplog"), 3600)
    return out.select(F.unix_seconds("start").alias("start"), "n", F.round("mean", 6).alias("mean"), "lo", "hi")


@query(", w AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 21600 AS w, value FROM oplog), b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM w WHERE w < (SELECT min(w) FROM w) + 4), l AS (SELECT max(value) AS lim FROM b WHERE i = least(n - 1, (95 * n) // 100)) SELECT w * 21600 AS start, count(*) AS n, max(value) AS hi, max(value) <= 1.5 * (SELECT lim FROM l) AS quiet FROM w WHERE w >= (SELECT min(w) FROM w) + 4 GROUP BY w", "oplog")
def quiet_gate(spark, d):
    """Windows against the p95 of the first ones (2.11.12)."""
    return streams.quiet_windows(view(spark, d, "oplog"), 21600, 4, 1.5)


@query(", s AS (SELECT *, (epoch_ms(ts) - epoch_ms(min(ts) OVER (PARTITION BY key)) + 3599999) // 3600000 AS slot FROM oplog) SELECT key, arg_max(seq, (ts, seq)) AS seq FROM s GROUP BY key, slot", "oplog")
def progress_throttle(spark, d):
    """The first event, then at most one an interval (2.11.13)."""
    return streams.throttled(view(spark, d, "oplog"), 3_600_000).drop("ts")


@query(" SELECT seq, (max((key, seq)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING))[1] AS pack, (max((key, seq)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING))[2] AS len FROM oplog WHERE op = 'error'", "oplog")
def durable_watermark(spark, d):
    """The high-water mark, which never falls (2.11.9)."""
    return streams.watermark_of(view(spark, d, "oplog").where("op = 'error'").selectExpr("seq", "key AS pack", "seq AS len"))


@query(" SELECT f.key AS dir, f.op AS name, arg_max(CASE WHEN value > 50 THEN seq END, seq) AS target FROM oplog f WHERE CAST(floor(value) AS BIGINT) % 10 >= key % 4 GROUP BY 1, 2".replace("arg_max(CASE WHEN value > 50 THEN seq END, seq)", "(arg_max({'t': CASE WHEN value > 50 THEN seq END}, seq)).t"), "oplog")
def guarded_fills(spark, d):
    """Cache fills no older than their directory's epoch (2.11.8)."""
    o = view(spark, d, "oplog")
    fills = sql("SELECT key AS dir, op AS name, CASE WHEN value > 50 THEN seq END AS target, CAST(floor(value) AS BIGINT) % 10 AS epoch, seq FROM {o}", o=o)
    return streams.guarded_fills(fills, sql("SELECT DISTINCT key AS dir, key % 4 AS epoch FROM {o}", o=o))


# ---- checks of rows and texts

LINE = "CASE seq % 8 WHEN 0 THEN '{\"kind\":' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{\"kind\": \"meta\"}' WHEN 3 THEN '  ' WHEN 4 THEN '{\"kind\": \"other\"}' WHEN 5 THEN '{\"kind\": \"rep\", \"seconds\": -1}' ELSE '{\"kind\": \"rep\", \"seconds\": 2.5}' END"


@query(", m AS (SELECT key, min(seq) AS meta FROM oplog WHERE seq % 8 = 2 GROUP BY key), f AS (SELECT o.key AS file, seq AS n, unnest(CASE seq % 8 WHEN 0 THEN ['not JSON'] WHEN 1 THEN ['not a JSON object'] WHEN 2 THEN [CASE WHEN seq > meta THEN 'more than one meta record' END] WHEN 3 THEN [] WHEN 4 THEN ['unknown kind'] WHEN 5 THEN [CASE WHEN meta IS NULL OR seq < meta THEN 'rep before the meta record' END, 'seconds are not a positive number'] ELSE [CASE WHEN meta IS NULL OR seq < meta THEN 'rep before the meta record' END] END) AS fault FROM oplog o LEFT JOIN m ON o.key = m.key) SELECT * FROM f WHERE fault IS NOT NULL", "oplog")
def row_validity(spark, d):
    """Why lines of result files cannot be trusted (2.2.15)."""
    return compare.row_faults(view(spark, d, "oplog").select(F.col("key").alias("file"), F.col("seq").alias("n"), F.expr(LINE).alias("line")))


@query(" SELECT ino, CASE WHEN regexp_matches(content, '[0-9]{6}') THEN 'NEEDS_LONG' WHEN regexp_matches(content, '[Tt]he|und') OR regexp_matches(content, '!!') THEN 'NEEDS_ROOT' WHEN regexp_matches(content, '[#@]') THEN 'NEEDS_DEVICE' ELSE 'SAFE' END AS verdict, concat_ws(',', CASE WHEN regexp_matches(content, '[#@]') THEN 'mark' END, CASE WHEN regexp_matches(content, '[Tt]he|und') THEN 'word' END, CASE WHEN regexp_matches(content, '!!') THEN 'shout' END, CASE WHEN regexp_matches(content, '[0-9]{6}') THEN 'number' END) AS reasons FROM files", "files")
def case_safety(spark, d):
    """Ordered groups of patterns over texts: the last group with a hit names the verdict, all reasons are kept (2.2.16)."""
    groups = [("NEEDS_DEVICE", [("[#@]", "mark")]), ("NEEDS_ROOT", [("[Tt]he|und", "word"), ("!!", "shout")]), ("NEEDS_LONG", [("[0-9]{6}", "number")])]
    return compare.classified(view(spark, d, "files"), groups, text_col="content").select("ino", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query(" SELECT seq, CASE seq % 3 WHEN 0 THEN 'open <name> ' || op WHEN 1 THEN op || ' <name>/<name>' ELSE op || ' pjdfstest_12' END AS text FROM oplog", "oplog")
def normalised_texts(spark, d):
    """Texts without the names that a run makes up (2.9.10)."""
    made = "lower(hex(1048576 + seq))"
    text = F.expr(f"CASE seq % 3 WHEN 0 THEN concat('  open pjdfstest_', {made}, ' ', op) WHEN 1 THEN concat(op, ' pjdfstest_', {made}, '/pjdfstest_', {made}, ' ') ELSE concat(op, ' pjdfstest_12') END")
    return view(spark, d, "oplog").select("seq", scalars.normalised_text(text).alias("text"))

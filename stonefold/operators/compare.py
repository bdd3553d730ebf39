"""Comparisons of two arms, trees, manifests and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators.base import sql


def ordinal_rows(native: DataFrame, tested: DataFrame) -> DataFrame:
    """Assertions (test, n, ok) at one position of both arms that differ: worse if only native passes, else better."""
    return sql("SELECT a.test, a.n, CASE WHEN a.ok THEN 'worse' ELSE 'better' END AS label FROM {a} a JOIN {b} b ON a.test = b.test AND a.n = b.n WHERE a.ok <> b.ok", a=native, b=tested)


def pair_label(native: str = "a", tested: str = "b") -> str:
    """SQL of the label of two statuses."""
    return f"""CASE WHEN {native} = 'NO_RESULT' OR {tested} = 'NO_RESULT' THEN 'invalid'
      WHEN {native} = 'PASS' THEN CASE {tested} WHEN 'PASS' THEN 'both_pass' WHEN 'PASS_EMULATED' THEN 'emulated' WHEN 'NOT_RUN' THEN 'gap' ELSE 'worse' END
      WHEN {tested} IN ('PASS', 'PASS_EMULATED') THEN 'better' WHEN {native} = 'FAIL' AND {tested} = 'FAIL' THEN 'both_fail'
      WHEN {native} = 'NOT_RUN' AND {tested} = 'NOT_RUN' THEN 'both_not_run' ELSE 'other' END"""


def labelled_pairs(rows: DataFrame) -> DataFrame:
    """`rows(test, a, b)` with the label of the two statuses."""
    return sql(f"SELECT test, a, b, {pair_label()} AS label FROM {{r}}", r=rows)


def occurrences(assertions: DataFrame) -> DataFrame:
    """The k-th occurrence of each operation within its arm and test."""
    return sql("SELECT *, row_number() OVER (PARTITION BY arm, test, op ORDER BY n) AS occurrence FROM {a}", a=assertions)


def identity_pairs(assertions: DataFrame, native: str, tested: str) -> DataFrame:
    """Pairs of assertions by (test, operation, occurrence) where both arms run it equally often; the others are unpairable, with the reason."""
    numbered = occurrences(assertions)
    return sql(
        f"""SELECT coalesce(a.test, b.test) AS test, coalesce(a.op, b.op) AS op, coalesce(a.occurrence, b.occurrence) AS occurrence, a.ok AS native_ok, b.ok AS tested_ok,
                   CASE WHEN b.n IS NULL THEN 'only native' WHEN a.n IS NULL THEN 'only tested' WHEN a.times <> b.times THEN 'multiplicity' END AS why
            FROM (SELECT *, count(*) OVER (PARTITION BY test, op) AS times FROM {{n}} WHERE arm = '{native}') a
            FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY test, op) AS times FROM {{n}} WHERE arm = '{tested}') b
              ON a.test = b.test AND a.op = b.op AND a.occurrence = b.occurrence""",
        n=numbered,
    )


def rollup(pairs: DataFrame) -> DataFrame:
    """Established regressions (paired, native passes only), looser and equal pairs, and those that cannot be paired."""
    return sql(
        """SELECT CASE WHEN why IS NOT NULL THEN 'unpairable' WHEN native_ok AND NOT tested_ok THEN 'regression' WHEN tested_ok AND NOT native_ok THEN 'looser' ELSE 'same' END AS label, count(*) AS n FROM {p} GROUP BY 1""",
        p=pairs,
    )


def reconcile(worse: DataFrame, accepted: DataFrame) -> DataFrame:
    """Worse rows (test, n, detail) against `accepted(test, n, pattern, reason)`: waived, uncovered, and accepted rows that are stale."""
    return sql(
        """SELECT w.test, w.n, CASE WHEN max(a.reason) IS NULL THEN 'uncovered' ELSE 'waived' END AS state, max(a.reason) AS reason FROM {w} w LEFT JOIN {a} a ON w.test = a.test AND w.n = a.n AND w.detail RLIKE a.pattern GROUP BY w.test, w.n
           UNION ALL SELECT a.test, a.n, 'stale', a.reason FROM {a} a LEFT ANTI JOIN {w} w ON w.test = a.test AND w.n = a.n AND w.detail RLIKE a.pattern""",
        w=worse,
        a=accepted,
    )


def derive(worse: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The first rule (pattern, reason), in order, that fits each worse row's detail; a row that none fits has no reason, and must stop the caller."""
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(rules):
        reason = F.when(F.col("detail").rlike(pattern), why).otherwise(reason)
    return worse.withColumn("reason", reason)


def case_verdict(rows: DataFrame) -> DataFrame:
    """Verdict of `rows(test, native, tested, native_residue, tested_residue)`: never PASS without both assertions, on a broken native arm, or over unequal residue."""
    return sql(
        """SELECT test, CASE WHEN native = 'skipped' OR tested = 'skipped' THEN 'INVALID' WHEN native = 'refused' OR tested = 'refused' OR native = 'failed' THEN 'UNMEASURABLE'
             WHEN tested = 'failed' AND native = 'passed' THEN 'FAIL'
             WHEN native = 'passed' AND tested = 'passed' THEN CASE WHEN sort_array(native_residue) = sort_array(tested_residue) THEN 'PASS' ELSE 'UNMEASURABLE' END ELSE 'UNMEASURABLE' END AS verdict FROM {r}""",
        r=rows,
    )


#: Which state wins; the two receipts differ, and both are kept.
BENCH_PRECEDENCE = ("INVALID", "FAIL", "UNMEASURABLE", "PASS")
RECEIPT_PRECEDENCE = ("INVALID", "UNMEASURABLE", "FAIL", "PASS")


def worst(verdicts: DataFrame, precedence: tuple[str, ...], by: str) -> DataFrame:
    """The state of each group by precedence."""
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col("verdict"))
    return verdicts.groupBy(by).agg(F.element_at(F.array(*map(F.lit, precedence)), F.min(place).cast("int")).alias("state"), F.count("*").alias("n"))


def suite_verdict(reasons: DataFrame) -> DataFrame:
    """State of each run from its reasons' kinds: integrity, then divergence, then capability; coverage never changes it."""
    return sql("SELECT run, CASE WHEN bool_or(kind = 'integrity') THEN 'INVALID' WHEN bool_or(kind = 'divergence') THEN 'FAIL' WHEN bool_or(kind = 'capability') THEN 'UNMEASURABLE' ELSE 'PASS' END AS state, count_if(kind = 'coverage') AS coverage FROM {r} GROUP BY run", r=reasons)


def partition_histogram(rows: DataFrame, buckets: list[tuple[str, str]]) -> DataFrame:
    """First-match-wins buckets (name, SQL condition); every row is in exactly one, `rest` if in no other, so they add up."""
    case = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in buckets)
    return sql(f"SELECT CASE {case} ELSE 'rest' END AS bucket, count(*) AS n FROM {{r}} GROUP BY 1", r=rows)


def receipt(labels: DataFrame) -> DataFrame:
    """Label counts, the sorted gap list of each class, and the state by the receipt's precedence: one row."""
    return sql(
        """SELECT count_if(label = 'both_pass') AS both_pass, count_if(label = 'worse') AS worse, count_if(label = 'gap') AS gap, count_if(label = 'better') AS better,
             CASE WHEN count_if(label = 'invalid') > 0 THEN 'INVALID' WHEN count_if(label = 'gap') > 0 THEN 'UNMEASURABLE' WHEN count_if(label = 'worse') > 0 THEN 'FAIL' ELSE 'PASS' END AS state FROM {l}""",
        l=labels,
    )


def coverage_gaps(native: DataFrame, tested: DataFrame) -> DataFrame:
    """Gates (gate, source) that one arm lacks, and which sources asked for them."""
    return sql(
        "SELECT coalesce(a.gate, b.gate) AS gate, CASE WHEN a.gate IS NULL THEN 'native' ELSE 'tested' END AS missing, coalesce(a.sources, b.sources) AS sources FROM (SELECT gate, array_sort(collect_set(source)) AS sources FROM {a} GROUP BY gate) a FULL OUTER JOIN (SELECT gate, array_sort(collect_set(source)) AS sources FROM {b} GROUP BY gate) b ON a.gate = b.gate WHERE a.gate IS NULL OR b.gate IS NULL",
        a=native,
        b=tested,
    )


def drift(computed: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Multiset difference of two one-column tables, both ways."""
    column = computed.columns[0]
    return computed.exceptAll(reviewed).select(F.col(column), F.lit("computed only").alias("side")).union(reviewed.exceptAll(computed).select(F.col(column), F.lit("reviewed only")))


def tree_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files and bytes by kind and label of two trees (path, kind, size, digest): same, content, size, only_a, only_b."""
    return sql(
        """SELECT kind, label, count(*) AS files, sum(size) AS bytes FROM (
             SELECT coalesce(a.kind, b.kind) AS kind, greatest(coalesce(a.size, 0), coalesce(b.size, 0)) AS size,
               CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' WHEN a.size <> b.size THEN 'size' WHEN a.digest <> b.digest THEN 'content' ELSE 'same' END AS label
             FROM {a} a FULL OUTER JOIN {b} b ON a.path = b.path) GROUP BY kind, label""",
        a=a,
        b=b,
    )


def manifest_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Paths added or removed, and a row for each changed field with its two values as text."""
    stack = ", ".join(f"'{f}', CAST(a.{f} AS STRING), CAST(b.{f} AS STRING)" for f in fields)
    return sql(
        f"""SELECT coalesce(a.{key}, b.{key}) AS {key}, CASE WHEN a.{key} IS NULL THEN 'added' ELSE 'removed' END AS change, CAST(NULL AS STRING) AS old, CAST(NULL AS STRING) AS new FROM {{a}} a FULL OUTER JOIN {{b}} b ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL
            UNION ALL SELECT {key}, field, old, new FROM (SELECT a.{key}, stack({len(fields)}, {stack}) AS (field, old, new) FROM {{a}} a JOIN {{b}} b ON a.{key} = b.{key}) WHERE NOT old <=> new""",
        a=before,
        b=after,
    )


def import_faults(source: DataFrame, imported: DataFrame) -> DataFrame:
    """Differences of an imported tree (path, kind, mode, size, digest, ino) from its source: fields, and hard-link groups of another size."""
    fields = manifest_diff(source, imported, "path", ["kind", "mode", "size", "digest"])
    group = "SELECT path, count(*) OVER (PARTITION BY ino) AS links FROM {{{t}}}"
    links = sql(f"SELECT a.path, 'links' AS change, CAST(a.links AS STRING) AS old, CAST(b.links AS STRING) AS new FROM ({group.format(t='a')}) a JOIN ({group.format(t='b')}) b ON a.path = b.path WHERE a.links <> b.links", a=source, b=imported)
    return fields.union(links)


def first_divergence(a: DataFrame, b: DataFrame, gaps: DataFrame, by: str) -> DataFrame:
    """For each `by`, the first position where two streams (by, pos, op) differ or one has ended; it is a capability gap if that side skips the op. No row where they are equal."""
    return sql(
        f"""SELECT {by}, x.* FROM (SELECT {by}, min_by(struct(pos, native_op, tested_op, capability), pos) AS x FROM (
             SELECT coalesce(a.{by}, b.{by}) AS {by}, coalesce(a.pos, b.pos) AS pos, a.op AS native_op, b.op AS tested_op, g.op IS NOT NULL AS capability
             FROM {{a}} a FULL OUTER JOIN {{b}} b ON a.{by} = b.{by} AND a.pos = b.pos LEFT JOIN {{g}} g ON g.op = a.op WHERE NOT a.op <=> b.op) GROUP BY {by})""",
        a=a,
        b=b,
        g=gaps,
    )


def row_faults(lines: DataFrame) -> DataFrame:
    """Why lines of result files (file, n, line) cannot be trusted, a row for each (file, n, fault); blank lines are skipped.

    A file has one `meta` record, before any other; a `rep` has a positive
    number of seconds; other kinds are unknown.
    """
    return sql(
        """WITH parsed AS (SELECT file, n, schema_of_variant(try_parse_json(line)) AS shape, get_json_object(line, '$.kind') AS kind, try_cast(get_json_object(line, '$.seconds') AS DOUBLE) AS seconds FROM {l} WHERE trim(line) <> ''),
                first AS (SELECT file, min(n) AS meta FROM parsed WHERE kind = 'meta' GROUP BY file)
           SELECT p.file, p.n, f.fault FROM parsed p LEFT JOIN first m ON p.file = m.file LATERAL VIEW explode(filter(
             CASE WHEN shape IS NULL THEN array('not JSON') WHEN NOT startswith(shape, 'OBJECT') THEN array('not a JSON object') ELSE array(
               CASE WHEN kind = 'meta' AND p.n > meta THEN 'more than one meta record' END,
               CASE WHEN kind = 'rep' AND (meta IS NULL OR p.n < meta) THEN 'rep before the meta record' END,
               CASE WHEN kind = 'rep' AND NOT coalesce(seconds > 0, false) THEN 'seconds are not a positive number' END,
               CASE WHEN kind IS NULL OR kind NOT IN ('meta', 'rep') THEN 'unknown kind' END) END, x -> x IS NOT NULL)) f AS fault""",
        l=lines,
    )


def classified(texts: DataFrame, groups: list[tuple[str, list[tuple[str, str]]]], default: str = "SAFE", text_col: str = "text") -> DataFrame:
    """`texts` with `verdict`, that of the last of the ordered `groups` of (pattern, reason) with a hit, and all `reasons`."""
    hit = lambda patterns: [F.when(F.col(text_col).rlike(p), why) for p, why in patterns]
    verdict = F.lit(default)
    for name, patterns in groups:
        verdict = F.when(F.array_size(F.array_compact(F.array(*hit(patterns)))) > 0, name).otherwise(verdict)
    return texts.withColumns({"verdict": verdict, "reasons": F.array_compact(F.array(*[c for _, patterns in groups for c in hit(patterns)]))})


def attributed(deltas: DataFrame, gaps: DataFrame) -> DataFrame:
    """Operation counts that differ, explained if the operation is a known gap."""
    return sql("SELECT d.op, d.delta, g.op IS NOT NULL AS explained FROM {d} d LEFT JOIN (SELECT DISTINCT op FROM {g}) g ON d.op = g.op WHERE d.delta <> 0", d=deltas, g=gaps)


def readback(promised: DataFrame, observed: DataFrame) -> DataFrame:
    """Receipts (name, level, size, digest) against what is there: durable ones must match, applied ones may be missing, removed ones must be gone."""
    return sql(
        """SELECT p.name, p.level, CASE WHEN level = 'removed' THEN CASE WHEN o.name IS NULL THEN 'ok' ELSE 'came back' END
             WHEN o.name IS NULL THEN CASE WHEN level = 'durable' THEN 'lost' ELSE 'ok' END WHEN o.size <> p.size OR o.digest <> p.digest THEN 'damaged' ELSE 'ok' END AS state
           FROM {p} p LEFT JOIN {o} o ON p.name = o.name""",
        p=promised,
        o=observed,
    )


def unlisted(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """Durable names that a listing lacks."""
    return expected.where("level = 'durable'").join(listed.select("name"), "name", "left_anti").select("name")


def freshness(bases: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether each base's recorded commit is the resolved head; every unknown is not fresh, with a reason."""
    return sql(
        """SELECT b.repo, CASE WHEN b.commit IS NULL THEN 'no record' WHEN h.repo IS NULL THEN 'no head' WHEN h.commit IS NULL THEN 'unresolved' WHEN b.commit <> h.commit THEN 'stale' ELSE 'fresh' END AS state,
             coalesce(b.commit = h.commit, false) AS fresh FROM {b} b LEFT JOIN {h} h ON b.repo = h.repo""",
        b=bases,
        h=heads,
    )

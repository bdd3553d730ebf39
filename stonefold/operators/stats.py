"""Statistics of benchmark runs and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonefold.operators.base import sql
from stonefold.operators.order import running


def medians(reps: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Median (the mean of the middle two for even counts), least, largest and count of each group."""
    return sql(f"SELECT {by}, median({value}) AS median, min({value}) AS lo, max({value}) AS hi, count({value}) AS n FROM {{r}} GROUP BY {by}", r=reps)


def peak_or_unknown(samples: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Largest value; unknown (NaN) if any sample is null or NaN."""
    return sql(f"SELECT {by}, max(coalesce(CAST({value} AS DOUBLE), double('NaN'))) AS peak FROM {{s}} GROUP BY {by}", s=samples)


def positional_ratios(a: DataFrame, b: DataFrame, order: str, value: str = "value") -> DataFrame:
    """b over a, paired by position; zero denominators are dropped."""
    one = lambda rows: running(rows.selectExpr(order, f"CAST({value} AS DOUBLE) AS v"), [F.col(order)])
    return sql("SELECT a.place AS rep, b.v / a.v AS ratio FROM {a} a JOIN {b} b ON a.place = b.place WHERE a.v <> 0", a=one(a), b=one(b))


def nearest_rank_p95(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """The element at index min(n - 1, floor(0.95 n)) of the sorted values, from 0.

    By rank rather than by a gathered list, so no group is held in memory.
    """
    return sql(
        f"SELECT {by}, max(v) AS p95 FROM (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {{r}} WHERE {value} IS NOT NULL) WHERE i = least(n - 1, (95 * n) DIV 100) GROUP BY {by}",
        r=rows,
    )


def ratio_of_medians(reps: DataFrame, gate: str, arm: str, base: str, other: str, value: str = "value") -> DataFrame:
    """Median of one arm over the other's, by gate; null where a side is absent or 0."""
    return sql(
        f"SELECT {gate}, median({value}) FILTER (WHERE {arm} = '{base}') AS base, median({value}) FILTER (WHERE {arm} = '{other}') AS other, try_divide(median({value}) FILTER (WHERE {arm} = '{other}'), median({value}) FILTER (WHERE {arm} = '{base}')) AS ratio FROM {{r}} GROUP BY {gate}",
        r=reps,
    )


def noise_floor(reps: DataFrame, spread_max: float = 2.0, min_reps: int = 3, floor: float = 3.0, bar: float = 2.0) -> DataFrame:
    """Why a gate's two arms cannot be ruled on, the first reason of: too few reps, too short, spread too wide, or a median that could flip."""
    return sql(
        f"""SELECT gate, CASE WHEN n_a < {min_reps} OR n_b < {min_reps} THEN 'reps' WHEN med_a < {floor} THEN 'floor'
              WHEN lo_a <= 0 OR hi_a > {spread_max} * lo_a OR lo_b <= 0 OR hi_b > {spread_max} * lo_b THEN 'spread'
              WHEN NOT (hi_b <= {bar} * lo_a OR lo_b > {bar} * hi_a) THEN 'flip' END AS why
            FROM (SELECT gate, count_if(arm = 'a') AS n_a, count_if(arm = 'b') AS n_b, median(value) FILTER (WHERE arm = 'a') AS med_a, min(value) FILTER (WHERE arm = 'a') AS lo_a,
              max(value) FILTER (WHERE arm = 'a') AS hi_a, min(value) FILTER (WHERE arm = 'b') AS lo_b, max(value) FILTER (WHERE arm = 'b') AS hi_b FROM {{r}} GROUP BY gate)""",
        r=reps,
    )


def trial_summary(phases: DataFrame, quiet_load: float, band: float) -> DataFrame:
    """Per phase, of the reps that all three arms have: ratio to the mean of both native arms, their own ratio, seconds added, and validity."""
    return sql(
        f"""SELECT phase, count(*) AS reps, median(t / ((a + b) / 2)) AS ratio, min(t / ((a + b) / 2)) AS ratio_lo, max(t / ((a + b) / 2)) AS ratio_hi, median(b / a) AS noise, median(t - (a + b) / 2) AS added, max(load) AS max_load,
              CASE WHEN max(load) <= {quiet_load} AND abs(median(b / a) - 1) <= {band} THEN 'VALID' ELSE 'PROVISIONAL' END AS verdict
            FROM (SELECT phase, rep, max(wall_s) FILTER (WHERE arm = 'native_a') AS a, max(wall_s) FILTER (WHERE arm = 'native_b') AS b, max(wall_s) FILTER (WHERE arm = 'tested') AS t, max(load) AS load FROM {{p}} GROUP BY phase, rep)
            WHERE a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL GROUP BY phase""",
        p=phases,
    )


def arm_totals(records: DataFrame) -> DataFrame:
    """Conditional counters over test records (arm, plan, ok, not_ok, skip, todo, bail_out, rc, timed_out)."""
    return sql(
        """SELECT arm, count(*) AS scripts, coalesce(sum(plan), 0) AS planned, coalesce(sum(ok), 0) AS ok, coalesce(sum(not_ok), 0) AS not_ok, coalesce(sum(skip), 0) AS skip, coalesce(sum(todo), 0) AS todo, coalesce(sum(bail_out), 0) AS bail_out,
                  count_if(rc <> 0) AS nonzero, count_if(timed_out) AS timed_out, count_if(plan IS NULL) AS no_plan, count_if(plan <> ok + not_ok) AS short, count_if(not_ok = 0 AND rc = 0 AND plan = ok) AS clean FROM {r} GROUP BY arm""",
        r=records,
    )


def op_counts(ops: DataFrame) -> DataFrame:
    """Operations by name, skipped ones apart."""
    return ops.groupBy("op").agg(F.count_if(~F.col("skip")).alias("n"), F.count_if("skip").alias("skipped"))


def budget_report(cases: DataFrame, budget: int) -> DataFrame:
    """Bytes by arm, cases over the budget, and whether sizes are missing."""
    return sql(f"SELECT arm, coalesce(sum(size), 0) AS bytes, count_if(size > {budget}) AS over, count_if(size IS NULL) > 0 AS partial FROM {{c}} GROUP BY arm", c=cases)


def load_filtered(rows: DataFrame, most_load: float) -> DataFrame:
    """Median, least and largest of quiet rows by workload, metric and layout; rows over the load are counted as flagged."""
    return sql(f"SELECT workload, metric, layout, median(value) FILTER (WHERE load <= {most_load}) AS median, min(value) FILTER (WHERE load <= {most_load}) AS lo, max(value) FILTER (WHERE load <= {most_load}) AS hi, count_if(load > {most_load}) AS flagged FROM {{r}} GROUP BY workload, metric, layout", r=rows)


def procedure_profile(runs: DataFrame) -> DataFrame:
    """Median count of each procedure over good runs (run, ok, counts map); a run without it counts as absent."""
    return sql("SELECT proc, median(n) AS median, count(*) AS runs FROM (SELECT explode(counts) AS (proc, n) FROM {r} WHERE ok) GROUP BY proc", r=runs)


def idle_percents(snaps: DataFrame, key: str, order: str) -> DataFrame:
    """Idle share between neighbouring samples (idle, total); an interval without ticks gives no row."""
    return sql(
        f"SELECT {key}, {order}, 100.0D * (idle - idle0) / (total - total0) AS idle_pct FROM (SELECT *, lag(idle) OVER w AS idle0, lag(total) OVER w AS total0 FROM {{s}} WINDOW w AS (PARTITION BY {key} ORDER BY {order})) WHERE total > total0",
        s=snaps,
    )


def cpu_deltas(before: DataFrame, after: DataFrame, seconds: float, hz: float) -> DataFrame:
    """CPU percent of each process of the later sample, matched by (pid, starttime); a new process counts in full."""
    return sql(f"SELECT a.pid, a.starttime, 100.0D * (a.ticks - coalesce(b.ticks, 0)) / ({hz}D * {seconds}D) AS cpu FROM {{a}} a LEFT JOIN {{b}} b ON a.pid = b.pid AND a.starttime = b.starttime", a=after, b=before)


def foreign_cpu(cpu: DataFrame, own: DataFrame, top: int = 3) -> DataFrame:
    """The `top` processes by CPU that are not in `own(pid)`, with the total of all such."""
    foreign = cpu.join(own.select("pid"), "pid", "left_anti")
    return sql(f"SELECT pid, cpu, (SELECT sum(cpu) FROM {{f}}) AS foreign_total FROM {{f}} ORDER BY cpu DESC, pid LIMIT {top}", f=foreign)


def paired_with_preceding(rows: DataFrame, key: str, order: str, base: str) -> DataFrame:
    """Each row of another side with the last base row before it in its group; a base row is taken once, by the first that follows it."""
    return sql(
        f"""SELECT {key}, side, base_value, value, try_divide(value, base_value) AS ratio FROM (
              SELECT *, row_number() OVER (PARTITION BY {key}, base_at ORDER BY {order}) AS nth FROM (
                SELECT *, last(CASE WHEN side = '{base}' THEN value END, true) OVER w AS base_value, last(CASE WHEN side = '{base}' THEN {order} END, true) OVER w AS base_at
                FROM {{r}} WINDOW w AS (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) WHERE side <> '{base}' AND base_at IS NOT NULL) WHERE nth = 1""",
        r=rows,
    )


def load_during(runs: DataFrame, samples: DataFrame, pad: int, bucket: int = 3600) -> DataFrame:
    """Least and largest sample (t, v) within each run's padded interval (id, t0, t1); nulls where there is none.

    An equality join on time buckets, so samples meet only runs near them.
    """
    return sql(
        f"""SELECT r.id, min(s.v) AS lo, max(s.v) AS hi, count(s.v) AS n FROM
              (SELECT *, explode(sequence((t0 - {pad}) DIV {bucket}, (t1 + {pad}) DIV {bucket})) AS b FROM {{r}}) r
            LEFT JOIN (SELECT *, t DIV {bucket} AS b FROM {{s}}) s ON r.b = s.b AND s.t BETWEEN r.t0 - {pad} AND r.t1 + {pad} GROUP BY r.id""",
        r=runs,
        s=samples,
    )


def rep_ratios(rows: DataFrame, most_load: float) -> DataFrame:
    """Ratio of the arms joined by (workload, rep), native above 0: median, least, largest, and runs under load."""
    return sql(
        f"""SELECT workload, median(t / n) AS ratio, min(t / n) AS lo, max(t / n) AS hi, count_if(load > {most_load}) AS loaded
            FROM (SELECT workload, rep, max(value) FILTER (WHERE arm = 'native') AS n, max(value) FILTER (WHERE arm = 'tested') AS t, max(load) AS load FROM {{r}} GROUP BY workload, rep)
            WHERE n > 0 AND t IS NOT NULL GROUP BY workload""",
        r=rows,
    )


def only_unseen_holds(holds: DataFrame) -> DataFrame:
    """Processes with a hold that is no working directory and none that is."""
    return sql("SELECT pid, count(*) AS holds FROM {h} GROUP BY pid HAVING bool_or(kind <> 'cwd') AND NOT bool_or(kind = 'cwd')", h=holds)


def completion(phases: DataFrame) -> DataFrame:
    """Closed items over all, of nested `phases(name, items array<struct<closed>>)`."""
    return sql("SELECT name, count_if(i.closed) AS closed, count(i) AS total FROM (SELECT name, explode_outer(items) AS i FROM {p}) GROUP BY name", p=phases)


def _uniform(seed: int, *parts: Column) -> Column:
    """A number within 0 and 1 that hangs on the seed and the parts alone: 52 bits of their MD5."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def noise_simulation(spark, sigmas: list[float], trials: int, add: float = 0.5, base: float = 23.0, reps: int = 5, bar: float = 2.0, seed: int = 1) -> DataFrame:
    """Shares of PASS, FAIL and undecided verdicts under log-normal noise of each sigma, by seeded Monte Carlo.

    Noise comes from a hash of seed, side, sigma, trial and repetition, so it is
    the same however rows are dealt.
    """
    rows = spark.range(trials).select("id", F.explode(F.array(*map(F.lit, range(len(sigmas))))).alias("s")).select("id", "s", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    normal = lambda side: F.sqrt(-2 * F.log(_uniform(seed, F.lit(side + "u"), F.col("s"), F.col("id"), F.col("rep")))) * F.cos(2 * math.pi * _uniform(seed, F.lit(side + "v"), F.col("s"), F.col("id"), F.col("rep")))
    sigma = F.element_at(F.array(*[F.lit(float(x)) for x in sigmas]), F.col("s") + 1)
    rows = rows.withColumns({"sigma": sigma, "a": F.lit(base) * F.exp(sigma * normal("a")), "b": F.lit(base + add) * F.exp(sigma * normal("b"))})
    ends = rows.groupBy("sigma", "id").agg(*[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))])
    verdict = F.when(F.col("hi_b") <= bar * F.col("lo_a"), "PASS").when(F.col("lo_b") > bar * F.col("hi_a"), "FAIL").otherwise("undecided")
    return ends.groupBy("sigma").agg(*[(F.count_if(verdict == v) / trials).alias(v.lower()) for v in ("PASS", "FAIL", "undecided")])

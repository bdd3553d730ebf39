"""Parsers of text logs into tables, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.operators.base import sql

#: The grammar of test output.
PLAN = r"^1\.\.(\d+)"
RESULT = r"^(ok|not ok)\s+(\d+)(?:\s*#\s*(TODO|skip))?\s*-?\s*(.*)$"


def lines(texts: DataFrame) -> DataFrame:
    """`texts(id, text)` as (id, n, line), n from 1."""
    return texts.select("id", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def tap(texts: DataFrame) -> DataFrame:
    """Test output: per text the plan, counts and results; what is before the plan or outside the grammar is malformed."""
    rows = sql(f"SELECT id, n, line, line RLIKE r'{PLAN}' AS is_plan FROM {{l}}", l=lines(texts))
    rows = sql("SELECT *, min(CASE WHEN is_plan THEN n END) OVER (PARTITION BY id) AS plan_at FROM {r}", r=rows)
    return sql(
        f"""SELECT id, max(CAST(regexp_extract(CASE WHEN n = plan_at THEN line END, r'{PLAN}', 1) AS INT)) AS plan,
              count_if(n > plan_at AND regexp_extract(line, r'{RESULT}', 1) = 'ok') AS ok, count_if(n > plan_at AND regexp_extract(line, r'{RESULT}', 1) = 'not ok') AS not_ok,
              count_if(n > plan_at AND regexp_extract(line, r'{RESULT}', 3) = 'TODO') AS todo, count_if(n > plan_at AND regexp_extract(line, r'{RESULT}', 3) = 'skip') AS skip,
              count_if(n > plan_at AND line LIKE 'Bail out!%') AS bail_out,
              count_if(trim(line) <> '' AND (plan_at IS NULL OR n < plan_at OR n > plan_at AND NOT line LIKE 'Bail out!%' AND NOT line RLIKE r'{RESULT}')) AS malformed
            FROM {{r}} GROUP BY id""",
        r=rows,
    )


def tap_results(texts: DataFrame) -> DataFrame:
    """(id, n, ok, todo, detail) of each result line."""
    return sql(
        f"SELECT id, CAST(regexp_extract(line, r'{RESULT}', 2) AS INT) AS n, regexp_extract(line, r'{RESULT}', 1) = 'ok' AS ok, regexp_extract(line, r'{RESULT}', 3) = 'TODO' AS todo, trim(regexp_extract(line, r'{RESULT}', 4)) AS detail FROM {{l}} WHERE line RLIKE r'{RESULT}'",
        l=lines(texts),
    )


def console(runs: DataFrame) -> DataFrame:
    """Status of single-case runs (id, case, text, rc): a not-run bracket decides before the summary, an exit code before neither."""
    return sql(
        r"""SELECT id, CASE WHEN rc IN (124, 137) THEN 'TIMEOUT' WHEN body IS NULL OR summary = '' THEN 'NO_RESULT' WHEN summary LIKE 'Failed%' THEN 'FAIL' WHEN summary <> 'Passed all 1 tests' THEN 'NO_RESULT'
                WHEN body LIKE '%[not run]%' THEN CASE WHEN contains(text, concat('Not run: ', case)) THEN 'NOT_RUN' ELSE 'NO_RESULT' END WHEN rc <> 0 THEN 'NO_RESULT' WHEN body RLIKE r'^\d+s\b' THEN 'PASS' ELSE 'NO_RESULT' END AS status,
              nullif(trim(regexp_extract(body, r'\[not run\]\s*(.*)', 1)), '') AS reason
            FROM (SELECT id, case, text, rc, try_element_at(filter(transform(split(text, '\n'), x -> CASE WHEN x RLIKE concat(r'^\Q', case, r'\E\s+') THEN regexp_extract(x, r'^\S+\s+(.*)$', 1) END), x -> x IS NOT NULL), 1) AS body,
                    coalesce(try_element_at(regexp_extract_all(text, r'(?m)^((?:Passed all|Failed) .*)$', 1), -1), '') AS summary FROM {r})""",
        r=runs,
    )


def lsof(texts: DataFrame, prefix: str) -> DataFrame:
    """Holds (id, pid, command, fd, kind, path) under a prefix from tagged lines; `faults` tells malformed input, which is no empty answer."""
    rows = sql("SELECT id, n, substr(line, 1, 1) AS tag, substr(line, 2) AS v FROM {l} WHERE line <> ''", l=lines(texts))
    carried = sql(
        """SELECT *, last(CASE WHEN tag = 'c' THEN v WHEN tag = 'p' THEN '' END, true) OVER w AS command, last(CASE WHEN tag = 'f' THEN v WHEN tag = 'p' THEN '' END, true) OVER w AS fd,
             last(CASE WHEN tag = 'p' THEN try_cast(trim(v) AS BIGINT) END, true) OVER w AS pid FROM {r} WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)""",
        r=rows,
    )
    return sql(
        f"""SELECT id, pid, command, fd, CASE WHEN fd = 'cwd' THEN 'cwd' WHEN fd RLIKE '[^0-9]' THEN 'lock' ELSE 'fd' END AS kind, v AS path FROM {{c}} WHERE tag = 'n' AND pid IS NOT NULL AND fd <> '' AND (v = '{prefix}' OR startswith(v, '{prefix}/'))""",
        c=carried,
    )


def lsof_faults(texts: DataFrame) -> DataFrame:
    """Lines that are no such field: an unknown tag, a process id that is none, or a descriptor or name out of place."""
    rows = sql("SELECT id, n, line, substr(line, 1, 1) AS tag, substr(line, 2) AS v FROM {l} WHERE line <> ''", l=lines(texts))
    return sql(
        """SELECT id, n, line FROM (SELECT *, max(CASE WHEN tag = 'p' THEN n END) OVER w AS p_at, max(CASE WHEN tag = 'f' THEN n END) OVER w AS f_at FROM {r} WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING))
           WHERE tag NOT IN ('p', 'c', 'f', 'n') OR tag = 'p' AND coalesce(try_cast(trim(v) AS BIGINT), 0) <= 0 OR tag = 'f' AND p_at IS NULL OR tag = 'n' AND (f_at IS NULL OR f_at < p_at)""",
        r=rows,
    )


def proc_holds(links: DataFrame, locks: DataFrame, prefix: str) -> DataFrame:
    """Holds of `links(pid, fd, path, major, minor, inode)` under a prefix; a descriptor that the lock table names is a lock row, too."""
    return sql(
        f"""WITH held AS (SELECT * FROM {{l}} WHERE path = '{prefix}' OR startswith(path, '{prefix}/'))
            SELECT pid, path, CASE WHEN fd = 'cwd' THEN 'cwd' ELSE 'fd' END AS kind FROM held
            UNION ALL SELECT pid, path, 'lock' FROM held LEFT SEMI JOIN {{k}} k USING (major, minor, inode) WHERE fd <> 'cwd'""",
        l=links,
        k=locks,
    )


def cpu_ticks(stats: DataFrame) -> DataFrame:
    """(id, idle, total) of the first line of a CPU statistics text: idle with waiting, and the sum of the first eight fields."""
    return sql(
        r"SELECT id, f[3] + f[4] AS idle, aggregate(slice(f, 1, 8), 0L, (a, x) -> a + x) AS total FROM (SELECT id, transform(slice(split(trim(element_at(split(text, '\n'), 1)), r'\s+'), 2, 10), x -> CAST(x AS BIGINT)) AS f FROM {s} WHERE text LIKE 'cpu %')",
        s=stats,
    )


def operations(texts: DataFrame) -> DataFrame:
    """(id, pos, op, skip) of recorded operations, one a line as `[skip ]name ...`; positions are those in the file."""
    return sql("SELECT id, n AS pos, line LIKE 'skip %' AS skip, regexp_extract(line, '^(?:skip )?(\\\\S+)', 1) AS op FROM {l} WHERE line NOT LIKE '#%' AND trim(line) <> ''", l=lines(texts))


def key_values(texts: DataFrame) -> DataFrame:
    """(id, key, value, n) of `key=value` lines: the last value wins, n is how often the key is there."""
    return sql("SELECT id, key, max_by(value, n) AS value, count(*) AS n FROM (SELECT id, n, trim(substring_index(line, '=', 1)) AS key, substr(line, instr(line, '=') + 1) AS value FROM {l} WHERE instr(line, '=') > 1) GROUP BY id, key", l=lines(texts))

"""Heuristic quality rules with host-level verdicts, in DataFrame functions only.

A document's figures come from its own row: words, code points, symbols,
repeated lines, and words in repeated windows (window hashes are sorted with
their positions, equal neighbours are repeats, and runs of positions give the
covered words), so texts are never shuffled. The figures are checkpointed, each
rule's failures are counted by host, and a host's failure rate is shrunk toward
the corpus rate by a beta prior fitted to all hosts by the method of moments. A
host one of whose shrunk rates passes the limit is rejected with its documents.
Host counts are combined before the shuffle; the verdicts join back by host,
where adaptive execution broadcasts them if they are measured to be small and
splits a hot host if not.

Defined results: a null text has no words; a null host is the host named by the
empty text; documents with under three words have no repeated window; repeated
rows are judged each for itself; an empty table gives an empty table. Only the
id, text and host columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonefold.llm.common import WORD_BREAK, checkpoint, spread

WINDOW_WORDS = 3
MIN_WORDS = 50
#: A document fails `repetitive` if over this many hundredths of its words are in repeated windows.
MAX_REPEAT_PERCENT = 50
#: Over this many tenths of its lines repeat an earlier one.
MAX_DUP_LINE_TENTHS = 3
#: Over so many symbols per ten words.
MAX_SYMBOLS_PER_TEN_WORDS = 1
#: Mean code points a word.
WORD_LENGTH = (3, 10)
#: A host is rejected if a shrunk failure rate passes this.
MAX_HOST_RATE = 0.5
RULES = ("few_words", "repetitive", "dup_lines", "symbols", "word_length")


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules look at, of every row."""
    rows = spread(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id",
        "host",
        F.filter(F.split("t", WORD_BREAK), lambda w: w != "").alias("w"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = F.expr(f"if(size(w) < {WINDOW_WORDS}, array(), transform(sequence(0, size(w) - {WINDOW_WORDS}), i -> struct(xxhash64({', '.join(f'w[i + {k}]' if k else 'w[i]' for k in range(WINDOW_WORDS))}) AS h, i AS at)))")
    rows = rows.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("s"),
    )
    repeats = F.expr("sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.at))")
    rows = rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("p"))
    covered = F.expr(f"if(size(p) = 0, 0, {WINDOW_WORDS} + aggregate(sequence(0, size(p) - 1), 0, (n, k) -> n + if(k = 0, 0, least({WINDOW_WORDS}, p[k] - p[k - 1]))))")
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def with_failures(rows: DataFrame) -> DataFrame:
    """`figures` with a boolean for each rule."""
    n = F.col("n_words")
    return rows.withColumns(
        {
            "few_words": n < MIN_WORDS,
            "repetitive": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
            "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * MAX_DUP_LINE_TENTHS,
            "symbols": F.col("n_symbols") * 10 > n * MAX_SYMBOLS_PER_TEN_WORDS,
            "word_length": (F.col("word_chars") < n * WORD_LENGTH[0]) | (F.col("word_chars") > n * WORD_LENGTH[1]),
        }
    )


def host_rates(failures: DataFrame) -> DataFrame:
    """host, rule, n, failed and the shrunk rate of every host and rule."""
    counts = failures.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    long = counts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES])).alias("x")).select("host", "n", "x.rule", "x.failed")
    # sums over hosts of n, failed, failed^2 / n: one row a rule
    totals = long.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum("failed").alias("bad"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"))
    mean, spare = F.col("bad") / F.col("docs"), F.col("hosts") / F.col("docs")
    between = F.col("squares") / F.col("docs") - mean * mean
    overdispersion = F.least(F.lit(0.9), F.greatest(F.lit(1e-4), (F.try_divide(between, mean * (1 - mean)) - spare) / F.greatest(1 - spare, F.lit(1e-9))))
    prior = totals.select("rule", mean.alias("mean"), F.coalesce(1 / overdispersion - 1, F.lit(1.0)).alias("strength"))
    # five rows at most, one a rule
    return long.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", ((F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All figures and rule failures of every row, `base_failed`, `host_rejected` and `kept`."""
    rows = with_failures(checkpoint(figures(docs, id_col, text_col, host_col)))
    # a join of two plain tables, so that adaptive execution can split a hot host
    verdicts = checkpoint(host_rates(rows).groupBy("host").agg(F.max(F.col("rate") > MAX_HOST_RATE).alias("host_rejected")))
    base = F.col("few_words") | F.col("repetitive")
    return rows.join(verdicts, "host").withColumns({"base_failed": base, "kept": ~base & ~F.col("host_rejected")})


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) >= 3),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, i, w FROM u)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM x, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
g AS (
  SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_dup_lines > 3 * n_lines AS dup_lines,
    10 * n_symbols > n_words AS symbols, word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length FROM f),
h AS (
  SELECT host, count(*) AS n, unnest(['few_words', 'repetitive', 'dup_lines', 'symbols', 'word_length']) AS rule,
    unnest([count(*) FILTER (few_words), count(*) FILTER (repetitive), count(*) FILTER (dup_lines), count(*) FILTER (symbols), count(*) FILTER (word_length)]) AS failed
  FROM g GROUP BY host),
p AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ^ 2 AS v FROM h GROUP BY rule),
q AS (SELECT rule, m, coalesce(1 / least(0.9, greatest(1e-4, (v / nullif(m * (1 - m), 0) - hosts / docs) / greatest(1 - hosts / docs, 1e-9))) - 1, 1) AS s FROM p),
b AS (SELECT host, bool_or((failed + m * s) / (n + s) > 0.5) AS host_rejected FROM h JOIN q USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repetitive AS base_failed, NOT (few_words OR repetitive) AND NOT host_rejected AS kept
FROM g JOIN b USING (host)
"""

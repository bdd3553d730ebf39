"""URL verdicts from rules and from a path-template tree learned for each host.

Rules first: the longest that fits a URL's host and path decides. The rest is
judged by templates. Segments that look variable (numbers, hashes, mixed codes)
become wildcards; then, level by level, a node with more than `MAX_CHILDREN`
different children has them generalised to one wildcard. What is below
`MAX_DEPTH` segments is one wildcard. Leaves of one parent whose shares of
blocked labels do not differ significantly are merged. A template is blocked if
the share of blocked among its labelled pages, smoothed by a uniform beta
prior, passes `MIN_PURITY`; too little evidence never blocks.

The tree is built from distinct templates with counts, never from a host's
pages: counts are combined before each shuffle, and after generalisation a
node has at most `MAX_CHILDREN` children, so the windows over siblings are
bounded. Pages find their template by an equality join that adaptive execution
splits where a template is hot.

Defined results: a null url, or one without `://`, has an empty host and path
and is judged by the template of those; a rule's path must be a prefix of the
URL's, so an empty path fits no rule; of fitting rules of equal length a block
rule goes first; repeated rows are repeated; an empty table gives an empty
table. Only the id and url columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonefold.llm.common import checkpoint

MAX_CHILDREN = 64
MAX_DEPTH = 8
#: Labelled pages that a leaf needs to be merged with another.
MIN_LABELLED = 5
#: Two shares differ if their pooled z score reaches this.
SIGNIFICANT_Z = 1.96
MIN_PURITY = 0.9

#: Verdict and rule, a host and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the last tried wins
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments; those that look variable are wildcards, those below MAX_DEPTH are one."""

    def general(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0)))
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "{x}")
            .when(s.rlike(r"[0-9]"), "{d}")
            .otherwise(s)
        )

    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    some = F.transform(F.slice(parts, 1, MAX_DEPTH), general)
    return F.when(path == "", F.array()).otherwise(F.when(F.size(parts) > MAX_DEPTH, F.concat(some, F.array(F.lit("{tail}")))).otherwise(some))


def generalise(leaves: DataFrame) -> DataFrame:
    """`leaves(host, lexical, segs, ...)` with wildcards for the children of nodes that have too many."""
    depth = leaves.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(depth):
        node = leaves.where(F.size("segs") > d).select("host", F.slice("segs", 1, d).alias("above"), F.col("segs")[d].alias("seg"))
        wide = node.groupBy("host", "above").agg(F.count_distinct("seg").alias("n")).where(F.col("n") > MAX_CHILDREN).select("host", "above", F.lit(True).alias("wide"))
        joined = leaves.withColumn("above", F.when(F.size("segs") > d, F.slice("segs", 1, d))).join(wide, ["host", "above"], "left")
        segs = F.when(F.col("wide"), F.concat("above", F.array(F.lit("*")), F.slice("segs", d + 2, MAX_DEPTH + 1))).otherwise(F.col("segs"))
        leaves = checkpoint(joined.withColumn("segs", segs).drop("above", "wide"))
    return leaves


def template_verdicts(pages: DataFrame) -> DataFrame:
    """host, lexical, template, purity and verdict of each distinct lexical template of `pages(host, lexical, blocked)`.

    `blocked` is the label: true, false or null where there is none.
    """
    leaves = pages.groupBy("host", "lexical").agg(F.count_if("blocked").alias("bad"), F.count("blocked").alias("labelled"))
    leaves = generalise(checkpoint(leaves.withColumn("segs", F.col("lexical"))))
    kinds = leaves.groupBy("host", "segs").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    known = kinds.where(F.col("labelled") >= MIN_LABELLED).withColumns({"share": F.col("bad") / F.col("labelled"), "above": F.slice("segs", 1, F.greatest(F.size("segs") - 1, F.lit(0))), "depth": F.size("segs")})
    siblings = Window.partitionBy("host", "depth", "above").orderBy("share", "segs")
    b0, n0, b1, n1 = F.lag("bad").over(siblings), F.lag("labelled").over(siblings), F.col("bad"), F.col("labelled")
    pooled = (b0 + b1) / (n0 + n1)
    z = F.try_divide(F.col("share") - b0 / n0, F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1)))
    known = known.withColumn("apart", (F.coalesce(z, F.lit(0.0)) >= SIGNIFICANT_Z).cast("int"))
    branch = known.withColumn("branch", F.sum("apart").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "depth", "above", "branch")
    merged = branch.select("host", "segs", F.sum("bad").over(group).alias("bad_m"), F.sum("labelled").over(group).alias("labelled_m"))
    judged = kinds.join(merged, ["host", "segs"], "left")
    purity = (F.coalesce("bad_m", "bad") + 1) / (F.coalesce("labelled_m", "labelled") + 2)
    judged = judged.select("host", "segs", purity.alias("purity"), F.when(purity >= MIN_PURITY, "block").otherwise("allow").alias("template_verdict"))
    return leaves.select("host", "lexical", "segs").join(judged, ["host", "segs"]).select("host", "lexical", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "purity", "template_verdict")


def judge(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row; the rules' verdicts are the labels."""
    rows = urls.select(F.col(id_col).alias("page_id"), *[c.alias(n) for c, n in zip(host_and_path(F.col(url_col)), ("host", "path"), strict=True)])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict, "lexical": segments(F.col("path"))})
    templates = template_verdicts(rows.select("host", "lexical", (F.col("rule_verdict") == "block").alias("blocked")))
    return rows.join(checkpoint(templates), ["host", "lexical"]).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "template_verdict").alias("verdict"), "template", "purity")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def _op9_sql() -> str:
    """The whole method as DuckDB SQL, a pair of expressions for each level of the tree."""
    segment = r"CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{n}' WHEN regexp_full_match(s, '[0-9]+\.[A-Za-z]+') THEN '{n}' || regexp_extract(s, '\.[A-Za-z]+$') WHEN regexp_full_match(s, '[0-9a-fA-F-]{8,}') THEN '{x}' WHEN regexp_matches(s, '[0-9]') THEN '{d}' ELSE s END"
    rule = verdict = "NULL"
    for what, text in sorted(RULES, key=lambda r: (len(r[1]), r[0] == "block")):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    levels = []
    for d in range(MAX_DEPTH + 1):
        levels.append(f"w{d} AS (SELECT host, segs[1:{d}] AS above FROM l{d} WHERE len(segs) > {d} GROUP BY ALL HAVING count(DISTINCT segs[{d + 1}]) > {MAX_CHILDREN})")
        levels.append(f"l{d + 1} AS (SELECT l.host, lexical, bad, labelled, CASE WHEN w.host IS NOT NULL THEN list_concat(list_concat(segs[1:{d}], ['*']), segs[{d + 2}:]) ELSE segs END AS segs FROM l{d} l LEFT JOIN w{d} w ON l.host = w.host AND len(segs) > {d} AND segs[1:{d}] = above)")
    z = "(share - b0 / n0) / nullif(sqrt((b0 + bad) / (n0 + labelled) * (1 - (b0 + bad) / (n0 + labelled)) * (1 / n0 + 1 / labelled)), 0)"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule, {verdict} AS rule_verdict, string_split(substr(path, 2), '/') AS parts FROM p),
x AS (SELECT page_id, host, path, rule, rule_verdict, CASE WHEN path = '' THEN [] ELSE list_concat(list_transform(parts[1:{MAX_DEPTH}], lambda s: {segment}), CASE WHEN len(parts) > {MAX_DEPTH} THEN ['{{tail}}'] ELSE [] END) END AS lexical FROM r),
l0 AS (SELECT host, lexical, count(*) FILTER (rule_verdict = 'block') AS bad, count(rule_verdict) AS labelled, lexical AS segs FROM x GROUP BY host, lexical),
{", ".join(levels)},
k AS (SELECT host, segs, sum(bad) AS bad, sum(labelled) AS labelled FROM l{MAX_DEPTH + 1} GROUP BY host, segs),
f AS (SELECT *, bad / labelled AS share, segs[1:len(segs) - 1] AS above, len(segs) AS depth FROM k WHERE labelled >= {MIN_LABELLED}),
g AS (SELECT *, lag(bad) OVER s AS b0, lag(labelled) OVER s AS n0 FROM f WINDOW s AS (PARTITION BY host, depth, above ORDER BY share, segs)),
b AS (SELECT *, sum(CASE WHEN coalesce({z}, 0) >= {SIGNIFICANT_Z} THEN 1 ELSE 0 END) OVER (PARTITION BY host, depth, above ORDER BY share, segs ROWS UNBOUNDED PRECEDING) AS branch FROM g),
m AS (SELECT host, segs, sum(bad) OVER q AS bad_m, sum(labelled) OVER q AS labelled_m FROM b WINDOW q AS (PARTITION BY host, depth, above, branch)),
j AS (SELECT k.host, k.segs, CASE WHEN (coalesce(bad_m, bad) + 1) / (coalesce(labelled_m, labelled) + 2) >= {MIN_PURITY} THEN 'block' ELSE 'allow' END AS own FROM k LEFT JOIN m ON k.host = m.host AND k.segs = m.segs)
SELECT page_id, x.host, path, rule, coalesce(rule_verdict, own) AS verdict, '/' || array_to_string(l.segs, '/') AS template
FROM x JOIN l{MAX_DEPTH + 1} l ON x.host = l.host AND x.lexical = l.lexical JOIN j ON l.host = j.host AND l.segs = j.segs
"""


OP9_SQL = _op9_sql()

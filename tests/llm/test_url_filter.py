import math
import random
import re
from collections import defaultdict

from stonefold.llm import url_filter as u

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules=u.RULES):
    fits = []
    for verdict, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), verdict == "block", text, verdict))
    return max(fits)[2:] if fits else (None, None)


def general(s):
    if re.fullmatch("[0-9]+", s):
        return "{n}"
    if re.fullmatch(r"[0-9]+\.[A-Za-z]+", s):
        return "{n}" + s[s.index(".") :]
    return "{x}" if re.fullmatch("[0-9a-fA-F-]{8,}", s) else "{d}" if re.search("[0-9]", s) else s


def brute(pages):
    rows = [(i, *split(url)) for i, url in pages]
    tree = defaultdict(lambda: [0, 0])
    lex = []
    for _, host, path in rows:
        parts = path[1:].split("/") if path else []
        segs = tuple(map(general, parts[: u.MAX_DEPTH])) + (("{tail}",) if len(parts) > u.MAX_DEPTH else ())
        lex.append((host, segs))
    current = {x: x[1] for x in lex}
    for d in range(max(map(len, current.values()), default=0)):
        kids = defaultdict(set)
        for (host, _), s in current.items():
            if len(s) > d:
                kids[host, s[:d]].add(s[d])
        current = {(h, k): s[:d] + ("*",) + s[d + 1 :] if len(s) > d and len(kids[h, s[:d]]) > u.MAX_CHILDREN else s for (h, k), s in current.items()}
    for (_, host, path), x in zip(rows, lex, strict=True):
        verdict = rule_of(host, path)[1]
        tree[host, current[x]][0] += verdict == "block"
        tree[host, current[x]][1] += verdict is not None
    families = defaultdict(list)
    for (host, s), (bad, n) in tree.items():
        if n >= u.MIN_LABELLED:
            families[host, len(s), s[:-1]].append((bad / n, s, bad, n))
    counts = {k: tuple(v) for k, v in tree.items()}
    for (host, _, _), some in families.items():
        groups, last = [], None
        for share, s, bad, n in sorted(some):
            z = 0.0
            if last:
                pooled = (last[1] + bad) / (last[2] + n)
                spread = math.sqrt(pooled * (1 - pooled) * (1 / last[2] + 1 / n))
                z = (share - last[0]) / spread if spread else 0.0
            if not groups or z >= u.SIGNIFICANT_Z:
                groups.append([])
            groups[-1].append((s, bad, n))
            last = (share, bad, n)
        for g in groups:
            for s, _, _ in g:
                counts[host, s] = (sum(x[1] for x in g), sum(x[2] for x in g))
    out = []
    for (i, host, path), x in zip(rows, lex, strict=True):
        rule, verdict = rule_of(host, path)
        bad, n = counts[host, current[x]]
        own = "block" if (bad + 1) / (n + 2) >= u.MIN_PURITY else "allow"
        out.append((i, host, path, rule, verdict or own, "/" + "/".join(current[x])))
    return sorted(out, key=str)


URLS = [None, "", "no scheme", "http://", "http://NET", "https://net/", "http://a.NET/en/1", "http://x.example.net/en/5?q#f", "http://example.com/de", "http://example.com/de/9", "http://notexample.com/de/9", "http://w.org/fr/", "http://É.org/fr/Ä", "a://b://c/d", "http://h?x/y", "http://h#/y", "http://h/" + "d/" * 30 + "e", "http://h/\nx"]


def test_judge_equals_brute_force(spark):
    rng = random.Random(4)
    pages = list(enumerate(URLS))
    pages += [(100 + i, f"http://{rng.choice(['a.example.com', 'b.net', 'c.org', 'd.fr'])}/{rng.choice(['de', 'en', 'fr', 'xx'])}/{rng.choice(['1', 'a1', 'q.html', '7.html', 'deadbeef99', rng.choice('abcdefgh') * rng.randrange(1, 15)])}") for i in range(1500)]
    # a branch that is blocked nearly always, with pages that no rule covers
    pages += [(5000 + i, "http://example.com/de/" + "".join(rng.choices("abcdefgh", k=6))) for i in range(200)] + [(None, "http://example.com/de/x"), (None, "http://example.com/de/x")]
    df = spark.createDataFrame([(i, x, "h", 1, "r") for i, x in pages], "page_id long, url string, host string, path int, rule string").repartition(3)
    found = sorted((tuple(r)[:6] for r in u.judge(df).select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=str)
    assert found == brute(pages)
    assert u.judge(df.limit(0)).collect() == []


def test_templates_block_pages_that_no_rule_covers(spark):
    rows = [("h", ["p", "{n}"], True)] * 30 + [("h", ["p", "{n}"], None)] * 5 + [("h", ["q", "{n}"], None)] * 5 + [("h", ["p", "z"], False)] * 30
    found = {tuple(r.lexical): r.template_verdict for r in u.template_verdicts(spark.createDataFrame(rows, "host string, lexical array<string>, blocked boolean")).collect()}
    assert found == {("p", "{n}"): "block", ("q", "{n}"): "allow", ("p", "z"): "allow"}

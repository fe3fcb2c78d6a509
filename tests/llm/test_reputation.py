import math
import random

import pytest
from pyspark.sql import functions as F

from textguard.llm import reputation as RP

RULES = [
    RP.Rule("allow", "com"), RP.Rule("block", "example.com", "/en/"), RP.Rule("allow", "www.example.com", "/en/"),
    RP.Rule("block", "net", "/es/"), RP.Rule("block", "net", "/fr/"),
]
PAGES = "page_id bigint, url string"
OUTCOMES = "page_id bigint, bad int"


def slow_cut(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[at:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path[:stop]


def slow_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def slow_strength(children):
    """children: (parent, n, bad) of one level."""
    groups = {}
    for parent, n, bad in children:
        if n:
            groups.setdefault(parent, []).append((n, bad))
    between = within = free = rest = size = 0
    for rows in groups.values():
        pages, bads = sum(n for n, _ in rows), sum(b for _, b in rows)
        rate = bads / pages
        between += sum(n * (b / n - rate) ** 2 for n, b in rows)
        within += sum(n * (b / n) * (1 - b / n) for n, b in rows)
        free += len(rows) - 1
        rest += pages - len(rows)
        size += pages - sum(n * n for n, _ in rows) / pages
    if not free or not rest:
        return RP.LEAST_STRENGTH
    inside = within / rest
    spread = max(0, (between / free - inside) / (size / free))
    if spread < 1e-12:
        return RP.MOST_STRENGTH
    return min(max(inside / spread, RP.LEAST_STRENGTH), RP.MOST_STRENGTH)


def slow_verdicts(pages, outcomes):
    bad = {}
    for page, value in outcomes:
        if page is not None and value is not None:
            bad[page] = max(bad.get(page, 0), value)
    hosts = {slow_cut(u)[0]: [0, 0] for _, u in pages}
    for page, host in {(p, slow_cut(u)[0]) for p, u in pages}:
        if host and page in bad:
            hosts[host][0] += 1
            hosts[host][1] += bad[page]

    def up(host):
        labels = host.split(".")
        wide = 3 if ".".join(labels[-2:]) in RP.TWO_LABELS else 2
        return ".".join(labels[-wide:]), ".".join(labels[-wide + 1 :])

    domains, suffixes = {}, {}
    for host, (n, b) in hosts.items():
        d, s = up(host)
        for level, key in ((domains, (d, s)), (suffixes, s)):
            old = level.get(key, (0, 0))
            level[key] = (old[0] + n, old[1] + b)
    mean = (sum(b for _, b in suffixes.values()) + 0.5) / (sum(n for n, _ in suffixes.values()) + 1)
    w1 = slow_strength([("", *v) for v in suffixes.values()])
    w2 = slow_strength([(s, *v) for (_, s), v in domains.items()])
    w3 = slow_strength([(up(h)[0], *v) for h, v in hosts.items()])
    of_suffix = {s: (w1 * mean + b) / (w1 + n) for s, (n, b) in suffixes.items()}
    of_domain = {d: (w2 * of_suffix[s] + b) / (w2 + n) for (d, s), (n, b) in domains.items()}
    out = {}
    for host, (n, b) in hosts.items():
        m = (w3 * of_domain[up(host)[0]] + b) / (w3 + n)
        out[host] = (m, m - RP.DEVIATIONS * math.sqrt(m * (1 - m) / (w3 + n + 1)))
    rows = []
    for page, url in pages:
        host, path = slow_cut(url)
        rule = slow_rule(host, path)
        verdict = rule.action if rule else "block" if out[host][1] > RP.LIMIT else "allow"
        rows.append((page, host, path, rule.text if rule else None, verdict))
    return rows, out


def made_pages():
    rng = random.Random(5)
    rates = {f"h{i}.{'bad' if i % 4 == 0 else 'fine'}{i % 8}.org": 0.9 if i % 4 == 0 else 0.05 for i in range(24)}
    rates |= {"a.shop.co.uk": 0.8, "b.shop.co.uk": 0.8, "c.news.co.uk": 0.02, "www.example.com": 0.5, "x.net": 0.3}
    pages, outcomes, page = [], [], 0
    for host, rate in rates.items():
        for _ in range(400 if host == "h1.fine1.org" else rng.randint(1, 30)):
            tail = rng.choice(["/en/a?b#c", "/fr/x", "/es/", "", "?q=http://o.org/", "#x", "/EN/a"])
            pages.append((page, rng.choice(["http", "HTTPS"]) + "://" + rng.choice([host, host.upper()]) + tail))
            if rng.random() < 0.7:
                outcomes.append((page, int(rng.random() < rate)))
            page += 1
    # hosts without an outcome: in a bad domain, in a good one, in none
    pages += [(9001, "http://new.bad0.org/"), (9002, "http://new.fine1.org/"), (9003, "http://alone.dev/")]
    pages += [(None, "http://h0.bad0.org/n"), (9004, None), (9005, "no scheme"), (9006, "://x.net/fr/ü"), (9007, "http:///p")]
    pages += [pages[0], pages[0], (9008, "http://h0.bad0.org/" + "p" * 200_000)]
    outcomes += [(None, 1), (9001, None), outcomes[0], (77777, 1)]
    return pages, outcomes


def test_urls_match_the_plain_rules(spark):
    pages, outcomes = made_pages()
    got = RP.judge_urls(
        spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(outcomes, OUTCOMES), RULES
    ).select("page_id", "host", "path", "rule", "verdict")
    want, _ = slow_verdicts(pages, outcomes)
    key = repr
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    free = {(r[1], r[4]) for r in want if r[3] is None}
    assert ("new.bad0.org", "block") in free and ("new.fine1.org", "allow") in free and ("", "allow") in free
    assert ("a.shop.co.uk", "block") in free and ("c.news.co.uk", "allow") in free


def test_posteriors(spark):
    pages, outcomes = made_pages()
    rows = RP.reputations(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUTCOMES)).collect()
    _, want = slow_verdicts(pages, outcomes)
    assert {r.host for r in rows} == set(want)
    for r in rows:
        assert (r.mean, r.lower) == pytest.approx(want[r.host])


def test_strength_finds_the_prior_that_made_the_rates(spark):
    """Rates drawn from a beta with 20 pages' weight give a strength near 20."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        rate = rng.betavariate(4, 16)
        rows.append((i, 30, sum(rng.random() < rate for _ in range(30))))
    frame = spark.createDataFrame(rows, "host int, n bigint, bad bigint").withColumn("all", F.lit(1))
    assert RP.strength(frame, "all").first()[0] == pytest.approx(20, rel=0.15)
    assert RP.strength(frame.limit(0), "all").first()[0] == RP.LEAST_STRENGTH


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com", "com", "u:p@m.x.org:80", "10.0.0.1:99", "[::1]", "deep.a.b.net.", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = RP.domain_levels(F.col("host"))
    got = {r.host: (r.d, r.s) for r in rows.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "com": ("com", "com"),
        "u:p@m.x.org:80": ("x.org", "org"), "10.0.0.1:99": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"),
        "deep.a.b.net.": ("b.net", "net"), "": ("", ""),
    }


def test_columns_empty_tables_and_no_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/", "x", 5, "r")], PAGES + ", `odd.name` string, Host int, _host string")
    none = spark.createDataFrame([], OUTCOMES)
    done = RP.judge_urls(pages, none, [])
    assert done.columns == ["page_id", "url", "odd.name", "_host", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in done.collect()] == [(1, "http://a.b.org/", "x", "r", "a.b.org", "/", None, "allow")]
    assert RP.judge_urls(pages.limit(0), none, RULES).count() == 0


def test_a_hot_host_can_be_split(spark):
    """With broadcasts off the join by host is split where one host has most of the pages."""
    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        url = F.concat(F.lit("http://h"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 97), F.lit(".org/p"), F.col("id"))
        pages = spark.range(0, 20000, 1, 8).select(F.col("id").alias("page_id"), url.alias("url"))
        done = RP.judge_urls(pages, pages.selectExpr("page_id", "page_id % 5 = 0 as bad"), RULES)
        assert done.toPandas().shape[0] == 20000
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

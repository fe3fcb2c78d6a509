"""URL filters: rules first, then the host's reputation by empirical Bayes.

Host and path are cut from the url; of the rules that fit, the longest decides. Where none does,
the host is judged by the labelled outcomes of its pages:

1. Each distinct (page, host) with an outcome counts once, bad or good, and the counts are summed
   by host, registered domain and suffix.
2. At each level the children's rates are taken as draws from a beta distribution around their
   parent's mean. How much they differ (the intraclass correlation of the beta-binomial, by
   moments, all parents of a level pooled) gives the prior's strength in pages.
3. The suffix is shrunk to all pages, the domain to its suffix, the host to its domain, so that a
   host without labelled pages stands where its domain stands.
4. A host is blocked where the lower bound of its posterior rate of bad pages (mean less ``z``
   standard deviations of the beta posterior) is above ``limit``.

All of it is DataFrame code. Hosts, domains and suffixes are written tables, so that the join of a
host with very many pages, or of a domain with very many hosts, can be split; pages are reduced to
distinct pairs before they meet the outcomes.

A NULL url, or one without ``://``, has an empty host and path; an empty host has no outcomes and
is judged by the mean of all pages. A NULL ``page_id`` has no outcome. Several outcomes of a page
count as one, bad if any is; a NULL outcome is none. Repeated rows all stay. Without outcomes the mean is
one half with hardly any weight, whose lower bound blocks nothing at the given limit. An empty table
gives an empty table. Other columns pass through unless they carry the names of new columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.scratch import written

ALLOW, BLOCK = "allow", "block"
#: A rate of bad pages that a host must exceed with the posterior's lower bound to be blocked.
LIMIT = 0.3
#: Standard deviations from the posterior's mean to its bound: nine tenths lie above.
DEVIATIONS = 1.2816
#: Pages that a prior counts for: at least (also where nothing can be learned), and at most (also
#: where children do not differ).
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
NEW = ("host", "path", "rule", "verdict")

# --- fixed values: public suffixes of two labels that are told from domains; any other
# suffix is the last label -------------------------------------------------------------
TWO_LABELS = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au",
    "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "edu.au", "gov.au",
    "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
# ----------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def deciding(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """``text`` or ``action`` of the longest rule that fits, else NULL; of equally long ones that
    of the longer host, then a block. Rules are a setting: each is a term of the expression."""
    order = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.action != BLOCK, r.text))
    terms = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, what)))
        for r in order
    ]
    return F.coalesce(*terms, F.lit(None).cast("string"))


def domain_levels(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> tuple[Column, Column]:
    """``(domain, suffix)`` of a host; user names, ports and final dots are left aside, and an
    address of digits is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")
    address = bare.rlike(r"^[0-9.]+$|^\[")
    two = F.substring_index(bare, ".", -2)
    double = two.isin(*two_labels) if two_labels else F.lit(False)
    suffix = F.when(double, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(double, F.substring_index(bare, ".", -3)).otherwise(two)
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def counted(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, domain, suffix, n, bad)`` of every host: its labelled pages, and the bad ones."""
    seen = pages.select(F.col("page_id").alias("_page"), host_of(F.col("url")).alias("host")).distinct()
    known = (
        outcomes.where("page_id is not null and bad is not null")
        .groupBy(F.col("page_id").alias("_page"))
        .agg(F.max(F.col("bad").cast("int")).alias("_bad"))
    )
    found = F.col("_bad").isNotNull() & (F.col("host") != "")
    by_host = seen.join(known, "_page", "left").groupBy("host").agg(
        F.count_if(found).alias("n"), F.coalesce(F.sum(F.when(found, F.col("_bad"))), F.lit(0)).alias("bad")
    )
    domain, suffix = domain_levels(F.col("host"))
    return by_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")


def strength(children: DataFrame, parent: str | None) -> DataFrame:
    """One row, one value: the pages that a prior counts for, from the children's ``(n, bad)``."""
    n, bad = F.col("n"), F.col("bad")
    square = bad * bad / n
    groups = children.where(n > 0).groupBy(*([parent] if parent else [])).agg(
        F.sum(n).alias("pages"),
        F.count("*").alias("k"),
        F.sum(n * n).alias("squares"),
        (F.sum(square) - F.sum(bad) * F.sum(bad) / F.sum(n)).alias("between"),
        F.sum(bad - square).alias("within"),
    )
    pooled = groups.agg(
        F.sum("between").alias("between"),
        F.sum("within").alias("within"),
        F.sum(F.col("k") - 1).alias("free"),
        F.sum(F.col("pages") - F.col("k")).alias("rest"),
        F.sum(F.col("pages") - F.col("squares") / F.col("pages")).alias("size"),
    )
    inside = F.try_divide("within", "rest")
    spread = F.greatest(
        F.lit(0.0), F.try_divide(F.try_divide("between", "free") - inside, F.try_divide("size", "free"))
    )
    # the correlation is spread / (spread + inside), the strength one over it, less one
    pages = F.when((F.col("free") > 0) & (F.col("rest") > 0), F.coalesce(F.try_divide(inside, spread), F.lit(MOST_STRENGTH)))
    bounded = F.least(F.greatest(F.coalesce(pages, F.lit(LEAST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    return pooled.select(bounded.alias("strength"))


def shrunk(prior: Column, weight: Column) -> Column:
    """The posterior's mean."""
    return (weight * prior + F.col("bad")) / (weight + F.col("n"))


def reputations(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """``(host, mean, lower, weight, blocked)`` for every host of ``pages(page_id, url)``."""
    hosts = written(counted(pages, outcomes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(domains, "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = written(suffixes, "suffixes")
    everything = suffixes.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mean")
    )

    rated = suffixes.withColumn("_w", strength(suffixes, None).scalar()).withColumn("_m", everything.scalar())
    rated = written(rated.select("suffix", shrunk(F.col("_m"), F.col("_w")).alias("_mean")), "suffix-means")
    nested = domains.join(rated, "suffix").withColumn("_w", strength(domains, "suffix").scalar())
    nested = written(nested.select("domain", shrunk(F.col("_mean"), F.col("_w")).alias("_mean")), "domain-means")
    leaf = hosts.join(nested, "domain").withColumn("_w", strength(hosts, "domain").scalar())
    judged = leaf.select("host", shrunk(F.col("_mean"), F.col("_w")).alias("mean"), (F.col("_w") + F.col("n")).alias("weight"))
    mean = F.col("mean")
    lower = mean - F.lit(deviations) * F.sqrt(mean * (1 - mean) / (F.col("weight") + 1))
    return judged.select("host", "mean", lower.alias("lower"), "weight", (lower > limit).alias("blocked"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """The rows of ``pages(page_id, url, …)`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``outcomes(page_id, bad)`` holds the labelled pages, ``bad`` a boolean or 0 and 1.
    """
    url = F.col("url")
    hosts = written(reputations(pages, outcomes, limit, deviations).select(F.col("host").alias("_host"), "blocked"), "verdicts")
    row = F.struct(*others(pages, *NEW)).alias("_row")
    cut = pages.select(row, host_of(url).alias("_host"), path_of(url).alias("_path"))
    host, path = F.col("_host"), F.col("_path")
    ruled = cut.select(
        "_row", "_host", "_path",
        deciding(rules, host, path, "text").alias("_rule"), deciding(rules, host, path, "action").alias("_action"),
    )
    by_host = F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    return ruled.join(hosts, "_host").select(
        "_row.*", host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_action", by_host).alias("verdict"),
    )

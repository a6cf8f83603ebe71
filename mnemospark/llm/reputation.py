"""URL filtering by rules and by empirical-Bayes host reputation (DataFrame functions only).

Outcomes of labelled pages are counted by host, registered domain and suffix. A beta prior for the suffixes comes from
all outcomes, one for the domains from their suffix, one for the hosts from their domain; each level's strength is the
beta-binomial moment estimate from the spread between its units. A host is blocked if even the upper posterior bound of
its share of good pages lies below the threshold; the bound is mean + z * deviation of the beta posterior, the normal
approximation of its quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: host, path, verdict of each rule (fixed values of the contract).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocked if mean + Z * deviation of the good share is below FLOOR.
Z = 1.645
FLOOR = 0.5
LEAST_SPREAD, MOST_SPREAD = 1e-3, 0.9


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls if none does. A rule fits its host and all subdomains."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


#: Suffixes of two labels under which domains are registered; all other suffixes are the last label. Pass a fuller table
#: where it matters.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "net.nz", "org.nz", "co.za", "org.za",
    "ac.jp", "co.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "com.cn", "edu.cn", "net.cn", "org.cn", "com.hk", "com.tw", "com.sg", "com.my", "co.id", "co.in", "net.in", "org.in", "co.il", "co.th",
    "com.br", "net.br", "org.br", "com.ar", "com.mx", "com.co", "com.tr", "com.ua", "com.pl", "co.at",
)


def public_suffix(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels of a host where these are a suffix, else the last one."""
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*two_labels), last).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """One label more than the suffix (all, if there are no more)."""
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(last)


def _strengths(*levels: DataFrame) -> list[tuple[float, float]]:
    """Overall mean and prior strength of each level's units ``(n, good)``, the beta-binomial moment estimates, in one job."""
    sums = None
    for k, units in enumerate(levels):
        n, good = F.col("n").cast("double"), F.col("good").cast("double")
        one = units.agg(F.lit(k).alias("level"), F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(n * n).alias("squares"), F.sum(good * good / n).alias("spread"))
        sums = one if sums is None else sums.union(one)
    out = []
    for r in sorted(sums.collect(), key=lambda r: r.level):
        if not r.n:
            out.append((0.5, 2.0))
            continue
        p = r.good / r.n
        between = r.spread - 2 * p * r.good + p * p * r.n
        room = p * (1 - p) * (r.n - r.squares / r.n - (r.k - 1))
        spread = (between - p * (1 - p) * (r.k - 1)) / room if room > 0 else LEAST_SPREAD
        spread = min(max(spread, LEAST_SPREAD), MOST_SPREAD)
        out.append((p, (1 - spread) / spread))
    return out


def host_reputation(outcomes: DataFrame, z: float = Z, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``(host, n, good, mean, low, high)`` from ``(host, good)`` rows, good being 0, 1 or null (not labelled).

    Hosts without labelled rows have n = good = 0 and the mean of their domain, else of their suffix, else of all. The
    counts per host are written once; what follows reads only them.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host"), two_labels), "suffix": public_suffix(F.col("host"), two_labels)})
    hosts = materialize(hosts, "url-hosts")
    labelled = hosts.filter("n > 0")
    domains = labelled.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    (p, ks), (_, kd), (_, kh) = _strengths(suffixes, domains, labelled)
    suffixes = suffixes.select("suffix", ((F.col("good") + p * ks) / (F.col("n") + ks)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("good") + F.col("suffix_mean") * kd) / (F.col("n") + kd)).alias("domain_mean"))
    placed = hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left")
    above = F.coalesce("domain_mean", "suffix_mean", F.lit(float(p)))
    total = F.col("n") + kh
    mean = (F.col("good") + above * kh) / total
    wide = z * F.sqrt(mean * (1 - mean) / (total + 1))
    return placed.select("host", "n", "good", mean.alias("mean"), (mean - wide).alias("low"), (mean + wide).alias("high"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, floor: float = FLOOR, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's posterior bounds.

    A label belongs to the page whose page_id equals its doc_id; it is good if quality is 1 and toxic is not 1, and does
    not count if quality is null. Without a fitting rule the host's bound decides; hosts without labelled pages have that
    of their domain, suffix or all. Null or malformed urls have an empty host, which is a host like others. Repeated page
    ids stay; several labels of a page all count; no pages give no rows. The joins are on narrow rows and can be split by
    adaptive execution where one host has many pages.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")
    marked = labels.select(F.col("doc_id").alias("_id"), F.when(F.col("quality").isNotNull(), good).alias("good"))
    outcomes = parsed.select("page_id", "host").join(marked, F.col("page_id") == F.col("_id"), "left").select("host", "good")
    known = host_reputation(outcomes, z, two_labels).select(F.col("host").alias("_host"), "low", "high")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "_says": says}).join(known, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("high") < floor, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_says", method).alias("verdict"), "low", "high")

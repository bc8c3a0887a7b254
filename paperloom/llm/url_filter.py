"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts.

Pages that a rule decides are labelled outcomes. A block rule also speaks for what it spares: pages of
its hosts whose path it doesn't fit are outcomes too, unblocked ones, or else hosts that only block
rules fit could have no other rate than one. Block rates are shrunk level by level
through beta-binomial priors: all pages, public suffix, registered domain, host. A group's prior
has its parent's posterior mean, and a variance that adds the spread of the level to what is
unknown of the parent; so without outcomes of its own or its kin, a host's rate stays wide open.
A host is blocked when the lower bound of its posterior block rate passes a threshold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts alike.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Posterior mean less Z standard deviations must pass THRESHOLD to block: more than a fifth of the host's pages are bad, surely.
Z = 1.645
THRESHOLD = 0.2
#: Bounds of the correlation inside a group, so of the prior's strength 1 / rho - 1.
MIN_RHO, MAX_RHO = 0.01, 0.9


#: Public suffixes of two labels; any other last label is a suffix of its own. A small table of common ones.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
    "com.tr", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.nz", "org.uk",
)
#: Addresses have no domain: they share a suffix, and each is a domain of its own.
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])\z"
ADDRESSES = "(address)"
#: What a host has round its name: a user, a port, dots at its end.
ROUND_NAME = (r"^.*@", r":\d*\z", r"\.+\z")


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end; A-Z lower-cased. Null or no ://: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits (of equal lengths, the longer host)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def spared(host: Column, path: Column, rules=RULES) -> Column:
    """Whether a block rule fits the host, but not the path."""
    out = F.lit(False)
    for said, name, prefix in rules:
        if said == "block":
            out = out | (((host == name) | host.endswith(f".{name}")) & ~path.startswith(prefix))
    return out


def name_parts(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain of a host."""
    name = host
    for pattern in ROUND_NAME:
        name = F.regexp_replace(name, pattern, "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    address, double = name.rlike(ADDRESS), last(2).isin(*suffixes)
    suffix = F.when(address, ADDRESSES).when(double, last(2)).otherwise(last(1))
    return suffix, F.when(address, name).when(double, last(3)).otherwise(last(2))


def _shrunk(groups: DataFrame, parent: str) -> DataFrame:
    """Adds mean, var and bound of each group's block rate, its prior coming from <parent>_mean and <parent>_var.

    One strength for the level, from the spread of its rates round their parents' means.
    """
    mean = F.least(F.greatest(F.col(f"{parent}_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
    seen = F.col("n") > 0
    rate = F.when(seen, F.col("k") / F.col("n"))
    spread = F.sum(F.when(seen, F.col("n") * (rate - mean) * (rate - mean) / (mean * (1 - mean))))
    count, total = F.sum(seen.cast("long")), F.sum("n")
    level = groups.agg(F.when(total > count, (spread - count) / (total - count)).alias("rho"))
    rho = F.least(F.greatest(F.coalesce(F.round("rho", 6), F.lit(MAX_RHO)), F.lit(MIN_RHO)), F.lit(MAX_RHO))
    unknown = F.col(f"{parent}_var")
    widest = mean * (1 - mean)
    # One row, an aggregate without keys: safe to broadcast at any size of the input.
    return (
        groups.crossJoin(F.broadcast(level.select(rho.alias("rho"))))
        .withColumn("prior_var", F.least((widest - unknown) * F.col("rho") + unknown, widest * 0.999))
        .withColumn("strength", widest / F.col("prior_var") - 1)
        .withColumn("mean", (F.col("strength") * mean + F.col("k")) / (F.col("strength") + F.col("n")))
        .withColumn("var", F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + F.col("n") + 1))
        .withColumn("bound", F.col("mean") - Z * F.sqrt("var"))
        .drop("rho", "prior_var", "strength")
    )


def host_reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """From rows (host, bad, labelled): one row per host with its number of rows, and n, k, mean and bound of its block rate."""
    suffix, domain = name_parts(F.col("host"), suffixes)
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("*").alias("rows"), F.sum(F.col("labelled").cast("long")).alias("n"), F.sum((F.col("labelled") & F.col("bad")).cast("long")).alias("k"))
        .withColumn("domain", domain)
        .withColumn("suffix", suffix)
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total, mean = F.coalesce(F.sum("n"), F.lit(0)), (F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)
    overall = suffixes.agg(mean.alias("all_mean"), total.alias("all_n")).select("all_mean", (F.col("all_mean") * (1 - F.col("all_mean")) / (F.col("all_n") + 3)).alias("all_var"))
    named = lambda rows, key: rows.select(key, F.col("mean").alias(f"{key}_mean"), F.col("var").alias(f"{key}_var"))
    suffixes = named(_shrunk(suffixes.crossJoin(F.broadcast(overall)), "all"), "suffix")
    domains = named(_shrunk(domains.join(suffixes, "suffix"), "suffix"), "domain")
    return _shrunk(hosts.join(domains, "domain"), "domain").select("host", "rows", "n", "k", "mean", "bound")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD, suffixes=SUFFIXES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A null url or one without :// has an empty host and path; no rule fits, and the empty host is
    judged by its prior. Repeated rows are judged alike and count as outcomes each. Null ids pass
    through, other columns are not read, and an empty table gives an empty result. suffixes are the
    public suffixes of two labels. A very long url costs its length; hosts with very many pages don't
    meet in one task (spread_join), and what is kept of a host is one row.
    """
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("rule", rule).withColumn("said", said)
    told = F.col("said").isNotNull() | spared(F.col("host"), F.col("path"), rules)
    outcomes = judged.select("host", told.alias("labelled"), F.coalesce(F.col("said") == "block", F.lit(False)).alias("bad"))
    reputation = host_reputation(outcomes, suffixes).select("host", "rows", (F.col("bound") > threshold).alias("bad_host"))
    by_host = F.when(F.col("bad_host"), "block").otherwise("allow")
    return spread_join(judged, written(reputation, "hosts"), "host", "rows").select("page_id", "host", "path", "rule", F.coalesce("said", by_host).alias("verdict"))


def _level_sql(groups: str, parent: str) -> str:
    m, v = f"least(greatest({parent}_mean, 1e-6), 1 - 1e-6)", f"{parent}_var"
    rho = f"""least(greatest(coalesce(round(CASE WHEN sum(n) > sum((n > 0)::INT) THEN
        (sum(CASE WHEN n > 0 THEN n * (k / n - {m}) * (k / n - {m}) / ({m} * (1 - {m})) END) - sum((n > 0)::INT)) / (sum(n) - sum((n > 0)::INT)) END, 6), {MAX_RHO}), {MIN_RHO}), {MAX_RHO})"""
    return f"""(SELECT *, mean - {Z} * sqrt(var) AS bound FROM (SELECT *, mean * (1 - mean) / (s + n + 1) AS var FROM (SELECT *, (s * {m} + k) / (s + n) AS mean FROM (
      SELECT *, {m} * (1 - {m}) / least(({m} * (1 - {m}) - {v}) * rho + {v}, {m} * (1 - {m}) * 0.999) - 1 AS s FROM {groups}, (SELECT {rho} AS rho FROM {groups})))))"""


def oracle_sql(rules=RULES) -> str:
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"{f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    said = " ".join(f"{f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    spares = " OR ".join(f"((host = '{h}' OR ends_with(host, '.{h}')) AND NOT starts_with(path, '{p}'))" for v, h, p in rules if v == "block")
    name = "host"
    for pattern in ROUND_NAME:
        name = f"regexp_replace({name}, '{pattern}', '')"
    double = f"array_to_string(labels[-2:], '.') IN ({', '.join(repr(x) for x in SUFFIXES)})"
    address = f"regexp_matches(name, '{ADDRESS}')"
    return rf"""
WITH named AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM named),
counted AS (SELECT host, sum((said IS NOT NULL OR {spares})::INT)::DOUBLE AS n, sum((said IS NOT NULL AND said = 'block')::INT)::DOUBLE AS k FROM judged GROUP BY host),
split AS (SELECT *, string_split(name, '.') AS labels FROM (SELECT *, {name} AS name FROM counted)),
hosts AS (SELECT host, n, k, CASE WHEN {address} THEN '{ADDRESSES}' WHEN {double} THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix,
                 CASE WHEN {address} THEN name WHEN {double} THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM split),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
overall AS (SELECT all_mean, all_mean * (1 - all_mean) / (all_n + 3) AS all_var FROM (SELECT (sum(k) + 1) / (sum(n) + 2) AS all_mean, sum(n) AS all_n FROM suffixes)),
suffixes1 AS (SELECT * FROM suffixes, overall),
suffixes2 AS (SELECT suffix, mean AS suffix_mean, var AS suffix_var FROM {_level_sql("suffixes1", "all")}),
domains1 AS (SELECT * FROM domains JOIN suffixes2 USING (suffix)),
domains2 AS (SELECT domain, mean AS domain_mean, var AS domain_var FROM {_level_sql("domains1", "suffix")}),
hosts1 AS (SELECT * FROM hosts JOIN domains2 USING (domain)),
hosts2 AS (SELECT host, bound > {THRESHOLD} AS bad_host FROM {_level_sql("hosts1", "domain")})
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hosts2 USING (host)"""

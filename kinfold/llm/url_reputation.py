"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. Each host's bad rate has a beta-binomial posterior whose prior
is the posterior mean of its registered domain, whose prior is that of its suffix, whose prior is the overall rate. The
strength of each level's prior is estimated from the data: the method of moments on the rates of its children,
within ``STRENGTH``. A page of a host is blocked if the lower posterior bound of the bad rate (mean - Z * standard
deviation) exceeds ``MAX_BAD``; so little evidence never blocks. Explicit rules come first.

All levels are DataFrame aggregations and equi-joins over hosts, not pages; pages are joined once, to their hosts, and
that join is a plain one, so a host with a third of all pages is split by adaptive execution.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, no domain; it takes the verdict
of the empty host like any other host. Repeated page rows are judged alike, and a page counts once as evidence per
row. Pages without a label are no evidence. An empty ``labels`` table gives an overall rate of 0: nothing is blocked.
A registered domain is the last two host labels, or three if the last two are in ``SHARED_SUFFIXES``; a host of
digits and dots is its own domain; the port and user parts do not matter to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize

#: (verdict, host, path): a rule fits its host and the subdomains, and paths that start with its path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
# Suffixes of two labels below which anyone registers.
SHARED_SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk"]

MAX_BAD = 0.3
Z = 1.645
STRENGTH = (2.0, 200.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, lowered).otherwise(""), F.when(has, path).otherwise("")


def matching_rule(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Equal lengths: the longer host."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    shared = F.substring_index(name, ".", -2).isin(SHARED_SUFFIXES)
    numeric = name.rlike(r"^[\d.]+$")
    domain = F.when(numeric, name).when(shared, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(numeric, "").when(shared, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def _strength(children: DataFrame, overall: float) -> float:
    """Moment estimate of a level's prior strength from its children (n, bad, prior): one row of sums.

    The variance of the children's rates about their priors, less the binomial noise, is the beta prior's variance;
    the smaller it is, the stronger the prior.
    """
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    spread = F.sum(n * (rate - F.col("prior")) * (rate - F.col("prior"))) / F.sum(n)
    noise = F.sum(F.lit(overall * (1 - overall))) / F.sum(n)
    row = children.filter("n > 0").agg((spread - noise).alias("excess")).first()
    low, high = STRENGTH
    if row.excess is None or row.excess <= 0:
        return high
    return min(max(overall * (1 - overall) / row.excess - 1, low), high)


def _shrunk(children: DataFrame, overall: float) -> tuple[DataFrame, float]:
    """Adds ``mean``, the posterior mean under the beta prior of mean ``prior``; also the prior's strength."""
    k = _strength(children, overall)
    return children.withColumn("mean", (F.col("bad") + F.col("prior") * k) / (F.col("n") + k)), k


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad, prior, mean, low): posterior of each host's bad rate and its lower bound.

    ``labels`` (doc_id, quality, toxic) describe the page of the same id; low quality or toxic is bad, a null label
    part is no sign of it. Several labels of a page count each.
    """
    host, _ = split_url(F.col("url"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    domain, suffix = registered_domain(F.col("host"))
    hosts = materialize(
        pages.select("page_id", host.alias("host"))
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = total.bad / total.n if total.n else 0.0
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes, _ = _shrunk(domains.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(overall)), overall)
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains, _ = _shrunk(domains, overall)
    hosts, k = _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), overall)
    mean, weight = F.col("mean"), F.col("n") + k
    return hosts.withColumn("low", mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))).select(
        "host", "n", "bad", "prior", "mean", "low"
    )


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    blocked = host_reputation(pages, labels).filter(F.col("low") > MAX_BAD).select("host", F.lit(True).alias("blocked"))
    judged = judged.join(blocked, "host", "left").withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict")
    )

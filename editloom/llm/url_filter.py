"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level's rate is shrunk to
the level above through a beta prior whose strength is estimated from the spread of the rates on that level (method of
moments). A page is blocked when the lower bound of its host's posterior bad rate is over a limit. Listed rules come
before the reputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pass_rows, stage

# The rules, as action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Reputation:
    """Parameters of the reputation: block when mean - z * deviation of the posterior is over limit."""
    limit: float = 0.3
    z: float = 1.0
    #: Bounds of a prior's strength, in pages.
    least: float = 2.0
    most: float = 200.0


def host_of(url: Column) -> Column:
    """Host between :// and the next slash, question mark or hash, A-Z lower-cased; empty without ://, null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path after the host, up to a question mark or hash; empty without ://, null counts as empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """Last two labels of the host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls where none does."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def _shrunk(stats: DataFrame, own: Reputation) -> DataFrame:
    """Posterior mean and strength of each row of (n, bad, prior): prior strength from the spread of the rates.

    The strength is mean * (1 - mean) / variance - 1 with page-weighted moments, held within bounds; one value per level."""
    gap = F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    moments = stats.where("n > 0").agg((F.sum("bad") / F.sum("n")).alias("mean"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("spread"),
                                       (F.count("*") / F.sum("n")).alias("noise"))
    inner = F.col("mean") * (1 - F.col("mean"))
    true = F.greatest(F.col("spread") - inner * F.col("noise"), F.lit(0.0))
    raw = F.coalesce(F.when(true > 0, inner / true - 1), F.lit(own.most))
    n, s = F.col("n"), F.lit(moments.select(F.least(F.greatest(raw, F.lit(own.least)), F.lit(own.most))).first()[0])  # one number
    return stats.select("*", ((F.col("bad") + F.col("prior") * s) / (n + s)).alias("mean"), (n + s).alias("weight"))


def reputation(pages: DataFrame, own: Reputation = Reputation()) -> DataFrame:
    """(host, bad_rate, bound, blocked) for every host of ``pages`` (host, bad), bad being 1, 0 or null for no label.

    Hosts without labels take the posterior of their domain, and so on upwards. Pages are counted within each task first,
    so a host with a third of all pages is no hot key."""
    count = [F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    hosts = pages.groupBy("host").agg(*count).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = stage(hosts, "url-hosts")
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stage(hosts.groupBy("domain", "suffix").agg(*total), "url-domains")
    suffixes = domains.groupBy("suffix").agg(*total)
    every = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]
    top = _shrunk(suffixes.select("*", F.lit(every).alias("prior")), own)
    middle = _shrunk(domains.join(top.select("suffix", F.col("mean").alias("prior")), "suffix"), own)
    low = _shrunk(hosts.join(middle.select("domain", F.col("mean").alias("prior")), "domain"), own)
    mean = F.col("mean")
    bound = mean - own.z * F.sqrt(mean * (1 - mean) / (F.col("weight") + 1))
    return low.select("host", mean.alias("bad_rate"), bound.alias("bound"), (bound > own.limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, own: Reputation = Reputation(), rules=RULES) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict, and the host's bad_rate and bound.

    ``outcomes``: (page_id, bad) with bad 1 or 0; null values are no label, a page labelled more than once takes the worst
    outcome. A null url, or one without ://, has an empty host, which is judged like any other. Each row of ``pages``
    gives one row, repeated ones too."""
    worst = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    own_rows = pass_rows(pages, {"page_id": F.col("page_id"), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = own_rows.join(worst, "page_id", "left")
    hosts = reputation(rows, own)
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    return own_rows.join(hosts, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        "bad_rate", "bound")

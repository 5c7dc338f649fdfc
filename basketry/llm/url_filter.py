"""URL filter with empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are added up per host, registered domain
and suffix. Each level is shrunk towards its parent through a beta prior whose
strength is estimated from the spread of the level's rates over all its
members (method of moments of the beta-binomial):

    all -> suffix -> registered domain -> host

A host is blocked when the lower bound of its posterior bad rate (mean minus
``z`` standard deviations of the beta posterior) is over ``max_bad``; few bad
pages are not enough, and hosts without labels have their domain's rate.
Explicit rules (host and path prefix; longest wins) go before the verdict of
the method.

Outcomes are counted per host with partial aggregation before the shuffle,
and a hot host's pages meet the host table in a join that AQE splits (or
broadcasts, by its measured size).

Null urls, or urls without ``://``, have an empty host and path and are judged
like a host without labels. A user part or port belongs to the host as given,
but not to its domain. Null outcomes are ignored; a page with several outcomes
is bad if one is. Repeated pages are judged each. Without any outcome nothing
is blocked by the method. An empty table gives an empty table. Clashing names:
only the columns named in the call are read, and the result has fixed names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: least and largest intra-class correlation that the moments may give
RHO = (1e-4, 0.99)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    """The public suffix: the last label, or the last two where ``long_suffixes`` lists them."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    out = F.when(_numeric(name), name)
    if long_suffixes:
        out = out.when(two.isin(*long_suffixes), two)
    return out.otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, long_suffixes: tuple[str, ...] = ()) -> Column:
    """The registered domain: the suffix and one more label."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    out = F.when(_numeric(name), name)
    if long_suffixes:
        out = out.when(two.isin(*long_suffixes), F.substring_index(name, ".", -3))
    return out.otherwise(two)


def _name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _numeric(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
            for r in sorted(rules, key=lambda r: -len(r.text))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _rho(children: DataFrame) -> float:
    """Intra-class correlation of children (n, bad) around their parents' rate m, by moments."""
    m, n, s = F.col("m"), F.col("n"), F.col("bad")
    v = m * (1 - m)
    row = children.where("n > 0").agg(
        F.sum((s - n * m) * (s - n * m)).alias("spread"), F.sum(n * v).alias("binomial"),
        F.sum(n * (n - 1) * v).alias("excess")).first()
    if not row["excess"]:
        return RHO[1]
    return min(max((row["spread"] - row["binomial"]) / row["excess"], RHO[0]), RHO[1])


def _shrunk(children: DataFrame, keys: list[str]) -> tuple[DataFrame, float]:
    """Posterior mean rate of each child, and the strength of its prior."""
    rho = _rho(children)
    k = 1 / rho - 1
    return children.select(*keys, ((F.lit(k) * F.col("m") + F.col("bad")) / (F.lit(k) + F.col("n"))).alias("m")), k


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645,
                    long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, bad, rate, bad_bound) of every host of ``pages`` (page_id, host).

    ``outcomes``: page_id, bad (0 or 1).
    """
    told = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = stored(
        pages.join(told, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes)), "url-hosts")

    def added(*keys):
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    total = added().first()
    m0 = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] is not None else 0.5
    suffix, _ = _shrunk(added("suffix").withColumn("m", F.lit(m0)), ["suffix"])
    domain, _ = _shrunk(added("suffix", "domain").join(suffix, "suffix"), ["domain", "suffix"])
    host = hosts.join(domain, ["domain", "suffix"])
    k = 1 / _rho(host) - 1
    a, b = F.lit(k) * F.col("m") + F.col("bad"), F.lit(k) * (1 - F.col("m")) + F.col("n") - F.col("bad")
    rate = a / (a + b)
    return host.select("host", "n", "bad", rate.alias("rate"),
                       (rate - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id",
                url_col: str = "url", max_bad: float = 0.5, z: float = 1.645,
                long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) of every page."""
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(judged.select("page_id", "host"), outcomes, z, long_suffixes)
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(by_rule)
    return (judged.join(known.select("host", "n", "bad_bound"), "host")
            .withColumn("rule", rule)
            .select("page_id", "host", "path", "rule",
                    F.coalesce(by_rule, F.when(F.col("bad_bound") > max_bad, F.lit("block")).otherwise(F.lit("allow")))
                    .alias("verdict"), "bad_bound"))

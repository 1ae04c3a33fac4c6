"""URL filter (method: empirical-Bayes host reputation), with rules that go first.

Outcomes of labelled pages (good or bad) are counted per host, registered domain and suffix. The bad rate of each has a beta prior around the posterior
mean of the level above it (all pages, suffix, domain, host), and the prior's weight in pages is estimated from how much the counts of that level vary
beyond binomial chance. So a host with few labelled pages is judged mostly by its domain, one with many by its own. A host is blocked if the lower
bound of its posterior bad rate exceeds a limit. Hosts without any labelled page have the posterior of the level above.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A host is blocked if its bad rate is surely above this.
MAX_BAD = 0.5
#: Standard deviations between the posterior mean and its bound.
Z = 1.645
#: Limits of the correlation of outcomes within a unit that the prior weights come from.
LEAST_RHO, MOST_RHO = 0.0001, 0.5


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty for null or without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels."""
    return F.substring_index(host, ".", -2)


def _posterior(units: DataFrame, mean: float | None) -> DataFrame:
    """Adds a and b of the beta posterior to units with n, bad and ``above`` (the posterior mean of the level above)."""
    rows = units if mean is None else units.withColumn("above", F.lit(mean))
    chance = F.col("above") * (1 - F.col("above"))
    extra = (F.col("bad") - F.col("n") * F.col("above")) ** 2 - F.col("n") * chance
    # Two sums over the level: how far counts vary beyond chance, and how far they would if pages of a unit were all alike.
    got = rows.agg(F.sum(extra).alias("extra"), F.sum(F.col("n") * (F.col("n") - 1) * chance).alias("most")).first()
    rho = (got["extra"] / got["most"]) if got["most"] else MOST_RHO
    weight = 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1
    return rows.withColumn("a", weight * F.col("above") + F.col("bad")).withColumn("b", weight * (1 - F.col("above")) + F.col("n") - F.col("bad"))


def reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of every host: ``hosts`` has one row per host with n labelled pages and bad ones among them; the result has host, mean, bound.

    Suffix, domain and host tables are small next to pages; one number per level goes to the driver.
    """
    rows = hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    everything = rows.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    # One page of each kind more, so that the overall rate is never 0 or 1.
    mean = ((everything["bad"] or 0) + 1) / ((everything["n"] or 0) + 2)
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    rate = (F.col("a") / (F.col("a") + F.col("b"))).alias("above")
    suffixes = _posterior(rows.groupBy("suffix").agg(*counts), mean).select("suffix", rate)
    domains = _posterior(rows.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix"), None).select("domain", rate)
    out = _posterior(rows.join(domains, "domain"), None)
    total = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return out.select("host", (F.col("a") / total).alias("mean"), (F.col("a") / total - Z * spread).alias("bound"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", outcome: str | None = None, max_bad: float = MAX_BAD) -> DataFrame:
    """Host, path, rule and verdict of every page: the columns of ``pages`` and these four, which replace columns of these names.

    ``rules`` has host, path and verdict (allow or block); a rule fits its host and all subdomains if the path starts with the rule's, and of several the
    longest text of host and path wins (ties: by text). ``outcome`` names a column with 1 for bad pages, 0 for good ones, null for unlabelled ones.
    A null URL, or one without ``://``, has an empty host and path and is judged like the pages of any other host.
    """
    host, path = split_url(url)
    own = {f"own{i}": c for i, c in enumerate(pages.columns) if c not in ("host", "path", "rule", "verdict")}
    bad = F.lit(None).cast("int") if outcome is None else F.col(f"`{outcome}`").cast("int")
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], host.alias("host"), path.alias("path"), bad.alias("bad"))
    hosts = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))

    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, labels + 1)]))
    given = rules.select(F.col("host").alias("end"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"),
                                                             F.col("path").alias("path"), F.col("verdict").alias("verdict")).alias("r"))
    # Rules meet distinct hosts, not pages.
    fitting = hosts.select("host", F.explode(ends).alias("end")).join(given, "end").groupBy("host").agg(F.collect_list("r").alias("rules"))
    known = reputation(hosts).join(fitting, "host", "left")
    found = rows.drop("bad").join(known, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    found = found.withColumn("best", best)
    method = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return found.select(*[F.col(n).alias(c) for n, c in own.items()], "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce(F.col("best.verdict"), method).alias("verdict"))

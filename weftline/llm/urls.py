"""URL filter: explicit rules first, then host reputation, with DataFrame functions only.

A host with few labelled pages says little by itself.  Its bad rate is shrunk
towards that of its registered domain, that one towards its public suffix, and
that one towards all labelled pages: at each level the parent's posterior mean is
the mean of a beta prior, whose weight is fitted by moments over the level's groups,
and the group's labelled pages update it.  A URL is blocked if the lower posterior
bound of its bad rate is above the limit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_ASCII, UPPER_ASCII

#: (verdict, host, path prefix); a rule fits the host and all hosts below it, and the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of several labels under which domains are registered: a short list to start with; pass the full public one as `suffixes`.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
#: Bounds of the fitted prior weight, in labelled pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: A page is blocked if its bad rate is above BAD_RATE with so many standard deviations to spare.
BAD_RATE, DEVIATIONS = 0.5, 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(F.translate(host, UPPER_ASCII, LOWER_ASCII), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_levels(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a host without a dot, and an IPv4 address, is its own.

    `suffixes` are the suffixes of two and more labels (a fixed list of some thousands at most,
    which becomes part of the plan); of those that fit the longest counts, else the last label.
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.size(F.split(name, r"\."))
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    suffix, domain = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    for n in sorted({s.count(".") + 1 for s in suffixes if "." in s}):
        fits = F.substring_index(name, ".", -n).isin(*(s for s in suffixes if s.count(".") == n - 1))
        suffix = F.when(fits, F.substring_index(name, ".", -n)).otherwise(suffix)
        domain = F.when(fits, F.substring_index(name, ".", -n - 1)).otherwise(domain)
    return F.when(address | (labels < 2), name).otherwise(domain), F.when(address, name).otherwise(suffix)


def _shrunk(level: DataFrame, key: str, above: DataFrame | None, parent: str | None) -> DataFrame:
    """Posterior (a, b) of each group: the parent's mean as prior, weighted by what the spread of the level's rates allows."""
    if above is None:
        total = level.agg(F.sum("bad").alias("bad_all"), F.sum("n").alias("n_all"))
        joined = level.join(F.broadcast(total), F.lit(True))
        joined = joined.withColumn("mean", (F.col("bad_all") + 0.5) / (F.col("n_all") + 1.0))
    else:
        joined = level.join(above.select(F.col("key").alias(parent), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), parent)
    # Moments: sum of n (rate - mean)^2 is about sum of mean (1 - mean) (1 + (n - 1) / (weight + 1)).
    chance = F.col("mean") * (1 - F.col("mean"))
    spread = joined.agg(
        F.sum(F.pow(F.col("bad") / F.col("n") - F.col("mean"), F.lit(2)) * F.col("n")).alias("seen"), F.sum(chance).alias("base"), F.sum(chance * (F.col("n") - 1)).alias("more"))
    share = (F.col("seen") - F.col("base")) / F.col("more")
    weight = F.when((F.col("more") > 0) & (share > 0), F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), 1 / share - 1))).otherwise(F.lit(MOST_WEIGHT))
    fitted = joined.join(F.broadcast(spread.select(weight.alias("weight"))), F.lit(True))
    return fitted.select(
        F.col(key).alias("key"), (F.col("weight") * F.col("mean") + F.col("bad")).alias("a"),
        (F.col("weight") * (1 - F.col("mean")) + F.col("n") - F.col("bad")).alias("b"))


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", suffixes=SUFFIXES) -> dict[str, DataFrame]:
    """Posterior of the bad rate by host, domain, suffix and over all, from labelled pages (host, bad 0 or 1).

    Rows with a null or empty host or a null outcome say nothing.  The frames hold
    (key, a, b) of a beta distribution; "all" holds one row.  See `domain_levels` for `suffixes`.
    """
    rows = outcomes.select(F.col(host_col).alias("host"), F.col(bad_col).cast("double").alias("bad")).where("host <> '' and bad is not null")
    hosts = rows.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("*").cast("double").alias("n"))
    domain, suffix = domain_levels(F.col("host"), suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    by_suffix = _shrunk(suffixes, "suffix", None, None)
    by_domain = _shrunk(domains, "domain", by_suffix, "suffix")
    by_host = _shrunk(hosts, "host", by_domain, "domain")
    total = rows.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("*").alias("n"))
    return {"host": by_host, "domain": by_domain, "suffix": by_suffix, "all": total.select((F.col("bad") + 0.5).alias("a"), (F.col("n") - F.col("bad") + 0.5).alias("b"))}


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, outcomes: DataFrame | None = None, suffixes=SUFFIXES) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, bad_rate, bad_bound), one for each row of `pages`.

    A page with a fitting rule gets the longest rule's verdict.  For the others the
    reputation of the host decides, or of its domain, suffix or all pages where the
    host has no labelled page: block if the mean bad rate less DEVIATIONS posterior
    standard deviations is above BAD_RATE, else allow.

    `outcomes` (host, bad) are the labelled pages; without it the pages that a rule
    judges are taken, each of its rows once (block is bad).  A null url, and one
    without ://, has an empty host and path and is judged by the rate of all pages.
    Repeated rows come out as often as they go in.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path")).withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = rows.where("hit is not null").select("host", (F.col("hit.verdict") == "block").cast("int").alias("bad"))
    domain, suffix = domain_levels(F.col("host"), suffixes)
    # The pages meet the reputations through their distinct hosts, so a hot host is one row here.
    hosts = rows.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    known = host_reputation(outcomes, suffixes=suffixes)
    for level in ("host", "domain", "suffix"):
        posterior = known[level].select(F.col("key").alias(f"{level}_key"), F.struct("a", "b").alias(f"{level}_post"))
        hosts = hosts.join(posterior, F.col(level) == F.col(f"{level}_key"), "left")
    hosts = hosts.join(F.broadcast(known["all"].select(F.struct("a", "b").alias("all_post"))), F.lit(True))
    post = F.coalesce("host_post", "domain_post", "suffix_post", "all_post")
    a, b = post["a"], post["b"]
    mean = a / (a + b)
    bound = mean - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = hosts.select(F.col("host").alias("of_host"), mean.alias("bad_rate"), bound.alias("bad_bound"))
    out = rows.join(judged, F.col("host") == F.col("of_host"))
    verdict = F.coalesce("hit.verdict", F.when(F.col("bad_bound") > BAD_RATE, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound")

"""URL filter: host reputation by empirical Bayes, behind a list of rules. Built-in functions only.

Labelled outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate is
shrunk to the level above by a beta-binomial prior whose strength is estimated from how much the rates of
that level differ beyond chance (moments): suffix to the whole, domain to suffix, host to domain. A host is
blocked where the lower bound of its posterior bad rate reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barriometrics.session import materialise

#: (verdict, host, path) of each rule.
Rule = tuple[str, str, str]
THRESHOLD = 0.5
#: One-sided 90 % normal bound.
Z = 1.2816
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is no ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The last two labels; hosts of one label are their own domain."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (verdict, rule) that fits: its host or a subdomain, and a path that starts with its own."""
    if not rules:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    fits = []
    for verdict, rule_host, rule_path in rules:
        text = rule_host + rule_path
        here = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        made = F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(here & F.startswith(path, F.lit(rule_path)), made))
    return F.array_max(F.array_compact(F.array(*fits)))


def _strength(parts: DataFrame, rate: str) -> float:
    """Prior strength of a level: 1 / rho - 1, rho being how far its rates differ beyond chance around ``rate``."""
    m = F.col(rate)
    extra = F.sum(F.pow(F.col("bad") - F.col("n") * m, 2) - F.col("n") * m * (1 - m))
    room = F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    extra, room = parts.agg(extra, room).first()
    rho = min(0.9, max(0.005, extra / room)) if extra is not None and room else 0.1
    return 1 / rho - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) for each host of ``outcomes`` (host, n, bad), which may repeat hosts and hold zeros.

    Hosts without labelled pages have their domain's rate, or their suffix's. Without any outcome all rates
    are 0. Counts fold by host first; the levels above are aggregates joined back, never windows.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = hosts.select("host", "n", "bad", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    hosts = materialise(hosts, "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    rate = bad / n if n else 0.0

    def shrunk(mean: str, strength: float) -> Column:
        return (F.col("bad") + F.col(mean) * strength) / (F.col("n") + strength)

    suffixes = suffixes.withColumn("whole", F.lit(rate))
    suffixes = suffixes.select("suffix", shrunk("whole", _strength(suffixes, "whole")).alias("suffix_rate"))
    domains = materialise(domains.join(suffixes, "suffix"), "domain-rates")
    domains = domains.select("domain", shrunk("suffix_rate", _strength(domains, "suffix_rate")).alias("domain_rate"))
    hosts = materialise(hosts.join(domains, "domain"), "host-rates")
    strength = _strength(hosts, "domain_rate")
    mean = shrunk("domain_rate", strength)
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return hosts.withColumn("mean", mean).select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - Z * spread).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower) for every row of ``pages``.

    ``outcomes`` has (host, n, bad). The longest fitting rule decides; otherwise the host's lower bound
    does. NULL urls and urls without ``://`` have an empty host, which is a host like any other. Repeated
    pages each have a row.
    """
    split = pages.select(F.col(page_id).alias(page_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    every = outcomes.select("host", "n", "bad").unionByName(split.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))
    known = reputations(every).select("host", F.col("mean").alias("bad_rate"), "lower")
    judged = split.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).join(known, "host")
    own = F.when(F.col("lower") >= threshold, "block").otherwise("allow")
    return judged.select(page_id, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "bad_rate", "lower")


def outcomes_of(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(host, n, bad) of the pages whose document is labelled: the last number of the path is the document's id.

    A page is bad if its document is of quality 0 or toxic; a document labelled twice is bad if one label says so.
    """
    bad = F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("document")).agg(bad.alias("bad"))
    number = F.regexp_extract(path_of(F.col(url)), r"/([0-9]{1,18})(?:\.[a-z]+)?/?\z", 1)
    named = pages.select(host_of(F.col(url)).alias("host"), F.nullif(number, F.lit("")).cast("long").alias("document"))
    folded = named.where("document IS NOT NULL").groupBy("host", "document").agg(F.count("*").alias("pages"))
    return folded.join(known, "document").groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("bad"))

"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import ascii_lower
from strandline.plans.sizing import lookup_side, settle

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``.

    The host ends at the first ``/``, ``?`` or ``#`` and has A-Z lower-cased; the path ends
    at the first ``?`` or ``#``. User names and ports stay part of the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its
    path. Rules of equal length go by their order in the list.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels of a host without user name and port, or what there is of them."""
    return F.substring_index(_bare(host), ".", -2)


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(_bare(host), ".", -1)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")


def _strength(children: DataFrame, mean: str, least: float, most: float) -> DataFrame:
    """Prior strength of one level by moments: overdispersion of its counts around ``mean``."""
    even = F.col("n") * F.col(mean) * (1 - F.col(mean))
    spread = F.sum((F.col("bad") - F.col("n") * F.col(mean)) ** 2 - even)
    scale = F.sum(even * (F.col("n") - 1))
    low, high = 1 / (1 + most), 1 / (1 + least)
    rho = F.when(scale > 0, spread / scale).otherwise(high)
    return children.agg((1 / F.least(F.greatest(rho, F.lit(low)), F.lit(high)) - 1).alias("k"))


def host_reputation(
    hosts: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 200.0
) -> DataFrame:
    """Posterior of the rate of bad pages per host, shrunk from suffix to domain to host.

    ``hosts`` holds one row per host: ``host``, labelled pages ``n``, bad ones ``bad``. Each
    level's prior is a beta distribution around the posterior mean of the level above it; its
    strength comes from the data by moments and stays between ``least`` and ``most`` pages; it is ``least``
    where no child has two labelled pages. Without any label the rate of everything is 1/2. Returns ``host``, ``mean``, ``low``, ``high``,
    where the bounds are ``z`` standard deviations of the posterior beta away from its mean.
    """
    hosts = settle(hosts.withColumns({
        "domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    parent, level = None, None
    for level_name, level in (("suffix", suffixes), ("domain", domains), ("host", hosts)):
        if parent is None:
            level = level.withColumn("above", F.lit((total.bad + 1) / (total.n + 2)))
        else:
            key = {"domain": "suffix", "host": "domain"}[level_name]
            keys = ["domain", "suffix"] if key == "domain" else ["suffix"]
            level = level.join(lookup_side(parent.select(*keys, F.col("mean").alias("above"))), keys)
        k = _strength(level, "above", least, most).first().k
        k = least if k is None else k
        level = level.withColumn("mean", (F.col("bad") + k * F.col("above")) / (F.col("n") + k))
        parent = level
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return level.select("host", "mean", (F.col("mean") - z * sd).alias("low"),
                        (F.col("mean") + z * sd).alias("high"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    worst: float = 0.3,
    z: float = 1.645,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the ``key`` of every page.

    ``outcomes`` holds labelled pages: ``key`` and a boolean ``bad``. A page under a rule gets
    the rule's verdict. Any other is blocked if even the lower posterior bound of its host's
    rate of bad pages is over ``worst``, and allowed otherwise.

    Null keys have no outcome; repeated outcomes of a page count once, as bad if one of
    them is; null outcomes don't count. Repeated pages are judged each. An empty host is a host like others, in
    the suffix of empty hosts. Other columns of either table are not read.
    """
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(
        F.col(key).alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = parts.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    low = lookup_side(host_reputation(counts, z).select("host", "low"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("low") > worst, BLOCK).otherwise(ALLOW)
    return parts.join(low, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"))

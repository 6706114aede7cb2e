"""URL filters: rules first, then the host's reputation, shrunk level by level. Native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import lower_ascii, stored

#: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Block where the bad share of a host's pages is above this with the bound's certainty.
MAX_BAD, Z = 0.25, 1.645
#: Of a prior, in pages.
MAX_STRENGTH = 1000.0
_LEVELS = ("suffix", "domain", "host")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Empty for null and where there is no ``://``."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits: same host or a subdomain of it, and the path begins with
    the rule's. Null where none does. The list is a parameter, not data."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level: the beta-binomial's, by moments. Rows ``n``, ``bad``."""
    known = groups.where("n > 0")
    row = known.agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("pp"),
    ).first()
    if not row.n:
        return 1.0
    mean = row.bad / row.n
    binomial = mean * (1 - mean)
    room = row.n - row.nn / row.n - (row.m - 1)
    if binomial == 0 or room <= 0:
        return MAX_STRENGTH
    alike = (row.pp - row.n * mean * mean - binomial * (row.m - 1)) / (binomial * room)
    return (1 - alike) / alike if alike > 1 / (MAX_STRENGTH + 1) else MAX_STRENGTH


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per host: pages with a known outcome ``n``, bad ones ``bad``, and the posterior's
    ``bad_mean`` and ``bad_low`` (lower bound).

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0 or 1). Rates of suffixes
    are shrunk to the overall one, of registered domains (the last two labels) to their
    suffix's, of hosts to their domain's, each level with its own beta-binomial prior. A host
    without outcomes has its domain's rate. Null outcomes do not count; repeated pages do.
    """
    counted = pages.join(outcomes.where("bad is not null"), "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = stored(hosts.select(
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"), "*"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = F.lit((total.bad or 0) / total.n if total.n else 0.0)
    above: DataFrame | None = None
    for level in _LEVELS:
        keys = list(_LEVELS[: _LEVELS.index(level) + 1])
        table = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        strength = _strength(table)
        if above is not None:
            table = table.join(above, keys[:-1])
        prior = mean if above is None else F.col("prior")
        a, b = F.col("bad") + strength * prior, F.col("n") - F.col("bad") + strength * (1 - prior)
        table = table.withColumn("a", a).withColumn("b", b).withColumn("bad_mean", F.col("a") / (F.col("a") + F.col("b")))
        above = table.select(*keys, F.col("bad_mean").alias("prior"))
    spread = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return table.select("host", "n", "bad", "bad_mean", (F.col("bad_mean") - Z * spread).alias("bad_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean and bad_low of every row of ``pages``
    (page_id, url; other columns are ignored). The rule's verdict where one fits, else
    block where even the lower bound of the host's bad share is above ``max_bad``. A null or
    malformed url has an empty host, judged like any other host. Repeated rows stay."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # Stored, the reputations get a shuffle of their own in the join, so a hot host can be split.
    known = stored(reputations(rows.select("page_id", "host"), outcomes), "reputations")
    judged = rows.join(known, "host").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_host = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "bad_mean", "bad_low")

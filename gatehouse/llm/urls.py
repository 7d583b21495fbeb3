"""URL filter: rules first, then the host's reputation by empirical Bayes.

Labelled outcomes of pages are counted per host, registered domain and suffix. Each level's bad rate has a beta
prior centred on the posterior mean of the level above (all pages above the suffixes); the prior's strength is
estimated by the method of moments from how much the groups of a level differ. A host without outcomes takes the
posterior of its domain, else of its suffix, else of all pages, widened by how much the levels below differ. A page without a
rule is blocked if the lower posterior bound of its host's bad rate exceeds a threshold. The bound is the
normal approximation of the beta posterior's; suffixes are the last label, or one of a short list of two labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch

#: Suffixes of two labels under which domains are registered (fixed values).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(last)


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. A rule is ``host/path-prefix``; of two equal rules block wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(groups: DataFrame, key: str, centre: Column) -> tuple[DataFrame, float]:
    """``key, mean, spread`` of each group's beta posterior, and the strength of the level's prior; ``groups`` has key, n, bad.

    ``centre`` is the posterior mean above. A spread is a variance as a share of mean * (1 - mean). The driver sees two sums.
    """
    joined = groups.withColumn("centre", centre)
    # moments: the groups' squared distance from their centres, less what sampling alone explains
    over, scale = joined.agg(F.sum(F.expr("n * pow(bad / n - centre, 2) - centre * (1 - centre)")), F.sum(F.expr("n * centre * (1 - centre)"))).first()
    strength = min(1000.0, max(1.0, scale / over - 1)) if over and over > 0 else 1000.0
    mean = (F.col("bad") + F.lit(strength) * F.col("centre")) / (F.col("n") + F.lit(strength))
    return joined.select(key, mean.alias(f"{key}_mean"), (1 / (F.col("n") + F.lit(strength + 1))).alias(f"{key}_spread")), strength


def reputation(hosts: DataFrame, outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, mean, spread`` of the bad rate's posterior of every host in ``hosts(host)``, whether ``outcomes(host, bad 0/1)`` has it or not.

    The mean and spread of an unseen host are those of the closest level above that was seen; each level between adds what its groups differ by.
    """
    levels = {"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}
    counted = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).withColumns(levels)
    counted = scratch.put("outcomes", counted)
    up = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = up(counted, "domain", "suffix")
    all_n, all_bad = counted.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    top = (all_bad + 0.5) / (all_n + 1)
    suffix, of_suffix = _shrunk(up(domains, "suffix"), "suffix", F.lit(top))
    domain, of_domain = _shrunk(domains.join(suffix, "suffix"), "domain", F.col("suffix_mean"))
    host, of_host = _shrunk(counted.join(domain, "domain"), "host", F.col("domain_mean"))
    wider = [0.0]  # from hosts upwards
    for strength in (of_host, of_domain, of_suffix):
        wider.append(wider[-1] + 1 / (strength + 1))
    placed = hosts.withColumns(levels).join(host, "host", "left").join(domain, "domain", "left").join(suffix, "suffix", "left")
    mean = F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(top))
    spread = F.coalesce("host_spread", F.col("domain_spread") + wider[1], F.col("suffix_spread") + wider[2], F.lit(1 / (all_n + 2) + wider[3]))
    return placed.select("host", mean.alias("mean"), spread.alias("spread"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, mean, strength`` of the posterior bad rate of every host in ``outcomes(host, bad 0/1)``."""
    known = reputation(outcomes.select("host").distinct(), outcomes, Scratch(outcomes.sparkSession, "urls"))
    return known.select("host", "mean", (1 / F.col("spread") - 1).alias("strength"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], outcomes: DataFrame, max_bad_rate: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page; ``outcomes(host, bad)`` has one row per labelled page.

    Returns page_id, host, path, rule, verdict, bad_rate, bad_rate_bound. A page without a rule is blocked if the posterior's mean less
    ``z`` standard deviations exceeds ``max_bad_rate``. Null or malformed urls (empty host and path) have no reputation and are
    allowed; null ids stay; repeated rows are judged alike; very long urls are read whole; an empty table gives no rows, and
    without outcomes nothing is blocked but by rules; further columns are ignored. The rules are a short list held in the plan.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = split.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    known = reputation(split.select("host").where("host <> ''").distinct(), outcomes.select("host", "bad"), scratch)
    seen = known.select("host", F.col("mean").alias("bad_rate"), F.expr(f"greatest(0D, mean - {z} * sqrt(mean * (1 - mean) * spread))").alias("bad_rate_bound"))
    judged = ruled.join(seen, "host", "left")
    verdict = F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).when(F.col("bad_rate_bound") > max_bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_rate_bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """``host, bad`` of pages whose url names a labelled document: the last number of its path is the id.

    A page is bad if the document's quality is 0 or it is toxic.
    """
    url = F.col(url_col)
    named = pages.select(host_of(url).alias("host"), F.regexp_extract(path_of(url), "([0-9]+)[^0-9]*$", 1).alias("number")).selectExpr("host", "try_cast(number as bigint) as doc_id")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.expr("coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1")).cast("int")).alias("bad"))
    return named.where("doc_id is not null").join(known, "doc_id").select("host", "bad")

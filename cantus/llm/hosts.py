"""URL filter by empirical-Bayes host reputation, in DataFrame functions alone.

Labelled outcomes of pages are counted by host. Beta-binomial priors shrink them: a suffix's rate towards the rate of
all, a registered domain's towards its suffix, a host's towards its domain. How strongly is estimated at each level from the spread
of the rates (method of moments). A host is blocked if the lower bound of its posterior bad rate is over the tolerance,
by default half as much again as the rate of all pages: then it is credibly worse than the rest. A host without outcomes has its domain's rate,
one of an unseen domain its suffix's, and then that of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Store

#: Suffixes of two labels under which domains are registered (fixed values).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
#: How many times as bad as all pages together a host may be.
WORSE = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name(h: Column) -> Column:
    """The host without a user before it and a port after it."""
    return F.regexp_replace(F.regexp_replace(h, "(?s)^.*@", ""), ":[0-9]*$", "")


def suffix(h: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(name(h), ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(name(h), ".", -1))


def domain(h: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The label before the suffix, and the suffix."""
    two = F.substring_index(name(h), ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(name(h), ".", -3)).otherwise(two)


def rule_column(h: Column, p: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """Of the longest rule (action, text) that fits host and path, the text (1) or the action (0); null if none does.
    A rule's text is a host, which stands for its subdomains too, and the beginning of a path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, slash, rest = rule[1].partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def strength(n: str, bad: str, least: float = 1.0, most: float = 1000.0) -> Column:
    """Pseudo-observations of a level's prior, by the method of moments over its groups (an aggregate expression)."""
    total, all_bad, count = F.sum(n), F.sum(bad), F.count(F.lit(1))
    rate = all_bad / total
    spread = F.sum(F.col(bad) * F.col(bad) / F.col(n)) - all_bad * rate  # sum of n (p - rate)^2
    within = rate * (1 - rate)
    free = total - F.sum(F.col(n) * F.col(n)) / total - (count - 1)
    rho = (spread - within * (count - 1)) / F.nullif(within * free, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), (1 - rho) / F.when(rho > 0, rho))), F.lit(most))


def reputation(outcomes: DataFrame, z: float = 1.645, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes (host, bad 0 or 1) to one row per host: n, n_bad, and the posterior's mean rate (bad_rate), its lower bound
    (bad_bound) and the rate of all (all_rate).

    The bound is the mean less z standard deviations of the beta posterior, 0 at least. Null outcomes don't count; a host with no
    others has the prior alone (null rates where nothing counts at all). Strengths come from groups with outcomes.
    """
    store = Store(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("n_bad"))
    hosts = store.save(hosts.select("host", domain(F.col("host"), two_labels).alias("domain"), suffix(F.col("host"), two_labels).alias("suffix"), "n", "n_bad"))
    domains = store.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("n_bad").alias("db")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    ks, rate = suffixes.where("sn > 0").agg(strength("sn", "sb"), F.sum("sb") / F.sum("sn")).first()
    (kd,) = domains.where("dn > 0").agg(strength("dn", "db")).first()
    (kh,) = hosts.where("n > 0").agg(strength("n", "n_bad")).first()
    everyone = F.lit(rate).cast("double")
    suffixes = suffixes.select("suffix", ((F.col("sb") + ks * everyone) / (F.col("sn") + ks)).alias("s_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("db") + kd * F.col("s_rate")) / (F.col("dn") + kd)).alias("d_rate"))
    a, b = F.col("n_bad") + kh * F.col("d_rate"), F.col("n") - F.col("n_bad") + kh * (1 - F.col("d_rate"))
    n, mean = a + b, a / (a + b)
    bound = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (n + 1)))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "n_bad", mean.alias("bad_rate"), bound.alias("bad_bound"), everyone.alias("all_rate"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], tolerance: float | None = None, worse: float = WORSE, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule (the longest that fits, or null) and verdict, `allow` or `block`: the
    rule's, else block if the lower bound of the host's bad rate is over `tolerance` (by default `worse` times the rate of all pages).

    outcomes: (page_id, bad 0/1/null), of any number per page. Null urls and urls without `://` have an empty host and
    path, which is judged like any other. A user and a port belong to the host, but not to its domain and suffix. Hosts without a labelled page are judged by the prior of their domain and suffix. Null ids and repeated rows are
    judged like others, but take no outcome from a null id. Other columns are ignored; empty tables give an empty result.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    known = pages.select("page_id", "host").distinct().join(outcomes.select(F.col(id_col).alias("page_id"), "bad"), "page_id", "left")
    rated = reputation(known.select("host", "bad"), z, two_labels).select("host", "bad_rate", "bad_bound", "all_rate")
    h, p = F.col("host"), F.col("path")
    out = pages.join(rated, "host", "left")
    own = F.when(F.col("bad_bound") > (worse * F.col("all_rate") if tolerance is None else tolerance), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule_column(h, p, rules, 1).alias("rule"), F.coalesce(rule_column(h, p, rules, 0), own).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))

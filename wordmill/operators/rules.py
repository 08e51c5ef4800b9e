"""Which source a URL belongs to, and whether its rules allow fetching and saving it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions.urls import host_of


def match_source(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``matched``: the first source in order whose domains hold the URL's host, null without one.

    The table of domains is configuration; it joins by equality of hosts."""
    domains = sources.select(F.explode("allowed_domains").alias("host"), "id", "ord").groupBy("host").agg(F.min_by("id", "ord").alias("matched"))
    keyed = urls.withColumn("host", host_of(F.col(url)))
    return keyed.join(F.broadcast(domains), "host", "left").drop("host")


def _any(url: Column, patterns: list[str]) -> Column:
    return url.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(False)


def judged(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``matched``, ``allowed`` and ``savable``. A denied URL isn't allowed; without allow rules
    all others are. Save rules stand alone; without any, what is allowed is savable.

    Rules are configuration (a few hundred patterns): each source's are one expression."""
    rules = sources.orderBy("ord").collect()
    u, m = F.col(url), F.col("matched")
    pick = lambda of: reduce(lambda e, r: F.when(m == r["id"], of(r)).otherwise(e), reversed(rules), F.lit(False))
    allow = lambda r: ~_any(u, r["deny_regex"] or []) & (_any(u, r["allow_regex"]) if r["allow_regex"] else F.lit(True))
    save = lambda r: _any(u, r["save_regex"]) if r["save_regex"] else allow(r)
    return match_source(urls, sources, url).withColumns({"allowed": pick(allow), "savable": pick(save)})

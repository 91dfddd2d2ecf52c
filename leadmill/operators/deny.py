"""Deny rules for URLs and hosts.

A host is denied when it, or a parent domain, is on the deny list.  Testing
each list entry against each URL is a nested loop; here a host is expanded to
its few parent domains and looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import urls, vocab
from leadmill.functions.text import bind, col

def _listed(deny_hosts: Sequence[str]):
    hosts = list(deny_hosts)
    if not hosts:
        return lambda host: F.lit(False)
    return lambda host: F.exists(urls.host_suffixes(host), lambda s: s.isin(*hosts))


def host_denied(
    url: Column | str, deny_hosts: Sequence[str] = vocab.DEFAULT_DENY_HOSTS
) -> Column:
    """The host or one of its parent domains is listed (a hash lookup)."""
    return bind(urls.host_of(url), _listed(deny_hosts))


def url_denied(
    url: Column | str, deny_hosts: Sequence[str] = vocab.DEFAULT_DENY_HOSTS
) -> Column:
    """Every deny rule; the host is parsed once for all of them."""
    url = F.coalesce(col(url), F.lit(""))
    listed = _listed(deny_hosts)
    by_host = bind(urls.host_of(url), lambda h: urls.host_rule_denied(h) | listed(h))
    return by_host | urls.path_rule_denied(url)


def denied_hosts(df: DataFrame, url: str, deny: DataFrame) -> DataFrame:
    """Distinct hosts of *df* that a deny table of any size covers.

    Only distinct hosts are expanded and shuffled, so a host that holds a
    third of all rows costs one row here.
    """
    hosts = df.select(urls.host_of(url).alias("host")).distinct()
    expanded = hosts.select("host", F.explode(urls.host_suffixes("host")).alias("suffix"))
    hit = expanded.join(deny.select(F.col("host").alias("suffix")), "suffix", "left_semi")
    return hit.select("host").distinct()


def drop_denied_hosts(df: DataFrame, url: str, deny: DataFrame) -> DataFrame:
    """Anti join on the host; the deny table needs one column, ``host``.

    No broadcast is forced: adaptive execution broadcasts the denied hosts when
    their measured size allows and otherwise splits skewed hosts of *df*.
    """
    bad = denied_hosts(df, url, deny)
    return (
        df.withColumn("_host", urls.host_of(url))
        .join(bad.withColumnRenamed("host", "_host"), "_host", "left_anti")
        .drop("_host")
    )


def flag_denied(
    df: DataFrame, url: str, flag: str, deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS
) -> DataFrame:
    """Add a column that tells whether any deny rule holds."""
    if not isinstance(deny_hosts, DataFrame):
        return df.withColumn(flag, url_denied(url, deny_hosts))
    bad = denied_hosts(df, url, deny_hosts).select(F.col("host").alias("_host"), F.lit(True).alias("_listed"))
    return (
        df.withColumn("_host", urls.host_of(url))
        .join(bad, "_host", "left")
        .withColumn(flag, F.col("_listed").isNotNull() | urls.url_rule_denied(url))
        .drop("_host", "_listed")
    )


def drop_denied(
    df: DataFrame, url: str, deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS
) -> DataFrame:
    """Keep rows whose URL passes every deny rule."""
    if isinstance(deny_hosts, DataFrame):
        return drop_denied_hosts(df.filter(~urls.url_rule_denied(url)), url, deny_hosts)
    return df.filter(~url_denied(url, deny_hosts))

"""Filters, counts and snapshots over lead tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import leads, phrases, vocab
from leadmill.functions.urls import host_key
from leadmill.operators import deny


def purge(
    df: DataFrame, deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS
) -> DataFrame:
    """Drop leads the rules reject today; a lead without a website goes too."""
    vendor = phrases.is_provider_name(F.coalesce("business_name", F.lit("")))
    return deny.drop_denied(df.filter(~vendor), "website", deny_hosts)


def filter_quality(
    df: DataFrame, emails_only: bool = False, min_quality: int = 0, max_quality: int = 100
) -> DataFrame:
    if emails_only:
        df = df.filter(leads.list_size("emails") > 0)
    return df.filter(leads.score().between(min_quality, max_quality))


def filter_band(df: DataFrame, band: str | None) -> DataFrame:
    """A named quality band; none means every lead."""
    low, high = vocab.QUALITY_BANDS[band] if band else (0, 100)
    return filter_quality(df, min_quality=low, max_quality=high)


def view_test(
    label: str | None = None,
    niche: str | None = None,
    has_email: bool = False,
    text: str | None = None,
) -> Column:
    """The interactive filters as one condition; each is off when not given."""
    test = F.lit(True)
    if label:
        test = test & (F.lower(F.coalesce("quality_label", F.lit("low"))) == label)
    if niche:
        test = test & (F.col("niche") == niche)
    if has_email:
        test = test & (leads.list_size("emails") > 0)
    if text and text.strip():
        test = test & F.contains(leads.search_text(), F.lit(text.strip().lower()))
    return test


def lead_view(df: DataFrame, **filters) -> DataFrame:
    return df.filter(view_test(**filters))


def lead_stats(df: DataFrame, **filters) -> DataFrame:
    """Counts by label, with e-mail, shown (by the filters) and in total."""
    label = F.lower(F.coalesce("quality_label", F.lit("low")))
    return df.agg(
        *[F.count_if(label == b).alias(f"n_{b}") for b in ("high", "medium", "low")],
        F.count_if(leads.list_size("emails") > 0).alias("n_email"),
        F.count_if(view_test(**filters)).alias("n_shown"),
        F.count(F.lit(1)).alias("n_total"),
    )


def lead_niches(df: DataFrame) -> DataFrame:
    """Niches in use and number of leads."""
    return df.agg(
        F.array_sort(F.collect_set(F.when(F.col("niche") != "", F.col("niche")))).alias("niches"),
        F.count(F.lit(1)).alias("total"),
    )


def run_delta(before: DataFrame, after: DataFrame, key: str = "website") -> DataFrame:
    """Leads added and removed between two snapshots, by site."""
    old = before.select(host_key(key).alias("site")).distinct().withColumn("was", F.lit(1))
    new = after.select(host_key(key).alias("site")).distinct().withColumn("now", F.lit(1))
    both = old.join(new, "site", "full")
    return both.filter("was IS NULL OR now IS NULL").select(
        "site", F.when(F.col("was").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("change")
    )


def run_delta_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How the number of leads changed: one row with before, after, delta."""
    tagged = before.select(F.lit(0).alias("t")).unionByName(after.select(F.lit(1).alias("t")))
    counted = tagged.agg(
        F.count_if(F.col("t") == 0).alias("n_before"), F.count_if(F.col("t") == 1).alias("n_after")
    )
    return counted.withColumn("delta", F.col("n_after") - F.col("n_before"))

"""Column functions over a lead row and its five contact lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import col, empty_list


def list_size(c: Column | str) -> Column:
    return F.size(F.coalesce(col(c), empty_list()))


def score(sizes: dict[str, Column] | None = None) -> Column:
    """Quality 0-100.  Takes list sizes, so counts from an aggregation do too."""
    sizes = sizes or {c: list_size(c) for c in vocab.SCORE_WEIGHTS}
    total = F.lit(0)
    for name, (most, points, bonus) in vocab.SCORE_WEIGHTS.items():
        n = sizes[name]
        total = total + F.least(n, F.lit(most)) * F.lit(points)
        if bonus:
            total = total + F.when(n > 0, F.lit(bonus)).otherwise(F.lit(0))
    return F.least(total, F.lit(100)).cast("int")


def label(points: Column | str) -> Column:
    points = col(points)
    return (
        F.when(points >= vocab.QUALITY_BANDS["high"][0], F.lit("high"))
        .when(points >= vocab.QUALITY_BANDS["medium"][0], F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def contact_count() -> Column:
    return reduce(Column.__add__, [list_size(c) for c in vocab.CONTACT_LISTS])


def has_contact() -> Column:
    return contact_count() > 0


def search_text() -> Column:
    """Everything the free-text filter looks at, lower-cased.

    Empty lists add nothing; empty text columns still add their blank.
    """
    order = (
        "business_name", "website", "emails", "linkedin_urls",
        "whatsapp_numbers", "instagram_handles", "phones", "source_query",
    )
    parts = [
        F.coalesce(col(c), empty_list())
        if c in vocab.CONTACT_LISTS
        else F.array(F.coalesce(col(c), F.lit("")))
        for c in order
    ]
    return F.lower(F.array_join(F.concat(*parts), " "))


def display_site(website: Column | str) -> Column:
    site = F.regexp_replace(col(website), "^https?://(www\\.)?", "")
    return F.regexp_replace(site, "/+$", "")


def display_handle(handle: Column | str) -> Column:
    return F.substring_index(col(handle), "/", -1)


def iso_now() -> Column:
    return iso_text(F.current_timestamp())


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 text with microseconds and offset (session zone UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def clock_text(seconds: Column | str) -> Column:
    """Seconds as m:ss."""
    s = F.floor(F.coalesce(col(seconds).cast("double"), F.lit(0.0)))
    return F.concat(
        F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")
    )

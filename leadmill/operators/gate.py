"""The candidate gate: which pages count for which niche."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import phrases, vocab
from leadmill.functions.vocab import Niche

SWITCHES = {
    "corporate": "exclude_corporate",
    "education": "exclude_education",
    "portal": "exclude_portals",
    "reference": "exclude_reference",
}


def first_reason(scope: Column, excluded: Column, flags: dict[str, Column], **switches) -> Column:
    """Name of the first rule that rejects, NULL when the page is accepted.

    Scope and four of the page tests can be switched off; exclusion keywords
    and the vendor test always apply.
    """
    known = {"require_scope", *SWITCHES.values()}
    unknown = set(switches) - known
    if unknown:
        raise TypeError(f"unknown gate switches: {sorted(unknown)}")
    out = F.when(excluded, F.lit("exclusion"))
    if switches.get("require_scope", True):
        out = F.when(~scope, F.lit("scope")).when(excluded, F.lit("exclusion"))
    for name, test in flags.items():
        if switches.get(SWITCHES.get(name, ""), True):
            out = out.when(test, F.lit(name))
    return out


def candidate_gate(
    df: DataFrame,
    text: str = "text",
    niche: str = "niche",
    niches: Sequence[Niche] = vocab.NICHES,
    **switches: bool,
) -> DataFrame:
    """Add ``reject_reason`` (NULL = accepted) for the niche of each row."""
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    reason = first_reason(
        phrases.in_scope("_low", niche, niches),
        phrases.has_exclusion("_low", niche, niches),
        {name: test("_low") for name, test in phrases.PAGE_FLAGS.items()},
        **switches,
    )
    return low.withColumn("reject_reason", reason).drop("_low")


def facts_reason(niche: str = "niche", **switches: bool) -> Column:
    """The same verdict from the columns `page_facts` stores."""
    return first_reason(
        F.array_contains("scope_ids", F.col(niche)),
        F.array_contains("excluded_ids", F.col(niche)),
        {name: F.col(f"is_{name}") for name in phrases.PAGE_FLAGS},
        **switches,
    )


def page_niches(
    df: DataFrame, text: str = "text", niches: Sequence[Niche] = vocab.NICHES
) -> DataFrame:
    """One row per page and niche whose keywords the page holds.

    The keyword join is a generator: each page is tested against the niches in
    place, so no pair of page and niche is formed that does not match.
    """
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    ids = phrases.scope_ids("_low", niches)
    # The outer form keeps the optimizer from testing every page twice.
    return low.withColumn("niche", F.explode_outer(ids)).filter("niche IS NOT NULL").drop("_low")

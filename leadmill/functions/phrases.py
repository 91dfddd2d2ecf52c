"""Page, title and name predicates over phrase lists and niche keywords.

All take text that is already lower-cased, so one ``lower`` serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import bind, col, contains_any
from leadmill.functions.vocab import Niche


def is_corporate(lowered: Column | str) -> Column:
    return contains_any(lowered, vocab.CORPORATE_PHRASES)


def is_education(lowered: Column | str) -> Column:
    return contains_any(lowered, vocab.EDUCATION_PHRASES)


def is_portal(lowered: Column | str) -> Column:
    return contains_any(lowered, vocab.PORTAL_PHRASES)


def is_reference(lowered: Column | str) -> Column:
    return contains_any(lowered, vocab.REFERENCE_PHRASES)


def is_provider(lowered: Column | str) -> Column:
    return contains_any(lowered, vocab.PROVIDER_PHRASES)


def name_denied(name: Column | str) -> Column:
    """The name carries a brand that is never a client."""
    return contains_any(F.lower(col(name)), vocab.BRAND_NAME_PHRASES)


def is_provider_name(name: Column | str) -> Column:
    """The name is that of a marketing vendor, not of a prospect."""
    return contains_any(F.lower(col(name)), vocab.PROVIDER_NAME_PHRASES)


# page flag -> predicate, in the order the gate applies them
PAGE_FLAGS = {
    "corporate": is_corporate,
    "education": is_education,
    "portal": is_portal,
    "reference": is_reference,
    "provider": is_provider,
}


def _niche_ids(niches: Sequence[Niche], test) -> Column:
    return F.array_compact(F.array(*[F.when(test(n), F.lit(n.id)) for n in niches]))


def scope_ids(lowered: Column | str, niches: Sequence[Niche] = vocab.NICHES) -> Column:
    """Every niche a text is in scope of; no keywords means no restriction."""
    return _niche_ids(
        niches,
        lambda n: contains_any(lowered, n.scope_keywords) if n.scope_keywords else F.lit(True),
    )


def excluded_ids(lowered: Column | str, niches: Sequence[Niche] = vocab.NICHES) -> Column:
    """Every niche whose exclusion keywords a text holds."""
    return _niche_ids(
        niches,
        lambda n: contains_any(lowered, n.exclusion_keywords)
        if n.exclusion_keywords
        else F.lit(False),
    )


def by_niche(niche: Column | str, niches: Sequence[Niche], value, default: Column) -> Column:
    """Pick an expression by niche id; only the row's own branch is evaluated."""
    out = None
    for n in niches:
        test = col(niche) == n.id
        out = F.when(test, value(n)) if out is None else out.when(test, value(n))
    return default if out is None else out.otherwise(default)


def in_scope(lowered, niche, niches: Sequence[Niche] = vocab.NICHES) -> Column:
    return by_niche(
        niche,
        niches,
        lambda n: contains_any(lowered, n.scope_keywords) if n.scope_keywords else F.lit(True),
        F.lit(False),
    )


def has_exclusion(lowered, niche, niches: Sequence[Niche] = vocab.NICHES) -> Column:
    return by_niche(
        niche,
        niches,
        lambda n: contains_any(lowered, n.exclusion_keywords)
        if n.exclusion_keywords
        else F.lit(False),
        F.lit(False),
    )


def hits(lowered: Column | str, phrases: Column) -> Column:
    """How many of an array of phrases a text holds (each counts, also inside
    another).  One loop over a literal array keeps the generated code small."""
    return bind(col(lowered), lambda t: F.size(F.filter(phrases, lambda p: F.contains(t, p))))

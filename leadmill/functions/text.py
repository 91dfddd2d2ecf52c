"""Small string helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.vocab import LIST_SEPARATOR


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate *value* once and use it several times in *body*.

    A column expression is a tree: using an expensive one three times runs it
    three times.  A lambda variable is computed once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_list() -> Column:
    return F.array().cast("array<string>")


def shortest(phrases: Sequence[str]) -> list[str]:
    """Drop phrases implied by another one: a text that contains
    "stock exchange agency" also contains "stock exchange"."""
    return [p for p in phrases if not any(q != p and q in p for q in phrases)]


def phrase_array(phrases: Sequence[str]) -> Column:
    """A constant array of phrases; the optimizer folds it to a literal."""
    if not phrases:
        return empty_list()
    return F.split(F.lit("\u0001".join(phrases)), "\u0001")


def contains_any(lowered: Column | str, phrases: Sequence[str]) -> Column:
    """True when the text holds any phrase.

    Plain substring searches that stop at the first hit run at memory speed; a
    regex alternation of the same phrases tries every branch at every
    character.  Long lists are one loop over a literal array, which keeps
    plans and generated code small; the text is bound outside of it, or an
    expression behind it would run again for every phrase.
    """
    text = col(lowered)
    few = shortest(phrases)
    if len(few) > 12:
        found = bind(text, lambda t: F.exists(phrase_array(few), lambda p: F.contains(t, p)))
    else:
        found = reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in few])
    return F.coalesce(found, F.lit(False))


def ends_with_any(text: Column | str, endings: Sequence[str]) -> Column:
    text = col(text)
    return reduce(Column.__or__, [F.endswith(text, F.lit(e)) for e in endings])


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


# White space in the Unicode sense, for trimming.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def percent_decode(c: Column | str, plus_is_space: bool = False) -> Column:
    """Percent-decode leniently: a broken escape stays as it is.

    ``try_url_decode`` turns ``+`` into a space and gives NULL on a broken
    escape, so both are protected first.
    """
    safe = F.regexp_replace(col(c), "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def join_list(c: Column | str) -> Column:
    """List -> text in the export form."""
    return F.array_join(col(c), LIST_SEPARATOR)


def split_list(c: Column | str) -> Column:
    """Text in the export form -> list, without empty items."""
    parts = F.split(F.coalesce(col(c), F.lit("")), " \\| ")
    return F.filter(parts, lambda x: x != "")


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(c)))

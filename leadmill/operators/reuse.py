"""Doing expensive things once: evaluating columns and building expressions."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters from re-running the expressions behind *df*.

    A filter on a computed column is pushed below the projection with a copy
    of its expression, so a page would be parsed again for every predicate.  A
    filter cannot pass the generator that makes the columns.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


_built: WeakKeyDictionary[SparkSession, dict[tuple, list[Column]]] = WeakKeyDictionary()


def built_once(name: str, parts: object, build: Callable[[], list[Column]]) -> list[Column]:
    """Column expressions built once per session.

    A page expression takes some thousand calls to the JVM to put together.
    Columns refer to their inputs by name, so the same objects serve every
    DataFrame with these columns.
    """
    session = SparkSession.getActiveSession()
    if session is None:
        return build()
    own = _built.setdefault(session, {})
    key = (name, repr(parts))
    if key not in own:
        own[key] = build()
    return own[key]

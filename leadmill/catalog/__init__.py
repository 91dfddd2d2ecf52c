"""Registered queries, one per operator, with the SQL that checks each."""

from leadmill.catalog.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from leadmill.catalog import files, gates, merges, runs, scalars, streams  # noqa: F401

    return QUERIES, ORACLES

"""Metrics of a run log.

A log table has an order key (file and line, or time and id) and a ``line``.
Nothing here numbers the lines globally: "last" and "first" are ``max_by`` and
``min`` over the key, so a log of any length is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import leads

# Line formats of the run log.
SEARCH_LINE = r"Searching:\s*(.+?)\s*$"
PROBE_LINE = r"Probing\s+(https?://\S+)"
COLLECTED_LINE = r"collected\s+(\d+)\s+qualified leads for\s+(\S+)"


def _got(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def parse_lines(log: DataFrame) -> DataFrame:
    """Add what each line reports; NULL where it reports nothing."""
    return log.withColumns(
        {
            "query": F.btrim(_got(SEARCH_LINE, 1), F.lit("'")),
            "probed": _got(PROBE_LINE, 1),
            "collected": _got(COLLECTED_LINE, 1).cast("bigint"),
            "collected_niche": _got(COLLECTED_LINE, 2),
        }
    )


def _key(order: list[str]) -> Column:
    return F.struct(*order)


def niche_counts(parsed: DataFrame, order: list[str]) -> DataFrame:
    """The last reported count per niche."""
    reports = parsed.filter("collected IS NOT NULL")
    return reports.groupBy(F.col("collected_niche").alias("niche")).agg(
        F.max_by("collected", _key(order)).alias("n")
    )


def log_metrics(log: DataFrame, order: list[str]) -> DataFrame:
    """One row: searches, probes, current query and URL, leads collected.

    One pass: lines reduce to one row per niche (NULL for all other lines),
    which is then summed up.
    """
    parsed = parse_lines(log)
    key = _key(order)
    per_niche = parsed.groupBy("collected_niche").agg(
        F.count("query").alias("searches"),
        F.count("probed").alias("probed"),
        F.max_by("collected", F.when(F.col("collected").isNotNull(), key)).alias("n"),
        F.max(F.when(F.col("query").isNotNull(), F.struct(key.alias("at"), "query"))).alias("q"),
        F.max(F.when(F.col("probed").isNotNull(), F.struct(key.alias("at"), "probed"))).alias("u"),
    )
    return per_niche.agg(
        F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"),
        F.coalesce(F.sum("probed"), F.lit(0)).alias("candidates_probed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("leads_collected"),
        F.coalesce(F.max("q")["query"], F.lit("")).alias("current_query"),
        F.coalesce(F.max("u")["probed"], F.lit("")).alias("current_url"),
    )


def queries_seen(log: DataFrame, order: list[str], n: int = 12) -> DataFrame:
    """The last *n* distinct queries, in the order they were first seen."""
    parsed = parse_lines(log).filter("query IS NOT NULL")
    first = parsed.groupBy("query").agg(F.min(_key(order)).alias("first_at"))
    return first.orderBy(F.desc("first_at")).limit(n).orderBy("first_at")


def tail(log: DataFrame, order: list[str], n: int = 500) -> DataFrame:
    """The last *n* lines in order; a top-n, not a sort of the log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def run_summary(
    log: DataFrame,
    order: list[str],
    leads_table: DataFrame,
    *,
    niches: int,
    max_leads: int,
    started_at: str,
    ended_at: str | None = None,
    now: str | None = None,
) -> DataFrame:
    """Status of a run in one row; without *ended_at* it is still running."""
    running = ended_at is None
    end = F.lit(ended_at or now).cast("timestamp")
    end = F.coalesce(end, F.current_timestamp())
    micros = F.unix_micros(end) - F.unix_micros(F.lit(started_at).cast("timestamp"))
    elapsed = F.round(micros / F.lit(1e6), 1)
    total = leads_table.agg(F.count(F.lit(1))).scalar()
    both = log_metrics(log, order).withColumn("leads_total", total)
    found = F.col("leads_collected" if running else "leads_total")
    goal = max_leads * max(niches, 1)
    percent = F.least(F.lit(100), F.floor(F.lit(100.0) * found / F.lit(goal) + 0.5))
    return both.withColumns(
        {
            "running": F.lit(running),
            "elapsed_s": elapsed,
            "elapsed_text": leads.clock_text(elapsed),
            "leads_found": found,
            "progress_pct": (percent if goal > 0 else F.lit(0)).cast("int"),
        }
    )

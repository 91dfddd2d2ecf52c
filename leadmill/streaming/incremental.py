"""Incremental forms: upserts, new domains, cache lifetime, live log metrics.

All queries take a streaming DataFrame and return the started query.  State is
bounded by a watermark where the data has one; for the stateful operators on
large key sets, use the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leadmill import storage
from leadmill.functions import urls, vocab
from leadmill.operators import logs
from leadmill.sources import keyed_log
from leadmill.sources.writers import cache_key, merged_export

#: State rows that the keys of a stream with lifetimes are dealt out to.
GROUPS = 1024


def current_leads(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Last committed state of a lead table (older than batch *before*)."""
    return keyed_log.read(spark, path, before)


def _list_print(deny_hosts: Sequence[str] | DataFrame) -> str:
    """A short print of a deny list: another list, another print."""
    if not isinstance(deny_hosts, DataFrame):
        return hashlib.sha256("\n".join(sorted(set(deny_hosts))).encode()).hexdigest()
    hosts = deny_hosts.select("host").distinct()
    return "-".join(map(str, hosts.agg(F.count("host"), F.bit_xor(F.xxhash64("host"))).first()))


def upsert_batch(
    leads_df: DataFrame,
    batch_id: int,
    path: str,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    parts: int = keyed_log.PARTS,
) -> None:
    """Merge one batch into the lead table at *path*, a ``keyed_log`` by host.

    Only the hosts of the batch are merged and written: of the table, the parts
    that hold them are read.  Batch *n* starts from the last commit before *n*, so
    a batch that is run again after a failure gives the same table.  When the deny
    list is another one than last time, every host goes through it again.
    """
    spark = leads_df.sparkSession
    earlier = keyed_log.last_commit(spark, path, before=batch_id)
    key = urls.host_key("website")
    leads_df = leads_df.persist()
    tag = _list_print(deny_hosts)
    try:
        hosts = batch_hosts = leads_df.select(key.alias("_key")).filter("_key != ''").distinct().persist()
        if earlier is None:
            old = leads_df.limit(0)  # the first batch is reduced to one lead per host, too
        else:
            if earlier.tag == tag:
                old = keyed_log.rows(spark, path, earlier, hosts)
            else:
                old = keyed_log.rows(spark, path, earlier)
                hosts = hosts.union(old.select("_key")).distinct()
            # A merged table keeps the place its hosts first had as their order.
            old = old.drop("_key", "seq").withColumnRenamed("place", "seq")
        merged = merged_export(leads_df, old, deny_hosts)
        place = F.struct(
            F.col("first_seen.seq.file").alias("file"), F.col("first_seen.seq.row").alias("row")
        )
        merged = merged.withColumn("place", place).drop("first_seen").withColumns(
            {"_key": key, "_gone": F.lit(False)}
        )
        changed = hosts.join(merged, "_key", "left").withColumn("_gone", F.col("_gone").isNull())
        keyed_log.put(spark, path, batch_id, changed, tag, parts)
    finally:
        batch_hosts.unpersist()
        leads_df.unpersist()


def upsert_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    to_leads: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep a lead table up to date; *to_leads* turns a batch into lead rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(to_leads(batch), batch_id, path, deny_hosts)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def new_domains(stream: DataFrame, prior: DataFrame) -> DataFrame:
    """Domains not seen in the prior leads nor earlier in the stream."""
    known = (
        prior.select(urls.domain_of("website").alias("domain"))
        .filter("domain IS NOT NULL")
        .distinct()
    )
    domains = stream.select(urls.domain_of("url").alias("domain")).filter("domain IS NOT NULL")
    return domains.join(known, "domain", "left_anti").dropDuplicates(["domain"])


def valid_results(stream: DataFrame, hours: int = vocab.CACHE_HOURS) -> DataFrame:
    """Cached results, each URL of a query once per cache lifetime.

    *stream*: ``query, fetched_at, urls``.  State of a result is dropped when
    the watermark passes its lifetime, after which it is taken again.
    """
    rows = stream.withWatermark("fetched_at", f"{hours} hours").select(
        cache_key("query").alias("query_key"), "query", "fetched_at", F.explode("urls").alias("u")
    )
    rows = rows.select("query_key", "query", "fetched_at", "u.url", "u.title")
    return rows.dropDuplicatesWithinWatermark(["query_key", "url"])


def refreshed_results(
    stream: DataFrame, hours: int = vocab.CACHE_HOURS, late_hours: int | None = None
) -> DataFrame:
    """Cached results, each URL of a query again once its lifetime is over.

    *stream*: ``query, fetched_at, urls``.  A result is taken if none was in the
    *hours* before it, by the times they were fetched at, not by when they arrive.
    Rows that come more than *late_hours* (the lifetime, by default) behind the
    latest are too late.  The state of a result is one number, dropped after the
    watermark has passed its lifetime (at most one more lifetime later).
    """
    life = hours * 3_600_000_000
    late = hours if late_hours is None else late_hours
    rows = stream.withWatermark("fetched_at", f"{late} hours").select(
        cache_key("query").alias("query_key"), "fetched_at",
        F.unix_micros("fetched_at").alias("at"), F.explode("urls").alias("u"),
    ).select("query_key", "u.url", "u.title", "fetched_at", "at").filter("at IS NOT NULL")

    return _once_per_lifetime(rows, ["query_key", "url"], "title", life).select(
        "query_key", "url", "title", F.timestamp_micros("at").alias("fetched_at")
    )


def live_domains(
    stream: DataFrame, prior: DataFrame, hours: int = vocab.CACHE_HOURS, late_hours: int | None = None
) -> DataFrame:
    """Domains not among the prior leads, each again once its lifetime is over.

    *stream*: ``url, seen_at``.  As ``new_domains``, but a domain that was taken is
    forgotten after *hours*, by the times of the rows: the state holds the domains
    of the last lifetime, at most of two, and does not grow with the age of the stream.  Rows
    more than *late_hours* (the lifetime, by default) behind the latest are too late; of
    the others, one that arrives in a later trigger than a younger row of its domain that
    was taken is inside the lifetime of that row and not taken.  Rows without
    a domain or a time take no part.
    """
    late = hours if late_hours is None else late_hours
    known = prior.select(urls.domain_of("website").alias("domain")).filter("domain IS NOT NULL").distinct()
    rows = stream.withWatermark("seen_at", f"{late} hours").select(
        urls.domain_of("url").alias("domain"), "url", "seen_at", F.unix_micros("seen_at").alias("at")
    ).filter("domain IS NOT NULL AND at IS NOT NULL").join(known, "domain", "left_anti")
    return _once_per_lifetime(rows, ["domain"], "url", hours * 3_600_000_000).select(
        "domain", "url", F.timestamp_micros("at").alias("seen_at")
    )


def _once_per_lifetime(rows: DataFrame, keys: list[str], value: str, life: int, groups: int = GROUPS) -> DataFrame:
    """The first row of each key and the first after every *life* (microseconds in ``at``).

    Of rows at one time the smallest *value* is taken, a null one as the empty text.
    Keys are dealt out by hash to *groups* state rows, as a call of a state function
    costs far more than a row: a group holds its live keys and one number for each.
    Keys whose life is over at the watermark are dropped when their group has rows
    again, and by a timer once all keys of the group are over.
    """

    def take(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        *held, lasts = state.get if state.exists else ([],) * (len(keys) + 1)
        last = dict(zip(zip(*held), lasts))
        arrived = [
            row for b in batches
            for row in zip(b["at"].tolist(), (v or "" for v in b[value].tolist()), *(b[k].tolist() for k in keys))
        ]
        arrived.sort(key=itemgetter(0, 1))
        taken = []
        for at, text, *key in arrived:
            key = tuple(key)
            before = last.get(key)
            if before is None or at >= before + life:
                taken.append((*key, text, at))
                last[key] = at
        now = state.getCurrentWatermarkMs()
        live = [(*key, at) for key, at in last.items() if (at + life) // 1000 > now]
        if live:
            state.update(tuple(map(list, zip(*live))))
            state.setTimeoutTimestamp((max(row[-1] for row in live) + life) // 1000)
        elif state.exists:
            state.remove()
        if taken:
            yield pd.DataFrame(taken, columns=[*keys, value, "at"])

    columns = ", ".join(f"{c} string" for c in [*keys, value])
    held = ", ".join(f"{c} array<string>" for c in keys)
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).groupBy("_group")
    return grouped.applyInPandasWithState(
        take, f"{columns}, at long", f"{held}, last array<long>", "append", "EventTimeTimeout"
    )


def log_state(stream: DataFrame, order: Column) -> DataFrame:
    """Running per-niche state of a log stream with a ``line`` column.

    *order* is the order key found in the line itself (its time stamp).
    """
    parsed = logs.parse_lines(stream).withColumn("at", order)
    return parsed.groupBy("collected_niche").agg(
        F.count("query").alias("searches"),
        F.count("probed").alias("probed"),
        F.max(F.when(F.col("collected").isNotNull(), F.struct("at", "collected"))).alias("c"),
        F.max(F.when(F.col("query").isNotNull(), F.struct("at", "query"))).alias("q"),
        F.max(F.when(F.col("probed").isNotNull(), F.struct("at", "probed"))).alias("u"),
    )


def log_totals(state: DataFrame) -> DataFrame:
    """One row of metrics from the per-niche state."""
    return state.agg(
        F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"),
        F.coalesce(F.sum("probed"), F.lit(0)).alias("candidates_probed"),
        F.coalesce(F.sum("c.collected"), F.lit(0)).alias("leads_collected"),
        F.coalesce(F.max("q")["query"], F.lit("")).alias("current_query"),
        F.coalesce(F.max("u")["probed"], F.lit("")).alias("current_url"),
    )


def log_metrics_stream(
    stream: DataFrame, order: Column, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the current metrics after every trigger (complete mode)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        log_totals(batch).coalesce(1).write.mode("overwrite").parquet(
            storage.version_path(path, batch_id)
        )

    return (
        log_state(stream, order)
        .writeStream.outputMode("complete")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Queries over run logs and the incremental (streaming) forms.

A streaming query runs with ``availableNow`` over files written to a fresh
folder, once for each wave of them, and returns the table it leaves behind.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import storage
from leadmill.catalog import duck as d
from leadmill.catalog.derived import CLOCK, leads_table, table, with_tables
from leadmill.catalog.registry import query
from leadmill.functions import urls, vocab
from leadmill.functions.text import join_list
from leadmill.operators import logs
from leadmill.streaming import incremental

_ORDER = ["ts", "event_id"]
_PARSED = """p AS (SELECT ts, event_id, line,
    nullif(regexp_extract(line, 'Searching: ''([^'']*)''', 1), '') AS q,
    nullif(regexp_extract(line, 'Probing (http[^ ]*)', 1), '') AS u,
    CAST(nullif(regexp_extract(line, 'collected ([0-9]+) qualified', 1), '') AS BIGINT) AS n,
    nullif(regexp_extract(line, 'leads for ([a-z_]+)', 1), '') AS niche FROM fx_log),
  per AS (SELECT niche, arg_max(n, (ts, event_id)) AS n FROM p WHERE n IS NOT NULL GROUP BY 1)"""
_METRICS = """CAST((SELECT count(q) FROM p) AS BIGINT) AS searches, CAST((SELECT count(u) FROM p) AS BIGINT) AS candidates_probed,
  CAST((SELECT coalesce(sum(n), 0) FROM per) AS BIGINT) AS leads_collected,
  (SELECT arg_max(q, (ts, event_id)) FROM p WHERE q IS NOT NULL) AS current_query,
  (SELECT arg_max(u, (ts, event_id)) FROM p WHERE u IS NOT NULL) AS current_url"""


@query("log_metrics", with_tables("fx_log", extra=_PARSED) + f"SELECT {_METRICS}")
def log_metrics(spark, sf):
    return logs.log_metrics(table(spark, sf, "fx_log"), _ORDER)


@query("log_niches", with_tables("fx_log", extra=_PARSED) + "SELECT niche, n FROM per")
def log_niches(spark, sf):
    """Last reported number of leads per niche."""
    return logs.niche_counts(logs.parse_lines(table(spark, sf, "fx_log")), _ORDER)


@query(
    "log_queries",
    with_tables(
        "fx_log",
        extra=_PARSED
        + ", f AS (SELECT q, row_number() OVER (ORDER BY min((ts, event_id)) DESC) AS back FROM p WHERE q IS NOT NULL GROUP BY q)",
    )
    + "SELECT q AS query, row_number() OVER (ORDER BY back DESC) AS place FROM f WHERE back <= 12",
)
def log_queries(spark, sf):
    from pyspark.sql import Window

    seen = logs.queries_seen(table(spark, sf, "fx_log"), _ORDER)
    return seen.select("query", F.row_number().over(Window.orderBy("first_at")).alias("place"))


@query(
    "run_summary",
    with_tables("fx_log", "fx_leads", extra=_PARSED)
    + f"""SELECT 'running' AS state, {_METRICS}, (SELECT count(*) FROM fx_leads) AS leads_total,
      CAST(754.5 AS DOUBLE) AS elapsed_s, '12:34' AS elapsed_text,
      (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM per) AS leads_found,
      CAST(least(100, floor(100.0 * (SELECT sum(n) FROM per) / 27 + 0.5)) AS INTEGER) AS progress_pct
    UNION ALL SELECT 'ended', {_METRICS}, (SELECT count(*) FROM fx_leads), CAST(65.0 AS DOUBLE), '1:05',
      (SELECT count(*) FROM fx_leads),
      CAST(least(100, floor(100.0 * (SELECT count(*) FROM fx_leads) / 27000000 + 0.5)) AS INTEGER)""",
)
def run_summary(spark, sf):
    """The same log and table seen during and after a run."""
    log, leads_df = table(spark, sf, "fx_log"), leads_table(spark, sf, "fx_leads")
    during = logs.run_summary(
        log, _ORDER, leads_df, niches=3, max_leads=9,
        started_at="2024-06-01 00:00:00", now="2024-06-01 00:12:34.5",
    )
    after = logs.run_summary(
        log, _ORDER, leads_df, niches=3, max_leads=9_000_000,
        started_at="2024-06-01 00:00:00", ended_at="2024-06-01 00:01:05",
    )
    cols = (
        "searches", "candidates_probed", "leads_collected", "current_query", "current_url",
        "leads_total", "elapsed_s", "elapsed_text", "leads_found", "progress_pct",
    )
    return during.select(F.lit("running").alias("state"), *cols).unionByName(
        after.select(F.lit("ended").alias("state"), *cols)
    )


# -- streams ------------------------------------------------------------------


def _in_waves(df, order, path, waves=4, top=None):
    """A table arriving in waves, each a range of *order*, whose largest value is *top*.

    The table is made and written once, by all tasks and split by wave.  After the
    files of a wave were moved in comes the stream over all that arrived: run it to
    its end on the same checkpoint, and the wave is one trigger.
    """
    spark = df.sparkSession
    if top is None:
        top = df.agg(F.max(order)).scalar()
    held = storage.new_path(spark, "arriving")
    wave = F.least(F.floor(F.col(order) * waves / (top + 1)), F.lit(waves - 1))
    df.withColumn("_wave", wave).write.partitionBy("_wave").parquet(held)
    for i in range(waves):
        storage.move_files(spark, f"{held}/_wave={i}", path, f"{i}-")
        yield spark.readStream.schema(df.schema).parquet(path)


def _last_customer(spark, sf):
    """Largest number of the rows of the tables that have one row a customer."""
    return table(spark, sf, "fx_base").agg(F.max("k")).scalar()


def _upsert_sql(waves: int = 4) -> str:
    """Wave after wave: purge the table, merge the wave, purge again."""
    purged = f"NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}"
    parts = [
        f"""w AS MATERIALIZED (SELECT seq, website, business_name, emails, {d.count()} AS n, {d.host_key('website')} AS hk,
        least(CAST(floor(seq * {waves} / ((SELECT max(seq) FROM fx_leads) + 1)) AS BIGINT), {waves - 1}) AS wave FROM fx_leads)""",
        f"""t0 AS MATERIALIZED (SELECT seq, website, business_name, emails, n, hk FROM (
            SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, seq DESC) AS rn FROM w WHERE wave = 0 AND hk <> '')
            WHERE rn = 1 AND {purged})""",
    ]
    for i in range(1, waves):
        parts.append(
            f"""t{i} AS MATERIALIZED (SELECT seq, website, business_name, emails, n, hk FROM (
            SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, src DESC, seq DESC) AS rn FROM (
              SELECT 0 AS src, * FROM t{i - 1} WHERE {purged} UNION ALL
              SELECT 1, seq, website, business_name, emails, n, hk FROM w WHERE wave = {i}) WHERE hk <> '')
            WHERE rn = 1 AND {purged})"""
        )
    return with_tables("fx_leads", extra=", ".join(parts)) + (
        f"SELECT website, business_name, emails, n FROM t{waves - 1}"
    )


@query("stream_upsert", _upsert_sql())
def stream_upsert(spark, sf):
    """Leads arriving in four waves, merged into one table."""
    source, out = storage.new_path(spark, "waves"), storage.new_path(spark, "table")
    state = storage.new_path(spark, "state")
    leads_df = leads_table(spark, sf, "fx_leads")
    for stream in _in_waves(leads_df, "seq", source, top=_last_customer(spark, sf)):
        incremental.upsert_stream(stream, out, state).awaitTermination()
    current = incremental.current_leads(spark, out)
    n = sum((F.size(c) for c in vocab.CONTACT_LISTS), F.lit(0))
    return current.select("website", "business_name", join_list("emails").alias("emails"), n.alias("n"))


def _table_of(streams, spark, name):
    """Run a stream to its end into Parquet, each time more has arrived, and return the table."""
    out, state = storage.new_path(spark, name), storage.new_path(spark, "state")
    for stream in streams:
        q = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_new_domains",
    with_tables("fx_pages", "fx_prior")
    + f"""SELECT DISTINCT {d.host('url')} AS domain FROM fx_pages WHERE {d.host('url')} NOT IN
      (SELECT {d.host('website')} FROM fx_prior WHERE website <> '')""",
)
def stream_new_domains(spark, sf):
    pages = table(spark, sf, "fx_pages").select("site_seq", "url")
    prior = storage.materialize(leads_table(spark, sf, "fx_prior"), "prior")
    streams = _in_waves(
        pages, "site_seq", storage.new_path(spark, "pages"), top=_last_customer(spark, sf)
    )
    return _table_of((incremental.new_domains(s, prior) for s in streams), spark, "domains")


@query(
    "stream_cache_ttl",
    with_tables("fx_cache") + "SELECT DISTINCT left(sha256(query), 16) AS query_key, url FROM fx_cache",
)
def stream_cache_ttl(spark, sf):
    """Each cached URL of a query once within the lifetime of the cache."""
    rows = table(spark, sf, "fx_cache")
    at = F.lit(CLOCK).cast("timestamp") - F.make_dt_interval(hours=F.col("hours_ago").cast("int"))
    docs = rows.select(
        "query", at.alias("fetched_at"), F.array(F.struct("url", "title")).alias("urls"), "rank"
    )
    source = storage.new_path(spark, "cache-rows")
    docs.write.parquet(source)
    stream = spark.readStream.schema(docs.schema).parquet(source).drop("rank")
    valid = incremental.valid_results(stream).select("query_key", "url")
    return _table_of([valid], spark, "valid")


_REFRESH = f"""base AS (
  SELECT left(sha256(query), 16) AS query_key, url, TIMESTAMP '{CLOCK}' - to_hours(CAST(min(hours_ago) AS BIGINT)) AS first,
         40 + 20 * (CAST(min(hours_ago) AS BIGINT) // 40 % 5) AS step FROM fx_cache GROUP BY query, url
), captures AS (
  SELECT query_key, url, first + to_hours(k * step) AS at_time FROM base, (SELECT unnest(range(5)) AS k)
), taken AS (
  SELECT query_key, url, first AS at_time FROM base
  UNION ALL
  SELECT query_key, url, next FROM (
    SELECT t.query_key, t.url, min(c.at_time) AS next FROM taken t JOIN captures c
      ON c.query_key = t.query_key AND c.url = t.url AND c.at_time >= t.at_time + to_hours({vocab.CACHE_HOURS})
    GROUP BY t.query_key, t.url, t.at_time)
)"""


@query(
    "stream_cache_refresh",
    with_tables("fx_cache", extra=_REFRESH).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT query_key, url, strftime(at_time, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM taken",
)
def stream_cache_refresh(spark, sf):
    """Every URL is captured five times, in as many triggers; taken again only when 168 hours are over."""
    step = F.lit(40) + F.lit(20) * (F.floor(F.col("ago") / 40) % 5)
    first = table(spark, sf, "fx_cache").groupBy("query", "url").agg(F.min("hours_ago").cast("int").alias("ago"))
    captures = first.select(
        "query", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"),
        F.array(F.struct("url", F.lit("").alias("title"))).alias("urls"), "ago",
    ).select(
        "query", "urls", "k",
        (F.lit(CLOCK).cast("timestamp") + F.make_dt_interval(hours=(F.col("k") * step - F.col("ago")).cast("int"))).alias("fetched_at"),
    )
    streams = _in_waves(captures, "k", storage.new_path(spark, "captures"), waves=5, top=4)
    taken = (incremental.refreshed_results(s.drop("k"), late_hours=4 * vocab.CACHE_HOURS) for s in streams)
    return _table_of(taken, spark, "taken").select(
        "query_key", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at")
    )


_SEEN = f"""seen AS (
  SELECT {d.host('url')} AS domain, url, TIMESTAMP '{CLOCK}' + to_hours(k * step) AS at_time
  FROM (SELECT url, 40 + 20 * (length({d.host('url')}) % 5) AS step FROM fx_pages), (SELECT unnest(range(5)) AS k)
  WHERE {d.host('url')} NOT IN (SELECT {d.host('website')} FROM fx_prior WHERE website <> '')
), taken AS (
  SELECT domain, min(at_time) AS at_time FROM seen GROUP BY domain
  UNION ALL
  SELECT domain, next FROM (
    SELECT t.domain, min(s.at_time) AS next FROM taken t JOIN seen s
      ON s.domain = t.domain AND s.at_time >= t.at_time + to_hours({vocab.CACHE_HOURS}) GROUP BY t.domain, t.at_time)
)"""


@query(
    "stream_domain_lifetime",
    with_tables("fx_pages", "fx_prior", extra=_SEEN).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT domain, min(url) AS url, strftime(at_time, '%Y-%m-%d %H:%M:%S') AS seen_at
      FROM taken JOIN seen USING (domain, at_time) GROUP BY domain, at_time""",
)
def stream_domain_lifetime(spark, sf):
    """Every page is seen five times, in as many triggers; its domain is new again after 168 hours."""
    step = F.lit(40) + F.lit(20) * (F.length(urls.domain_of("url")) % 5)
    seen = table(spark, sf, "fx_pages").select(
        "url", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    ).select(
        "url", "k",
        (F.lit(CLOCK).cast("timestamp") + F.make_dt_interval(hours=(F.col("k") * step).cast("int"))).alias("seen_at"),
    )
    prior = storage.materialize(leads_table(spark, sf, "fx_prior"), "prior")
    streams = _in_waves(seen, "k", storage.new_path(spark, "seen"), waves=5, top=4)
    taken = (incremental.live_domains(s.drop("k"), prior, late_hours=4 * vocab.CACHE_HOURS) for s in streams)
    return _table_of(taken, spark, "live").select(
        "domain", "url", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at")
    )


@query("stream_log_metrics", with_tables("fx_log", extra=_PARSED) + f"SELECT {_METRICS}")
def stream_log_metrics(spark, sf):
    """Log lines read as a text stream; each starts with its time and id."""
    source, out = storage.new_path(spark, "log"), storage.new_path(spark, "metrics")
    stamp = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"),
        F.lpad(F.col("event_id").cast("string"), 20, "0"),
    )
    table(spark, sf, "fx_log").select(
        F.concat_ws(" | ", stamp, "line").alias("value")
    ).write.text(source)
    stream = (
        spark.readStream.option("maxFilesPerTrigger", 4).text(source).withColumnRenamed("value", "line")
    )
    order = F.split_part("line", F.lit(" | "), F.lit(1))
    q = incremental.log_metrics_stream(stream, order, out, storage.new_path(spark, "state"))
    q.awaitTermination()
    return spark.read.parquet(storage.version_path(out, storage.versions(spark, out)[-1]))


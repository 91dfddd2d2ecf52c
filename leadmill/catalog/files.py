"""Queries over scans and sinks.

Each writes what it needs to a fresh folder of the shared directory and reads
it back, so the files grow with the tables they are derived from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import storage
from leadmill.catalog import duck as d
from leadmill.catalog.derived import CLOCK, leads_table, table, with_tables
from leadmill.catalog.registry import query
from leadmill.functions import urls, vocab
from leadmill.functions.text import join_list
from leadmill.operators import logs, merge
from leadmill.sources import readers, results, writers

# -- text ---------------------------------------------------------------------


@query("seed_scan", with_tables("fx_pages") + "SELECT url FROM fx_pages")
def seed_scan(spark, sf):
    path = storage.new_path(spark, "seeds")
    lines = F.array(
        F.concat(F.lit("  "), "url", F.lit(" ")), F.concat(F.lit("# old "), "url"), F.lit("   "), F.lit("")
    )
    table(spark, sf, "fx_pages").select(F.explode(lines).alias("value")).write.text(path)
    return readers.read_seeds(spark, path).select("url")


@query(
    "log_scan",
    with_tables("fx_log")
    + "SELECT line FROM (SELECT line FROM fx_log ORDER BY ts DESC, event_id DESC LIMIT 500)",
)
def log_scan(spark, sf):
    """The last 500 lines of a log folder."""
    path = storage.new_path(spark, "log")
    table(spark, sf, "fx_log").orderBy("ts", "event_id").select("line").write.text(path)
    return logs.tail(readers.read_log(spark, path), ["file", "start", "row"], 500).select("line")


@query(
    "log_tail",
    with_tables("fx_log")
    + """SELECT event_id, line, row_number() OVER (ORDER BY ts, event_id) AS place FROM
      (SELECT * FROM fx_log ORDER BY ts DESC, event_id DESC LIMIT 80)""",
)
def log_tail(spark, sf):
    from pyspark.sql import Window

    last = logs.tail(table(spark, sf, "fx_log"), ["ts", "event_id"], 80)
    return last.select("event_id", "line", F.row_number().over(Window.orderBy("ts", "event_id")).alias("place"))


@query(
    "niche_scan",
    with_tables(
        "fx_pages",
        extra="n AS (SELECT * FROM (VALUES "
        + ", ".join(
            f"({i}, {d.q(n.id)}, {d.q(n.label)}, {len(n.scope_keywords)}, {d.q(n.search_queries[0])})"
            for i, n in enumerate([x for w in ("saas", "automotive", "ecommerce") for x in vocab.NICHES if x.id == w])
        )
        + ") t(niche_pos, niche, label, n_keywords, first_query))",
    )
    + """SELECT n.niche_pos, n.niche, n.label, n.n_keywords, n.first_query, count(*) AS n_pages
    FROM fx_pages p JOIN n ON p.niche = n.niche GROUP BY ALL""",
)
def niche_scan(spark, sf):
    """Asked-for niches in the order asked for (one unknown), with their pages."""
    dim = readers.niche_table(spark, ["saas", "nonsense", "automotive", "ecommerce"])
    named = dim.select(
        "niche_pos", F.col("id").alias("niche"), "label",
        F.size("scope_keywords").alias("n_keywords"), F.element_at("search_queries", 1).alias("first_query"),
    )
    counts = table(spark, sf, "fx_pages").groupBy("niche").agg(F.count(F.lit(1)).alias("n_pages"))
    return named.join(counts, "niche")


# -- leads --------------------------------------------------------------------

_READ_COLS = (
    "business_name", "niche", "website", *vocab.CONTACT_LISTS, "source_query", "email_origin", "scraped_at"
)
_READ_SQL = (
    "SELECT CASE WHEN business_name = '' THEN 'Unknown' ELSE business_name END AS business_name, niche, "
    "nullif(website, '') AS website, "
    + ", ".join(vocab.CONTACT_LISTS)
    + ", nullif(source_query, '') AS source_query, email_origin, scraped_at FROM fx_leads"
)


def _shown(df):
    return df.select(*[join_list(c).alias(c) if c in vocab.CONTACT_LISTS else c for c in _READ_COLS])


def _write_csv(spark, df, name="leads"):
    path = storage.new_path(spark, name)
    writers.write_csv(writers.flat_rows(df), path)
    return path


@query("lead_csv_scan", with_tables("fx_leads") + _READ_SQL)
def lead_csv_scan(spark, sf):
    path = _write_csv(spark, leads_table(spark, sf, "fx_leads"))
    return _shown(readers.read_lead_csv(spark, path))


@query("lead_json_scan", with_tables("fx_leads") + _READ_SQL + " UNION ALL " + _READ_SQL)
def lead_json_scan(spark, sf):
    """The envelope document and the JSON-lines form of the same leads."""
    df = leads_table(spark, sf, "fx_leads")
    one, lines = storage.new_path(spark, "doc") + ".json", storage.new_path(spark, "rows") + ".jsonl"
    writers.write_json(df, one, envelope=True)
    writers.write_json(df, lines)
    return _shown(readers.read_leads(spark, one)).unionByName(_shown(readers.read_leads(spark, lines)))


@query("lead_scan_tolerant", with_tables("fx_leads") + _READ_SQL)
def lead_scan_tolerant(spark, sf):
    """A missing and a corrupt export add nothing to a good one."""
    df = leads_table(spark, sf, "fx_leads")
    good = _write_csv(spark, df)
    broken = storage.new_path(spark, "broken") + ".json"
    df.select(F.concat(F.lit('{"leads": [{"business_name": "'), "business_name").alias("value")).write.text(broken)
    missing = storage.new_path(spark, "missing") + ".csv"
    parts = [_shown(readers.read_leads(spark, p)) for p in (missing, broken, good)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "lead_lenient_scan",
    with_tables(
        "fx_leads",
        extra=f"""t AS (SELECT *, {d.score()} AS own, seq % 6 AS m FROM fx_leads)""",
    )
    + f"""SELECT CASE WHEN business_name = '' THEN 'Unknown' ELSE business_name END AS business_name, website,
      emails, phones,
      CASE WHEN m = 0 OR m = 5 OR (m = 4 AND seq % 100 = 0) THEN own WHEN m = 1 THEN 0
        ELSE seq % 100 END AS quality_score,
      CASE WHEN m = 0 OR m = 5 OR (m = 4 AND seq % 100 = 0) THEN {d.label('own')} ELSE 'high' END AS quality_label,
      CASE WHEN seq % 3 = 0 THEN 'scraped' ELSE email_origin END AS email_origin FROM t""",
)
def lead_lenient_scan(spark, sf):
    """Arrays and joined text, odd labels, missing and bad scores; envelopes
    and bare arrays of up to fifty leads, one document per line."""
    df = leads_table(spark, sf, "fx_leads")
    m = F.col("seq") % 6
    as_text = F.col("seq") % 2 == 0

    def lists(c):
        return F.when(as_text, F.to_json(F.struct(F.array_join(c, " | ").alias("x")))).otherwise(
            F.to_json(F.struct(F.col(c).alias("x")))
        )

    def raw(c):
        return F.regexp_extract(lists(c), r'(?s)^\{"x":(.*)\}$', 1)

    # Score as text, bad text, number; label valid, upper case, invalid.
    score = (
        F.when(m == 0, F.lit('""')).when(m == 1, F.lit('"bad"'))
        .when(m == 4, (F.col("seq") % 100).cast("string"))
        .otherwise(F.concat(F.lit('"'), (F.col("seq") % 100).cast("string"), F.lit('"')))
    )
    label = F.when(m == 5, F.lit("top")).when(m == 3, F.lit(" HIGH ")).otherwise(F.lit("high"))
    origin = F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("email_origin"))
    item = F.concat(
        F.lit('{"business_name": "'), "business_name", F.lit('", "niche": "'), "niche",
        F.lit('", "website": "'), "website", F.lit('", "emails": '), raw("emails"),
        F.lit(', "phones": '), raw("phones"), F.lit(', "quality_score": '), score,
        F.lit(', "quality_label": "'), label, F.lit('", "email_origin": "'), origin,
        F.lit('", "whatsapp_numbers": '), raw("whatsapp_numbers"),
        F.lit(', "instagram_handles": '), raw("instagram_handles"),
        F.lit(', "linkedin_urls": '), raw("linkedin_urls"), F.lit("}"),
    )
    block = F.floor(F.col("seq") / 50)
    docs = df.groupBy(block.alias("b")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    bare = F.concat(F.lit("["), "items", F.lit("]"))
    env = F.concat(F.lit('{"leads": ['), "items", F.lit(', "junk"]}'))
    path = storage.new_path(spark, "any") + ".json"
    docs.select(F.when(F.col("b") % 2 == 0, bare).otherwise(env).alias("value")).write.text(path)
    read = readers.read_lead_files(spark, [path], json_per_line=True)
    return read.select(
        "business_name", "website", join_list("emails").alias("emails"), join_list("phones").alias("phones"),
        "quality_score", "quality_label", "email_origin",
    )


@query(
    "lead_multi_scan",
    with_tables(
        "fx_leads", "fx_prior",
        extra=f"""both_ AS (SELECT 0 AS age, * FROM fx_leads UNION ALL SELECT 1, * FROM fx_prior),
        named AS (SELECT *, CASE WHEN business_name = '' THEN 'Unknown' ELSE business_name END AS bn FROM both_),
        keyed AS (SELECT *, CASE WHEN website <> '' THEN {d.host_key('website')} ELSE lower(bn) END AS hk,
          {d.count()} AS n FROM named)""",
    )
    + f"""SELECT hk AS site, age, n, emails, {d.score()} AS quality_score FROM (SELECT *, row_number() OVER (PARTITION BY hk
      ORDER BY n DESC, age DESC, seq DESC) AS rn FROM keyed) WHERE rn = 1""",
)
def lead_multi_scan(spark, sf):
    """Two exports of different age, an empty and a missing file, merged."""
    old, new = storage.new_path(spark, "old"), storage.new_path(spark, "new")
    for name, path in (("fx_prior", old), ("fx_leads", new)):
        rows = leads_table(spark, sf, name).repartitionByRange("seq").sortWithinPartitions("seq")
        writers.write_csv(writers.flat_rows(rows), path)
    read = readers.read_lead_files(spark, [new, old, old + "-missing", new])
    merged = merge.merge_lead_files(read, ["age", "seq"])
    name = F.coalesce(F.nullif("website", F.lit("")), "business_name")
    n = sum((F.size(c) for c in vocab.CONTACT_LISTS), F.lit(0))
    return merged.select(
        urls.host_key(name).alias("site"), "age", n.alias("n"), join_list("emails").alias("emails"), "quality_score"
    )


# -- sinks --------------------------------------------------------------------


@query(
    "export_flat",
    with_tables("fx_leads", extra=f"t AS (SELECT *, {d.score()} AS quality_score FROM fx_leads)")
    + f"SELECT {', '.join(c if c != 'quality_label' else d.label('quality_score') + ' AS quality_label' for c in vocab.EXPORT_COLUMNS)} FROM t",
)
def export_flat(spark, sf):
    """Rows of the CSV export, read back as plain text columns."""
    path = _write_csv(spark, leads_table(spark, sf, "fx_leads"))
    back = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    back = back.toDF(*vocab.EXPORT_COLUMNS)
    return back.select(
        *[
            F.col(c).cast("int").alias(c) if c == "quality_score" else F.coalesce(c, F.lit("")).alias(c)
            for c in vocab.EXPORT_COLUMNS
        ]
    )


def _json_list(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '[]' ELSE '[\"' || replace({c}, ' | ', '\",\"') || '\"]' END"


_JSON = (
    "'{\"business_name\":\"' || business_name || '\",\"niche\":\"' || niche || '\",\"website\":\"' || website || '\"'"
    + "".join(f" || ',\"{c}\":' || {_json_list(c)}" for c in vocab.CONTACT_LISTS)
    + " || ',\"source_query\":\"' || source_query || '\",\"quality_score\":' || CAST(s AS STRING)"
    + f" || ',\"quality_label\":\"' || {d.label('s')} || '\",\"email_origin\":\"' || email_origin"
    + " || '\",\"scraped_at\":\"' || scraped_at || '\"}'"
)


@query(
    "export_envelope",
    with_tables(
        "fx_leads",
        extra=f"t AS (SELECT *, {d.score()} AS s FROM fx_leads), "
        "r AS (SELECT *, row_number() OVER (ORDER BY s DESC, seq) AS rn FROM t)",
    )
    + f"""SELECT 1 AS part, CASE WHEN rn > 1 THEN ',' ELSE '' END || {_JSON} AS value FROM r
    UNION ALL SELECT 0, '{{"generated_at": "{CLOCK}", "lead_count": ' || CAST((SELECT count(*) FROM t) AS STRING) || ', "leads": ['
    UNION ALL SELECT 2, ']}}'""",
)
def export_envelope(spark, sf):
    lines = writers.envelope_lines(leads_table(spark, sf, "fx_leads"), F.lit(CLOCK))
    return lines.select("part", "value")


@query(
    "export_merge",
    with_tables(
        "fx_leads", "fx_prior",
        extra=f"""filed AS (SELECT *, row_number() OVER (ORDER BY {d.score()} DESC, seq) AS place FROM fx_prior
          WHERE NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}),
        both_ AS (SELECT 0 AS src, place, * EXCLUDE (place) FROM filed
          UNION ALL SELECT 1, seq, * FROM fx_leads),
        keyed AS (SELECT *, {d.host_key('website')} AS hk, {d.count()} AS n FROM both_),
        m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, src DESC, place DESC) AS rn
          FROM keyed WHERE hk <> '') WHERE rn = 1)""",
    )
    + f"""SELECT website, CASE WHEN business_name = '' AND src = 0 THEN 'Unknown' ELSE business_name END AS business_name,
      emails, {d.score()} AS quality_score FROM m
    WHERE NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}""",
)
def export_merge(spark, sf):
    """Export the prior leads, then merge the new ones into that export."""
    path = storage.new_path(spark, "export") + ".csv"
    writers.export_leads(leads_table(spark, sf, "fx_prior"), path)
    writers.export_leads(leads_table(spark, sf, "fx_leads"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).toDF(*vocab.EXPORT_COLUMNS)
    return back.select(
        "website", F.coalesce("business_name", F.lit("")).alias("business_name"),
        F.coalesce("emails", F.lit("")).alias("emails"), F.col("quality_score").cast("int").alias("quality_score"),
    )


@query(
    "export_dashboard",
    with_tables("fx_leads", extra=f"t AS (SELECT *, {d.score()} AS quality_score FROM fx_leads)")
    + f"SELECT {', '.join(c if c != 'quality_label' else d.label('quality_score') + ' AS quality_label' for c in writers.DASHBOARD_COLUMNS)} FROM t",
)
def export_dashboard(spark, sf):
    return writers.dashboard_rows(merge.with_quality(leads_table(spark, sf, "fx_leads")))


@query(
    "cache_key",
    with_tables("fx_cache") + "SELECT DISTINCT query, left(sha256(query), 16) AS query_key FROM fx_cache",
)
def cache_key(spark, sf):
    """Keys of the cache table after its documents were written twice."""
    path = storage.new_path(spark, "cache")
    docs = _cache_docs(spark, sf)
    writers.upsert_cache(spark, docs, path)
    writers.upsert_cache(spark, docs, path)
    return spark.read.parquet(path).select("query", "query_key")


@query(
    "cache_log",
    with_tables("fx_cache")
    + """SELECT query, left(sha256(query), 16) AS query_key, url,
      CASE WHEN hours_ago % 3 = 0 THEN 'new' WHEN hours_ago % 2 = 0 THEN 'newer' ELSE title END AS title FROM fx_cache""",
)
def cache_log(spark, sf):
    """A cache kept as a log, put in three calls; the last one merges its pieces."""
    path = storage.new_path(spark, "cache-log")
    docs = _cache_docs(spark, sf)
    hours = (F.lit(CLOCK).cast("timestamp").cast("long") - F.col("fetched_at").cast("timestamp").cast("long")) / 3600

    def again(title):
        return docs.withColumn("urls", F.transform("urls", lambda u: F.struct(u["url"].alias("url"), F.lit(title).alias("title"))))

    writers.log_cache(spark, docs, path)
    writers.log_cache(spark, again("newer").filter(hours % 2 == 0), path)
    writers.log_cache(spark, again("new").filter(hours % 3 == 0), path, max_pieces=2)
    return writers.read_cache_log(spark, path).select("query", "query_key", F.inline("urls"))


# -- search results -----------------------------------------------------------


def _cache_docs(spark, sf):
    """One document per query with its results in rank order."""
    rows = table(spark, sf, "fx_cache")
    fetched = F.lit(CLOCK).cast("timestamp") - F.make_dt_interval(hours=F.col("hours_ago").cast("int"))
    urls_ = F.array_sort(F.collect_list(F.struct("rank", "url", "title")))
    return (
        rows.groupBy("query", "niche", "hours_ago")
        .agg(F.transform(urls_, lambda u: F.struct(u["url"].alias("url"), u["title"].alias("title"))).alias("urls"))
        .select("query", "niche", fetched.cast("string").alias("fetched_at"), "urls")
    )


@query(
    "cache_fresh_scan",
    with_tables("fx_cache") + "SELECT query, url, title FROM fx_cache WHERE hours_ago < 168",
)
def cache_fresh_scan(spark, sf):
    """Cache documents as JSON; results without a title are bare text."""
    path = storage.new_path(spark, "cache-docs")
    docs = _cache_docs(spark, sf)
    item = F.transform(
        "urls",
        lambda u: F.when(u["title"] == "", F.concat(F.lit('"'), u["url"], F.lit('"'))).otherwise(F.to_json(u)),
    )
    doc = F.concat(
        F.lit('{"query": "'), "query", F.lit('", "fetched_at": "'), "fetched_at", F.lit('", "urls": ['),
        F.array_join(item, ","), F.lit("]}"),
    )
    docs.select(doc.alias("value")).write.text(path)
    fresh = readers.fresh_only(readers.read_cache(spark, path), now=F.lit(CLOCK).cast("timestamp"))
    return fresh.select("query", F.inline("urls"))


@query(
    "serp_json_parse",
    with_tables("fx_serp_json")
    + """SELECT query, 'https://biz' || CAST(g AS STRING) || '.com/' AS url, 'Biz ' || CAST(g AS STRING) AS title
      FROM fx_serp_json UNION ALL
    SELECT query, 'https://biz' || CAST(g AS STRING) || '.com/team', '' FROM fx_serp_json""",
)
def serp_json_parse(spark, sf):
    return results.json_results(table(spark, sf, "fx_serp_json"), ["query"]).select("query", "url", "title")


def _rss_captures(spark, sf):
    """One in seven captures also shows a bot check."""
    checked = F.when(F.col("g") % 7 == 3, F.concat("body", F.lit("<!-- Are you a ROBOT? -->"))).otherwise(F.col("body"))
    return table(spark, sf, "fx_serp_rss").withColumn("body", checked)


@query(
    "serp_rss_parse",
    with_tables("fx_serp_rss")
    + """SELECT query, 'https://biz' || CAST(g AS STRING) || '.com/' AS url, 'Biz & Co ' || CAST(g AS STRING) AS title
      FROM fx_serp_rss WHERE g % 7 <> 3 UNION ALL
    SELECT query, 'https://biz' || CAST(g AS STRING) || '.com/team', '' FROM fx_serp_rss WHERE g % 7 <> 3""",
)
def serp_rss_parse(spark, sf):
    return results.rss_results(_rss_captures(spark, sf), ["query"]).select("query", "url", "title")


@query(
    "serp_rss_first",
    with_tables("fx_serp_rss")
    + """SELECT query, g, 'https://biz' || CAST(g AS STRING) || '.com/' AS url FROM fx_serp_rss WHERE g % 7 <> 3""",
)
def serp_rss_first(spark, sf):
    """The first distinct result of each capture."""
    return results.rss_results(_rss_captures(spark, sf), ["query", "g"], limit=1).select("query", "g", "url")



@query(
    "serp_html_parse",
    with_tables("fx_serp_html", extra="t AS (SELECT *, 'https://biz' || CAST(g AS STRING) || '.com/' AS home FROM fx_serp_html)")
    + """SELECT query, engine, CASE engine WHEN 'bing' THEN home || 'p' || CAST(k AS STRING) ELSE home END AS url,
      'Biz ' || CAST(g AS STRING) || ' & Co' AS title FROM t UNION ALL
    SELECT query, engine, home || 'team', CASE engine WHEN 'ddg' THEN 'About us' ELSE 'Team' END FROM t""",
)
def serp_html_parse(spark, sf):
    captures = table(spark, sf, "fx_serp_html")
    return results.html_results(captures, ["query"]).select("query", "engine", "url", "title")

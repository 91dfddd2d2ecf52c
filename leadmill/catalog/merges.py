"""Queries over dedupe, merge, ranking, sorting and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.catalog import duck as d
from leadmill.catalog.derived import leads_table, table, with_tables
from leadmill.catalog.registry import query
from leadmill.functions import urls, vocab
from leadmill.functions.text import join_list
from leadmill.operators import merge, rank, views

# -- contact lists ------------------------------------------------------------


def _union_sql(c: str) -> str:
    return (
        f"coalesce((SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT "
        f"unnest(string_split({c}, ' | ')) AS v FROM fx_leads x WHERE {c} <> '' AND {d.host('x.website')} = s.site)), '')"
    )


_SITES = f"s AS (SELECT DISTINCT {d.host('website')} AS site FROM fx_leads)"


def _exploded(c: str) -> str:
    return (
        f"SELECT {d.host('website')} AS site, {d.q(c)} AS kind, "
        f"unnest(string_split({c}, ' | ')) AS value FROM fx_leads WHERE {c} <> ''"
    )


_LONG = "v AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(_exploded(c) for c in vocab.CONTACT_LISTS) + "))"
_ORIGIN = """CASE WHEN bool_and(email_origin = 'inferred') FILTER (WHERE emails <> '') THEN 'inferred'
  WHEN bool_or(email_origin <> 'scraped') FILTER (WHERE emails <> '') THEN 'mixed' ELSE 'scraped' END"""


@query(
    "contacts_merge",
    with_tables("fx_leads", extra=f"{_LONG}, o AS (SELECT {d.host('website')} AS site, {_ORIGIN} AS email_origin FROM fx_leads GROUP BY 1)")
    + "SELECT o.site, o.email_origin, "
    + ", ".join(
        f"coalesce(string_agg(value, ' | ' ORDER BY value) FILTER (WHERE kind = {d.q(c)}), '') AS {c}"
        for c in vocab.CONTACT_LISTS
    )
    + " FROM o LEFT JOIN v ON o.site = v.site GROUP BY o.site, o.email_origin",
)
def contacts_merge(spark, sf):
    df = leads_table(spark, sf, "fx_leads").withColumn("site", urls.host_of("website"))
    merged = merge.merge_contacts(df, "site")
    return merged.select("site", "email_origin", *[join_list(c).alias(c) for c in vocab.CONTACT_LISTS])


@query(
    "contact_counts",
    with_tables("fx_leads", extra=_LONG)
    + "SELECT site, "
    + ", ".join(f"count(*) FILTER (WHERE kind = {d.q(c)}) AS n_{c}" for c in vocab.CONTACT_LISTS)
    + " FROM v GROUP BY site",
)
def contact_counts(spark, sf):
    df = leads_table(spark, sf, "fx_leads").withColumn("site", urls.host_of("website"))
    return merge.contact_counts(df, "site")


@query(
    "origin_merge",
    with_tables("fx_leads") + f"SELECT {d.host('website')} AS site, {_ORIGIN} AS email_origin FROM fx_leads GROUP BY 1",
)
def origin_merge(spark, sf):
    df = leads_table(spark, sf, "fx_leads").withColumn("site", urls.host_of("website"))
    return merge.merge_origins(df, "site")


# -- leads --------------------------------------------------------------------

MERGED = f"""both_ AS (SELECT 0 AS src, * FROM fx_prior UNION ALL SELECT 1, * FROM fx_leads),
keyed AS (SELECT *, {d.host_key('website')} AS hk, {d.count()} AS n FROM both_),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, src DESC, seq DESC) AS rn
  FROM keyed WHERE hk <> '') WHERE rn = 1)"""


@query(
    "lead_merge",
    with_tables("fx_leads", "fx_prior", extra=MERGED)
    + "SELECT hk AS site, business_name, website, emails, phones, email_origin FROM merged",
)
def lead_merge(spark, sf):
    merged = merge.merge_leads(leads_table(spark, sf, "fx_leads"), leads_table(spark, sf, "fx_prior"))
    return merged.select(
        urls.host_key("website").alias("site"), "business_name", "website",
        join_list("emails").alias("emails"), join_list("phones").alias("phones"), "email_origin",
    )


@query(
    "lead_dedupe",
    with_tables("fx_leads")
    + f"""SELECT 'website' AS by, {d.host_key('website')} AS value, min(seq) AS seq FROM fx_leads GROUP BY 2
    UNION ALL SELECT 'business_name', lower(business_name), min(seq) FROM fx_leads GROUP BY 2""",
)
def lead_dedupe(spark, sf):
    """By host, and by another column."""
    df = leads_table(spark, sf, "fx_leads")
    by_host = merge.dedupe_leads(df).select(
        F.lit("website").alias("by"), urls.host_key("website").alias("value"), "seq"
    )
    by_name = merge.dedupe_leads(df, "business_name").select(
        F.lit("business_name").alias("by"), F.lower("business_name").alias("value"), "seq"
    )
    return by_host.unionByName(by_name)


@query(
    "lead_merge_files",
    with_tables(
        "fx_leads", "fx_prior",
        extra=f"""both_ AS (SELECT 0 AS src, * FROM fx_leads UNION ALL SELECT 1, * FROM fx_prior),
    keyed AS (SELECT *, CASE WHEN website <> '' THEN {d.host_key('website')} ELSE lower(business_name) END AS hk,
      {d.count()} AS n FROM both_)""",
    )
    + """SELECT hk AS site, src AS age, seq AS place FROM (SELECT *, row_number() OVER (PARTITION BY hk
      ORDER BY n DESC, src DESC, seq DESC) AS rn FROM keyed WHERE hk <> '') WHERE rn = 1""",
)
def lead_merge_files(spark, sf):
    """New leads as the newest file, prior leads as an older one."""
    new = leads_table(spark, sf, "fx_leads").withColumn("age", F.lit(0))
    old = leads_table(spark, sf, "fx_prior").withColumn("age", F.lit(1))
    merged = merge.merge_lead_files(new.unionByName(old), ["age", "seq"])
    name = F.coalesce(F.nullif("website", F.lit("")), "business_name")
    return merged.select(urls.host_key(name).alias("site"), "age", F.col("seq").alias("place"))


@query(
    "lead_sort",
    with_tables("fx_leads")
    + f"""SELECT seq, {d.score()} AS quality_score,
      row_number() OVER (ORDER BY {d.score()} DESC, seq) AS place FROM fx_leads""",
)
def lead_sort(spark, sf):
    """All leads in order, best first."""
    scored = merge.with_quality(leads_table(spark, sf, "fx_leads"))
    ordered = merge.best_first(scored.select("seq", "quality_score"), "seq")
    return merge.numbered(ordered).select("seq", "quality_score", "place")


@query(
    "lead_sort_view",
    with_tables("fx_leads")
    + f"""SELECT seq, {d.score()} AS quality_score, scraped_at,
      row_number() OVER (ORDER BY {d.score()} DESC, scraped_at DESC, seq) AS place FROM fx_leads""",
)
def lead_sort_view(spark, sf):
    scored = merge.with_quality(leads_table(spark, sf, "fx_leads"))
    ordered = merge.newest_best_first(scored.select("seq", "quality_score", "scraped_at"), "seq")
    return merge.numbered(ordered).select("seq", "quality_score", "scraped_at", "place")


@query(
    "lead_topn",
    with_tables("fx_leads")
    + """SELECT niche, seq FROM (SELECT niche, seq, row_number() OVER (PARTITION BY niche ORDER BY seq) AS rn
      FROM fx_leads) WHERE rn <= 20""",
)
def lead_topn(spark, sf):
    df = leads_table(spark, sf, "fx_leads")
    return merge.top_n_per_key(df, ["niche"], ["seq"], 20).select("niche", "seq")


@query(
    "niche_union",
    with_tables("fx_leads", "fx_prior")
    + f"""SELECT hk AS site, niche_pos, seq FROM (SELECT *, row_number() OVER (PARTITION BY hk
      ORDER BY niche_pos, seq) AS rn FROM (
        SELECT 1 AS niche_pos, seq, {d.host_key('website')} AS hk FROM fx_leads
        UNION ALL SELECT 0, seq, {d.host_key('website')} FROM fx_prior)) WHERE rn = 1""",
)
def niche_union(spark, sf):
    a = leads_table(spark, sf, "fx_prior").withColumn("niche_pos", F.lit(0))
    b = leads_table(spark, sf, "fx_leads").withColumn("niche_pos", F.lit(1))
    return merge.union_niches(a, b).select(urls.host_key("website").alias("site"), "niche_pos", "seq")


@query(
    "lead_stats",
    with_tables("fx_leads", extra=f"s AS (SELECT *, {d.label(d.score())} AS label FROM fx_leads)")
    + """SELECT count(*) FILTER (WHERE label = 'high') AS n_high,
      count(*) FILTER (WHERE label = 'medium') AS n_medium, count(*) FILTER (WHERE label = 'low') AS n_low,
      count(*) FILTER (WHERE emails <> '') AS n_email,
      count(*) FILTER (WHERE niche = 'saas' AND emails <> '') AS n_shown, count(*) AS n_total FROM s""",
)
def lead_stats(spark, sf):
    df = merge.with_quality(leads_table(spark, sf, "fx_leads"))
    return views.lead_stats(df, niche="saas", has_email=True)


@query(
    "lead_niches",
    with_tables("fx_leads")
    + "SELECT string_agg(DISTINCT niche, ' | ' ORDER BY niche) AS niches, count(*) AS total FROM fx_leads",
)
def lead_niches(spark, sf):
    df = views.lead_niches(leads_table(spark, sf, "fx_leads"))
    return df.select(join_list("niches").alias("niches"), "total")


@query(
    "run_delta",
    with_tables(
        "fx_leads", "fx_prior",
        extra=f"""o AS (SELECT DISTINCT {d.host_key('website')} AS site FROM fx_prior),
        n AS (SELECT DISTINCT {d.host_key('website')} AS site FROM fx_leads)""",
    )
    + """SELECT site, 'added' AS change FROM (SELECT site FROM n EXCEPT SELECT site FROM o)
    UNION ALL SELECT site, 'removed' FROM (SELECT site FROM o EXCEPT SELECT site FROM n)
    UNION ALL SELECT 'total', CAST((SELECT count(*) FROM fx_leads) - (SELECT count(*) FROM fx_prior) AS STRING)""",
)
def run_delta(spark, sf):
    before, after = leads_table(spark, sf, "fx_prior"), leads_table(spark, sf, "fx_leads")
    total = views.run_delta_counts(before, after).select(
        F.lit("total").alias("site"), F.col("delta").cast("string").alias("change")
    )
    return views.run_delta(before, after).unionByName(total)


# -- search results -----------------------------------------------------------


def hay(url: str = "url", title: str = "title") -> str:
    return f"lower({url} || ' ' || coalesce({title}, ''))"


def cand_score(h: str, url: str, title: str, niche: str) -> str:
    def words(phrases, points):
        return " + ".join(f"CASE WHEN contains({h}, {d.q(p)}) THEN {points} ELSE 0 END" for p in phrases)

    per_niche = d.by_niche(
        niche, lambda n: f"({words(n.scope_keywords, 2)} + {words(n.exclusion_keywords, -4)})", "0"
    )
    return (
        f"CASE WHEN {d.brand_name(title)} THEN -100 ELSE {per_niche} + {words(vocab.JUNK_TITLE_PHRASES, -3)} "
        f"+ CASE WHEN {d.depth(url)} <= 1 THEN 1 ELSE 0 END END"
    )


def ok_ratio(n: str, hits: str) -> str:
    return f"({n} = 0 OR {hits} >= greatest(1, CAST(floor({n} * 0.3) AS BIGINT)))"


@query(
    "serp_relevant",
    with_tables(
        "fx_serp",
        extra=f"""a AS (SELECT query, engine_pos, count(*) AS n_results,
          count(*) FILTER (WHERE {d.in_scope(hay(), 'niche')}) AS n_hits FROM fx_serp GROUP BY 1, 2)""",
    )
    + f"SELECT query, engine_pos, n_results, n_hits, {ok_ratio('n_results', 'n_hits')} AS relevant FROM a",
)
def serp_relevant(spark, sf):
    return rank.relevance(table(spark, sf, "fx_serp"), ["query", "engine_pos"])


@query(
    "cand_score",
    with_tables("fx_serp") + f"SELECT rank, {cand_score(hay(), 'url', 'title', 'niche')} AS score FROM fx_serp",
)
def cand_score_query(spark, sf):
    return rank.score_candidates(table(spark, sf, "fx_serp")).select("rank", "score")


RANKED = f"""sc AS (SELECT *, {cand_score(hay(), 'url', 'title', 'niche')} AS score FROM fx_serp),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY score DESC, query_pos, rank) AS pos
  FROM sc WHERE score >= -2) WHERE pos <= 60)"""


@query(
    "cand_rank",
    with_tables("fx_serp", extra=RANKED) + "SELECT niche, pos AS probe_pos, query, rank, url, score FROM ranked",
)
def cand_rank(spark, sf):
    ranked = rank.rank_candidates(table(spark, sf, "fx_serp"), max_leads=20)
    return ranked.select("niche", "probe_pos", "query", "rank", "url", "score")


@query(
    "skip_prior",
    with_tables("fx_serp", "fx_prior")
    + f"""SELECT rank, url FROM fx_serp WHERE {d.host('url')} NOT IN
      (SELECT {d.host('website')} FROM fx_prior WHERE {d.host('website')} <> '')""",
)
def skip_prior(spark, sf):
    return rank.skip_prior(
        table(spark, sf, "fx_serp"), leads_table(spark, sf, "fx_prior")
    ).select("rank", "url")


@query(
    "url_first",
    with_tables("fx_serp")
    + """SELECT niche, url, rank FROM (SELECT niche, url, rank, row_number() OVER
      (PARTITION BY niche, url ORDER BY query_pos, rank) AS rn FROM fx_serp) WHERE rn = 1""",
)
def url_first(spark, sf):
    return merge.distinct_urls(table(spark, sf, "fx_serp"), ["niche"], ["query_pos", "rank"]).select(
        "niche", "url", "rank"
    )


@query(
    "serp_limit",
    with_tables("fx_serp", extra="u AS (SELECT query, engine_pos, url, min(rank) AS rank FROM fx_serp GROUP BY 1, 2, 3)")
    + """SELECT query, engine_pos, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY query, engine_pos ORDER BY rank) AS rn FROM u) WHERE rn <= 10""",
)
def serp_limit(spark, sf):
    return rank.first_results(table(spark, sf, "fx_serp"), ["query", "engine_pos"], 10).select(
        "query", "engine_pos", "rank"
    )


CHOSEN = f"""rooted AS (SELECT *, {d.to_root('url')} AS root FROM fx_serp),
judged AS (SELECT query, niche, engine_pos,
    count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok AND hit) AS hits
  FROM (SELECT query, niche, engine_pos, {d.is_page('root')} AND NOT {d.denied('root')} AS ok,
    {d.in_scope(hay('root'), 'niche')} AS hit FROM rooted) GROUP BY 1, 2, 3),
chosen AS (SELECT query, niche, min(engine_pos) AS engine_pos FROM judged WHERE {ok_ratio('n', 'hits')} GROUP BY 1, 2)"""


@query(
    "engine_first",
    with_tables("fx_serp", extra=CHOSEN)
    + """SELECT r.query, r.engine_pos, r.rank, r.url FROM fx_serp r
      JOIN chosen c ON r.query = c.query AND r.niche = c.niche AND r.engine_pos = c.engine_pos""",
)
def engine_first(spark, sf):
    return rank.first_engine(table(spark, sf, "fx_serp")).select("query", "engine_pos", "rank", "url")


@query(
    "cache_live_union",
    with_tables("fx_cache", "fx_serp")
    + """SELECT query, source_rank, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY query, url
      ORDER BY source_rank, rank) AS rn FROM (
        SELECT query, 0 AS source_rank, rank, url FROM fx_cache
        UNION ALL SELECT query, 1, rank, url FROM fx_serp)) WHERE rn = 1""",
)
def cache_live_union(spark, sf):
    both = merge.cached_then_live(table(spark, sf, "fx_cache"), table(spark, sf, "fx_serp"))
    return both.select("query", "source_rank", "rank", "url")

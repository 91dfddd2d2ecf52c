"""Queries over whole runs: sub-pages, enrichment, seed and search mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill import storage
from leadmill.catalog import duck as d
from leadmill.catalog.derived import CLOCK, leads_table, table, with_tables
from leadmill.catalog.files import _cache_docs
from leadmill.catalog.merges import CHOSEN, cand_score, hay, ok_ratio
from leadmill.catalog.registry import query
from leadmill.functions import urls, vocab
from leadmill.functions.text import join_list
from leadmill.operators import enrich, merge
from leadmill.operators.pages import page_facts
from leadmill.plans import collect

LISTS = vocab.CONTACT_LISTS
STAMP = "2024-06-01T00:00:00+00:00"


def facts_of(spark, sf):
    """Page facts of the derived crawl, written once for all later steps."""
    return storage.materialize(page_facts(table(spark, sf, "fx_pages")), "facts")


def lookups(spark, sf):
    return collect.Lookups(
        table(spark, sf, "fx_social"), table(spark, sf, "fx_mx"), table(spark, sf, "fx_mailbox")
    )


def seeds_of(spark, sf):
    return table(spark, sf, "fx_pages").select("url", "niche", F.col("site_seq").alias("seq"))


# -- the same steps as SQL ----------------------------------------------------

_FACTS = f"""texts AS MATERIALIZED (SELECT url, html, {d.visible_text('html')} AS text, {d.links('html')} AS links,
  {d.contact_links('html')} AS clinks, {d.name('html', 'url')} AS name FROM fx_pages),
lists AS MATERIALIZED (SELECT *, lower(text) AS low,
  {d.uniq(f"list_concat(list_concat(list_concat({d.plain_emails('text')}, {d.obfuscated_emails('text')}), {d.mailto_emails('links')}), {d.html_emails('html')})")} AS emails,
  {d.whatsapp('links', 'text')} AS whatsapp_numbers, {d.instagram('links', 'text')} AS instagram_handles,
  {d.linkedin('links', 'text')} AS linkedin_urls, {d.phones('text')} AS all_phones,
  {d.mailto_html('html')} AS mailto FROM texts),
facts AS MATERIALIZED (SELECT *, CASE WHEN len(whatsapp_numbers) = 0 THEN all_phones ELSE [] END AS phones,
  {d.contactable('text')} AS contactable FROM lists)"""

_SEEDS = f"""sites AS MATERIALIZED (SELECT url, niche, min(site_seq) AS seq, 'seed' AS query FROM fx_pages
  WHERE {d.is_page('url')} AND NOT {d.denied('url')} GROUP BY 1, 2)"""

_KEPT = f"""kept AS MATERIALIZED (SELECT s.niche, s.seq, s.query, f.* FROM sites s JOIN facts f ON s.url = f.url
  WHERE f.html <> '' AND {d.reason('f.low', 's.niche')} IS NULL AND NOT {d.brand_name('f.name')})"""

_GUESSES = "[" + ", ".join(d.q(p) for p in vocab.GUESSED_CONTACT_PATHS) + "]"


def _frontier(source: str) -> str:
    site = f"{d.scheme('url')} || '://' || {d.netloc('url')}"
    return f"""raw_f AS (SELECT url, niche, list_transform(list_concat(clinks, {_GUESSES}),
      lambda p: {site} || p) AS l FROM {source} WHERE len(clinks) > 0 OR contactable),
    frontier AS MATERIALIZED (SELECT url, niche, unnest(l) AS sub_url, generate_subscripts(l, 1) - 1 AS pos FROM
      (SELECT url, niche, list_filter({d.ordered_distinct('l')}, lambda u: u <> rtrim(url, '/') || '/')[1:5] AS l FROM raw_f))"""


_STEPS = f"""steps AS MATERIALIZED (SELECT r.url, r.niche, r.pos, r.sub_url, f.url IS NOT NULL AS present,
  coalesce(f.html = '', true) AS is_empty, f.url IS NOT NULL AND {d.reason('f.low', 'r.niche')} IS NULL AS accepted,
  {d.uniq('list_concat(f.emails, f.mailto)')} AS emails, f.whatsapp_numbers, f.instagram_handles, f.linkedin_urls,
  f.phones FROM frontier r LEFT JOIN facts f ON r.sub_url = f.url),
flags AS MATERIALIZED (SELECT *, present AND NOT is_empty AND accepted AND
  len(emails) + len(whatsapp_numbers) + len(instagram_handles) + len(linkedin_urls) + len(phones) > 0 AS useful FROM steps)"""

_WALK = """walk AS (
  SELECT url, niche, 0 AS next, 0 AS misses, false AS done, CAST([] AS VARCHAR[]) AS visited,
    CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT url, niche FROM flags)
  UNION ALL
  SELECT w.url, w.niche, w.next + 1,
    CASE WHEN w.done OR w.misses >= 3 OR (s.present AND list_contains(w.visited, s.sub_url)) THEN w.misses
      WHEN s.useful THEN 0 ELSE w.misses + 1 END,
    CASE WHEN w.done OR w.misses >= 3 OR list_contains(w.visited, s.sub_url) THEN w.done
      ELSE coalesce(s.useful AND len(s.emails) > 0, false) END,
    CASE WHEN w.done OR w.misses >= 3 OR NOT s.present THEN w.visited ELSE list_append(w.visited, s.sub_url) END,
    CASE WHEN w.done OR w.misses >= 3 OR list_contains(w.visited, s.sub_url) OR NOT coalesce(s.useful, false) THEN w.used
      ELSE list_append(w.used, s.pos) END
  FROM walk w JOIN flags s ON s.url = w.url AND s.niche = w.niche AND s.pos = w.next),
ended AS MATERIALIZED (SELECT url, niche, arg_max(used, next) AS used FROM walk GROUP BY 1, 2),
extra AS MATERIALIZED (SELECT e.url, e.niche, any_value(len(e.used)) AS n_used, """ + ", ".join(
    f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in LISTS
) + """ FROM ended e JOIN flags s ON s.url = e.url AND s.niche = e.niche AND list_contains(e.used, s.pos) GROUP BY 1, 2)"""

_WITH_SUB = "subbed AS MATERIALIZED (SELECT k.url, k.niche, k.seq, k.query, k.name, " + ", ".join(
    f"CASE WHEN len(k.emails) = 0 AND x.url IS NOT NULL THEN {d.uniq(f'list_concat(k.{c}, x.{c})')} ELSE k.{c} END AS {c}"
    for c in LISTS
) + " FROM kept k LEFT JOIN extra x ON k.url = x.url AND k.niche = x.niche)"

_SOCIAL = """hits AS (SELECT domain, engine_pos,
    CASE WHEN regexp_matches(url, '^https://www[.]instagram') THEN regexp_extract(url, 'com/([^/?]+)', 1) END AS handle,
    CASE WHEN contains(url, 'linkedin.com/company/') THEN 'https://linkedin.com/company/' || regexp_extract(url, 'company/([^/?]+)', 1) END AS company
  FROM fx_social),
ig AS (SELECT domain, list_sort(list_distinct(list(handle))) AS found FROM hits h WHERE handle IS NOT NULL AND engine_pos =
  (SELECT min(engine_pos) FROM hits x WHERE x.domain = h.domain AND x.handle IS NOT NULL) GROUP BY 1),
li AS (SELECT domain, list_sort(list_distinct(list(company))) AS found FROM hits h WHERE company IS NOT NULL AND engine_pos =
  (SELECT min(engine_pos) FROM hits x WHERE x.domain = h.domain AND x.company IS NOT NULL) GROUP BY 1)"""


def _filled(source: str) -> str:
    return f"""filled AS MATERIALIZED (SELECT s.* REPLACE (
      CASE WHEN len(instagram_handles) = 0 THEN coalesce(ig.found, []) ELSE instagram_handles END AS instagram_handles,
      CASE WHEN len(linkedin_urls) = 0 THEN coalesce(li.found, []) ELSE linkedin_urls END AS linkedin_urls)
    FROM {source} s LEFT JOIN ig ON ig.domain = {d.host('s.url')} LEFT JOIN li ON li.domain = {d.host('s.url')})"""


_VERIFIED = """mails AS (SELECT e.url, e.niche, list_sort(list(e.m)) AS good FROM
    (SELECT url, niche, unnest(emails) AS m FROM filled) e
    LEFT JOIN fx_mx x ON x.domain = lower(regexp_extract(e.m, '[^@]*$')) WHERE coalesce(x.has_mx, true) GROUP BY 1, 2),
checked AS (SELECT f.* REPLACE (coalesce(m.good, []) AS emails) FROM filled f
  LEFT JOIN mails m ON m.url = f.url AND m.niche = f.niche)"""

_BOXES = "boxes AS (SELECT domain, list_sort(list(email)) AS inferred FROM (SELECT email, split_part(email, '@', 2) AS domain, " + (
    "row_number() OVER (PARTITION BY split_part(email, '@', 2) ORDER BY list_position(["
    + ", ".join(d.q(m) for m in vocab.GENERIC_MAILBOXES)
    + "], split_part(email, '@', 1))) AS rn FROM fx_mailbox WHERE accepts) WHERE rn <= 6 GROUP BY 1)"
)


def _inferred(source: str) -> str:
    return f"""contacts AS MATERIALIZED (SELECT c.url, c.niche, c.seq, c.query, c.name,
      CASE WHEN len(c.emails) = 0 THEN coalesce(b.inferred, []) ELSE c.emails END AS emails,
      {', '.join('c.' + x for x in LISTS[1:])},
      CASE WHEN len(c.emails) = 0 AND b.inferred IS NOT NULL THEN 'inferred' ELSE 'scraped' END AS email_origin
    FROM {source} c LEFT JOIN boxes b ON b.domain = {d.host('c.url')})"""


_AFTER_SITES = ", ".join(
    [
        _KEPT,
        "bare AS (SELECT * FROM kept WHERE len(emails) = 0)",
        _frontier("bare"), _STEPS, _WALK, _WITH_SUB, _SOCIAL, _filled("subbed"), _VERIFIED, _BOXES,
        _inferred("checked"),
    ]
)
_LOOKUP_TABLES = ("fx_pages", "fx_social", "fx_mx", "fx_mailbox")


def _run_sql(sites: str, select: str, *tables: str, extra: str = "") -> str:
    body = ", ".join(p for p in (_FACTS, sites, _AFTER_SITES, extra) if p)
    return with_tables(*_LOOKUP_TABLES, *tables, extra=body).replace("WITH ", "WITH RECURSIVE ", 1) + select


_SHOW = ", ".join(f"array_to_string({c}, ' | ') AS {c}" for c in LISTS)
_ANY = " + ".join(f"len({c})" for c in LISTS) + " > 0"


def _shown(df, *cols):
    return df.select(*cols, *[join_list(c).alias(c) for c in LISTS])


# -- queries ------------------------------------------------------------------


@query(
    "page_contacts",
    _run_sql(_SEEDS, f"SELECT url, niche, name AS business_name, email_origin, {_SHOW} FROM contacts"),
)
def page_contacts(spark, sf):
    sites = collect.seed_sites(seeds_of(spark, sf))
    found = collect.page_contacts(sites, facts_of(spark, sf), lookups(spark, sf))
    return _shown(found, "url", "niche", "business_name", "email_origin")


@query(
    "contact_frontier",
    _run_sql(_SEEDS, "SELECT url, niche, pos, sub_url FROM frontier"),
)
def contact_frontier(spark, sf):
    return enrich.contact_frontier(_bare(spark, sf, facts_of(spark, sf)))


def _bare(spark, sf, facts):
    kept = collect.gated_sites(collect.seed_sites(seeds_of(spark, sf)), facts)
    return kept.filter(F.size("emails") == 0)


@query(
    "contact_pages",
    _run_sql(
        _SEEDS,
        """SELECT url, niche, pos, sub_url, present, accepted,
        coalesce(array_to_string(emails, ' | '), '') AS emails FROM flags""",
    ),
)
def contact_pages(spark, sf):
    facts = facts_of(spark, sf)
    steps = enrich.walk_steps(enrich.contact_frontier(_bare(spark, sf, facts)), facts)
    return steps.select(
        "url", "niche", "pos", "sub_url", "present", "accepted",
        F.coalesce(join_list("emails"), F.lit("")).alias("emails"),
    )


_WHOLE_WALK = "(SELECT e.url, e.niche, CAST(len(e.used) AS INTEGER) AS n_used, " + ", ".join(
    f"coalesce(x.{c}, []) AS {c}" for c in LISTS
) + " FROM ended e LEFT JOIN extra x ON e.url = x.url AND e.niche = x.niche)"


@query("contact_walk", _run_sql(_SEEDS, f"SELECT url, niche, n_used, {_SHOW} FROM {_WHOLE_WALK}"))
def contact_walk(spark, sf):
    """Every site that was walked, also where its sub-pages gave nothing."""
    facts = facts_of(spark, sf)
    walked = enrich.contact_walk(enrich.walk_steps(enrich.contact_frontier(_bare(spark, sf, facts)), facts))
    return _shown(walked, "url", "niche", "n_used")


_LEAD_SITES = """checked AS (SELECT website AS url, niche, seq, '' AS query, business_name AS name,
  """ + ", ".join(f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ' | ') END AS {c}" for c in LISTS) + " FROM fx_leads)"


def _lead_sites(spark, sf):
    return leads_table(spark, sf, "fx_leads").withColumnRenamed("website", "url")


@query(
    "social_fill",
    with_tables("fx_leads", "fx_social", extra=", ".join([_LEAD_SITES, _SOCIAL, _filled("checked")]))
    + "SELECT seq, array_to_string(instagram_handles, ' | ') AS ig, array_to_string(linkedin_urls, ' | ') AS li FROM filled",
)
def social_fill(spark, sf):
    filled = enrich.fill_social(_lead_sites(spark, sf), table(spark, sf, "fx_social"))
    return filled.select(
        "seq", join_list("instagram_handles").alias("ig"), join_list("linkedin_urls").alias("li")
    )


@query(
    "infer_mailboxes",
    with_tables("fx_leads", "fx_mailbox", extra=", ".join([_LEAD_SITES, _BOXES, _inferred("checked")]))
    + "SELECT seq, array_to_string(emails, ' | ') AS emails, email_origin FROM contacts",
)
def infer_mailboxes(spark, sf):
    sites = _lead_sites(spark, sf).withColumn("email_origin", F.lit("scraped"))
    filled = enrich.infer_mailboxes(sites, table(spark, sf, "fx_mailbox"))
    return filled.select("seq", join_list("emails").alias("emails"), "email_origin")


_SCORE = d.score_of({c: f"len({c})" for c in LISTS})


@query(
    "seed_leads",
    _run_sql(
        _SEEDS,
        f"""SELECT name AS business_name, niche, url AS website, query AS source_query, email_origin,
          '{STAMP}' AS scraped_at, {_SCORE} AS quality_score, {d.label(_SCORE)} AS quality_label, {_SHOW}
        FROM (SELECT *, row_number() OVER (PARTITION BY {d.host_key('url')} ORDER BY seq) AS rn
          FROM contacts WHERE {_ANY}) WHERE rn = 1""",
    ),
)
def seed_leads(spark, sf):
    """The flagship: scored leads of the seed list, one per host, best first."""
    made = collect.seed_leads(
        seeds_of(spark, sf), facts_of(spark, sf), lookups(spark, sf), max_leads=None, now=F.lit(STAMP)
    )
    scored = merge.with_quality(merge.dedupe_leads(made))
    ordered = merge.best_first(scored, "seq")
    return _shown(
        ordered, "business_name", "niche", "website", "source_query", "email_origin", "scraped_at",
        "quality_score", "quality_label",
    )


_SEARCH_SITES = f"""usable AS (SELECT * FROM fx_serp WHERE {d.is_page('url')} AND NOT {d.denied('url')}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY niche, url ORDER BY query_pos, rank) AS rn FROM usable)
  WHERE rn = 1 AND {d.host('url')} NOT IN (SELECT {d.host('website')} FROM fx_prior WHERE website <> '')),
scored AS (SELECT *, {cand_score(hay(), 'url', 'title', 'niche')} AS score FROM once),
sites AS MATERIALIZED (SELECT url, niche, query, seq FROM (SELECT *, row_number() OVER
  (PARTITION BY niche ORDER BY score DESC, query_pos, rank) AS seq FROM scored WHERE score >= -2) WHERE seq <= 60)"""


@query(
    "search_leads",
    _run_sql(
        _SEARCH_SITES,
        f"""SELECT niche, url AS website, query AS source_query, name AS business_name, email_origin, {_SHOW}
        FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY seq) AS rn FROM contacts WHERE {_ANY})
        WHERE rn <= 20""",
        "fx_serp", "fx_prior",
    ),
)
def search_leads(spark, sf):
    made = collect.search_leads(
        table(spark, sf, "fx_serp"), facts_of(spark, sf), lookups(spark, sf),
        prior=leads_table(spark, sf, "fx_prior"), max_leads=20, now=F.lit(STAMP),
    )
    return _shown(made, "niche", "website", "source_query", "business_name", "email_origin")


@query(
    "discover",
    with_tables(
        "fx_serp", "fx_cache",
        extra=f"""cached AS (SELECT * FROM (SELECT query, niche, rank, {d.to_root('url')} AS url, title FROM fx_cache
          WHERE hours_ago < 168) WHERE {d.is_page('url')} AND NOT {d.denied('url')}),
        settled AS (SELECT query FROM (SELECT query, count(*) AS n, count(*) FILTER (WHERE {d.in_scope(hay(), 'niche')}) AS hits
          FROM cached GROUP BY 1) WHERE {ok_ratio('n', 'hits')}),
        {CHOSEN},
        parts AS (SELECT query, 0 AS source_rank, rank, url, title FROM cached UNION ALL
          SELECT r.query, 1, r.rank, r.url, r.title FROM fx_serp r JOIN chosen c
            ON r.query = c.query AND r.niche = c.niche AND r.engine_pos = c.engine_pos WHERE r.query NOT IN (SELECT query FROM settled)),
        first_ AS (SELECT query, source_rank, {d.to_root('url')} AS url, title FROM (SELECT *, row_number() OVER
          (PARTITION BY query, url ORDER BY source_rank, rank) AS rn FROM parts) WHERE rn = 1)""",
    )
    + f"SELECT query, source_rank, url, title FROM first_ WHERE {d.is_page('url')} AND NOT {d.denied('url')}",
)
def discover(spark, sf):
    docs = _cache_docs(spark, sf)
    found = collect.discover(table(spark, sf, "fx_serp"), docs, now=F.lit(CLOCK).cast("timestamp"))
    return found.select("query", "source_rank", "url", "title")


_NICHE_POS = "CASE niche " + " ".join(f"WHEN {d.q(n.id)} THEN {i}" for i, n in enumerate(vocab.NICHES)) + " END"


@query(
    "full_run",
    _run_sql(
        _SEEDS,
        f"""SELECT hk AS site, business_name, website, quality_score, emails FROM (
          SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, src DESC, seq DESC) AS rn FROM both_ WHERE hk <> '')
        WHERE rn = 1 AND NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}""",
        "fx_prior",
        extra=f"""once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {d.host_key('url')}
            ORDER BY {_NICHE_POS}, seq) AS rn FROM contacts WHERE {_ANY}) WHERE rn = 1 AND {_SCORE} BETWEEN 10 AND 95),
        both_ AS (SELECT 1 AS src, seq, {d.host_key('url')} AS hk, name AS business_name, url AS website,
            {' + '.join(f'len({c})' for c in LISTS)} AS n, {_SCORE} AS quality_score, array_to_string(emails, ' | ') AS emails FROM once
          UNION ALL SELECT 0, seq, {d.host_key('website')}, business_name, website, {d.count()}, {d.score()}, emails FROM fx_prior
            WHERE NOT {d.denied('website')} AND NOT {d.provider_name('business_name')})""",
    ),
)
def full_run(spark, sf):
    """All niches over the seed list, merged with the prior leads."""
    pos = F.create_map(*[F.lit(x) for i, n in enumerate(vocab.NICHES) for x in (n.id, i)])
    made = collect.seed_leads(
        seeds_of(spark, sf), facts_of(spark, sf), lookups(spark, sf), max_leads=None, now=F.lit(STAMP)
    ).withColumn("niche_pos", pos[F.col("niche")])
    prior = leads_table(spark, sf, "fx_prior").withColumn("niche_pos", F.lit(None).cast("int"))
    whole = collect.full_run([made], prior, min_quality=10, max_quality=95)
    return whole.select(
        urls.host_key("website").alias("site"), "business_name", "website", "quality_score",
        join_list("emails").alias("emails"),
    )


_FOUND = f"""cached AS (SELECT * FROM (SELECT query, niche, rank, {d.to_root('url')} AS url, title FROM fx_cache
    WHERE hours_ago < 168) WHERE {d.is_page('url')} AND NOT {d.denied('url')}),
settled AS (SELECT query FROM (SELECT query, count(*) AS n, count(*) FILTER (WHERE {d.in_scope(hay(), 'niche')}) AS hits
    FROM cached GROUP BY 1) WHERE {ok_ratio('n', 'hits')}),
{CHOSEN},
parts AS (SELECT query, niche, 0 AS source_rank, rank, url, title FROM cached UNION ALL
  SELECT r.query, r.niche, 1, r.rank, r.url, r.title FROM fx_serp r JOIN chosen c
    ON r.query = c.query AND r.niche = c.niche AND r.engine_pos = c.engine_pos WHERE r.query NOT IN (SELECT query FROM settled)),
first_ AS (SELECT query, niche, source_rank, rank, {d.to_root('url')} AS url, title FROM (SELECT *, row_number() OVER
  (PARTITION BY query, url ORDER BY source_rank, rank) AS rn FROM parts) WHERE rn = 1),
found AS MATERIALIZED (SELECT f.*, p.query_pos FROM first_ f LEFT JOIN
  (SELECT query, niche, min(query_pos) AS query_pos FROM fx_serp GROUP BY 1, 2) p ON f.query = p.query AND f.niche = p.niche
  WHERE {d.is_page('f.url')} AND NOT {d.denied('f.url')})"""
_FOUND_SITES = _SEARCH_SITES.replace("FROM fx_serp", "FROM found").replace("query_pos, rank", "query_pos, source_rank, rank")


@query(
    "search_run",
    _run_sql(
        f"{_FOUND}, {_FOUND_SITES}",
        f"""SELECT hk AS site, business_name, website, quality_score, emails FROM (
          SELECT *, row_number() OVER (PARTITION BY hk ORDER BY n DESC, src DESC, seq DESC) AS rn FROM both_ WHERE hk <> '')
        WHERE rn = 1 AND NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}""",
        "fx_serp", "fx_cache", "fx_prior",
        extra=f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY seq) AS place
            FROM contacts WHERE {_ANY}) WHERE place <= 20),
        once_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {d.host_key('url')}
            ORDER BY {_NICHE_POS}, seq) AS rn FROM best) WHERE rn = 1),
        both_ AS (SELECT 1 AS src, seq, {d.host_key('url')} AS hk, name AS business_name, url AS website,
            {' + '.join(f'len({c})' for c in LISTS)} AS n, {_SCORE} AS quality_score, array_to_string(emails, ' | ') AS emails FROM once_
          UNION ALL SELECT 0, seq, {d.host_key('website')}, business_name, website, {d.count()}, {d.score()}, emails FROM fx_prior
            WHERE NOT {d.denied('website')} AND NOT {d.provider_name('business_name')})""",
    ),
)
def search_run(spark, sf):
    """Search mode end to end: discovery, leads of each niche, merge with the prior leads."""
    whole = collect.search_run(
        table(spark, sf, "fx_serp"), _cache_docs(spark, sf), facts_of(spark, sf), lookups(spark, sf),
        prior=leads_table(spark, sf, "fx_prior"), max_leads=20, now=F.lit(STAMP), as_of=F.lit(CLOCK).cast("timestamp"),
    )
    return whole.select(
        urls.host_key("website").alias("site"), "business_name", "website", "quality_score",
        join_list("emails").alias("emails"),
    )

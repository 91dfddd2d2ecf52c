"""Queries over deny rules, phrase tests, the gate and lead filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.catalog import duck as d
from leadmill.catalog.derived import driver_table, leads_table, table, with_tables
from leadmill.catalog.registry import query
from leadmill.functions import html, phrases, urls, vocab
from leadmill.functions.text import join_list
from leadmill.operators import deny, enrich, gate, merge, rank, views

# -- URLs and names -----------------------------------------------------------


@query(
    "url_rule_denied",
    with_tables("fx_pages") + f"SELECT site_seq, {d.rule_denied('url')} AS denied FROM fx_pages",
)
def url_rule_denied(spark, sf):
    pages = table(spark, sf, "fx_pages")
    return pages.select("site_seq", urls.url_rule_denied("url").alias("denied"))


_LISTED_URLS = f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'https://www.shop.' ELSE 'https://un' END
    || [{", ".join(map(d.q, vocab.DEFAULT_DENY_HOSTS))}][doc_id % {len(vocab.DEFAULT_DENY_HOSTS)} + 1] || '/' AS url FROM documents"""


@query(
    "url_denied",
    with_tables("fx_pages", "fx_leads")
    + f"""SELECT 'page' AS src, site_seq AS id, {d.denied('url')} AS denied FROM fx_pages
    UNION ALL SELECT 'lead', seq, {d.denied('website')} FROM fx_leads
    UNION ALL SELECT 'host', doc_id, {d.denied('url')} FROM ({_LISTED_URLS})""",
)
def url_denied(spark, sf):
    """The last part spreads every listed host, with sub-domains and look-alikes, over the documents."""
    a = table(spark, sf, "fx_pages").select(
        F.lit("page").alias("src"), F.col("site_seq").alias("id"), deny.url_denied("url").alias("denied")
    )
    b = table(spark, sf, "fx_leads").select(
        F.lit("lead").alias("src"), F.col("seq").alias("id"), deny.url_denied("website").alias("denied")
    )
    hosts = F.array(*map(F.lit, vocab.DEFAULT_DENY_HOSTS))
    k = F.col("doc_id")
    start = F.when(k % 3 == 0, "https://").when(k % 3 == 1, "https://www.shop.").otherwise("https://un")
    listed = table(spark, sf, "documents").select(
        F.lit("host").alias("src"), F.col("doc_id").alias("id"),
        deny.url_denied(F.concat(start, F.get(hosts, (k % len(vocab.DEFAULT_DENY_HOSTS)).cast("int")), F.lit("/"))).alias("denied"),
    )
    return a.unionByName(b).unionByName(listed)


@query(
    "host_deny_join",
    with_tables("fx_pages", "fx_mx")
    + f"""SELECT site_seq, url FROM fx_pages p WHERE NOT EXISTS (SELECT 1 FROM
      (SELECT unnest([{", ".join(map(d.q, vocab.DEFAULT_DENY_HOSTS))}]) AS host UNION ALL SELECT 'uk' UNION ALL
       SELECT domain FROM fx_mx WHERE has_mx = false) b
      WHERE {d.host('p.url')} = b.host OR ends_with({d.host('p.url')}, '.' || b.host))""",
)
def host_deny_join(spark, sf):
    """Deny list given as a table: the whole default list and one part that grows with the data."""
    listed = table(spark, sf, "fx_mx").filter("has_mx = false").select(F.col("domain").alias("host"))
    fixed = spark.createDataFrame([(h,) for h in (*vocab.DEFAULT_DENY_HOSTS, "uk")], "host string")
    pages = table(spark, sf, "fx_pages").select("site_seq", "url")
    return deny.drop_denied_hosts(pages, "url", listed.unionByName(fixed))


@query(
    "name_denied",
    with_tables("fx_pages") + f"SELECT site_seq, {d.brand_name('title')} AS denied FROM fx_pages",
)
def name_denied(spark, sf):
    return table(spark, sf, "fx_pages").select("site_seq", phrases.name_denied("title").alias("denied"))


@query(
    "provider_name",
    with_tables("fx_pages") + f"SELECT site_seq, {d.provider_name('title')} AS provider FROM fx_pages",
)
def provider_name(spark, sf):
    return table(spark, sf, "fx_pages").select(
        "site_seq", phrases.is_provider_name("title").alias("provider")
    )


# -- phrase tests over derived pages and driver documents ---------------------

_LOW_SQL = (
    with_tables("fx_pages")
    + f""", low AS (SELECT 'fx' AS src, site_seq AS id, niche, lower({d.visible_text('html')}) AS low
      FROM fx_pages UNION ALL SELECT 'doc', doc_id,
      CASE doc_id % 2 WHEN 0 THEN 'saas' ELSE 'ecommerce' END, lower(text) FROM documents) """
).replace(") , low", "), low")


def _low(spark, sf):
    a = table(spark, sf, "fx_pages").select(
        F.lit("fx").alias("src"), F.col("site_seq").alias("id"), "niche",
        F.lower(html.visible_text("html")).alias("low"),
    )
    b = driver_table(spark, sf, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("saas")).otherwise(F.lit("ecommerce")).alias("niche"),
        F.lower("text").alias("low"),
    )
    return a.unionByName(b)


def _flag(name, sql, fn):
    @query(name, _LOW_SQL + f"SELECT src, id, {sql} AS hit FROM low")
    def run(spark, sf):
        return _low(spark, sf).select("src", "id", fn().alias("hit"))

    return run


scope_match = _flag("scope_match", d.in_scope("low", "niche"), lambda: phrases.in_scope("low", "niche"))
scope_excluded = _flag(
    "scope_excluded", d.excluded("low", "niche"), lambda: phrases.has_exclusion("low", "niche")
)
is_corporate = _flag(
    "is_corporate", d.any_of("low", vocab.CORPORATE_PHRASES), lambda: phrases.is_corporate("low")
)
is_education = _flag(
    "is_education", d.any_of("low", vocab.EDUCATION_PHRASES), lambda: phrases.is_education("low")
)
is_portal = _flag("is_portal", d.any_of("low", vocab.PORTAL_PHRASES), lambda: phrases.is_portal("low"))
is_reference = _flag(
    "is_reference", d.any_of("low", vocab.REFERENCE_PHRASES), lambda: phrases.is_reference("low")
)
is_provider = _flag(
    "is_provider", d.any_of("low", vocab.PROVIDER_PHRASES), lambda: phrases.is_provider("low")
)


@query(
    "candidate_gate",
    _LOW_SQL
    + f"""SELECT src, id, {d.reason('low', 'niche')} AS strict_reason,
      {d.reason('low', 'niche', scope=False, corporate=False)} AS loose_reason FROM low""",
)
def candidate_gate(spark, sf):
    """Full gate, and the gate with two switches off."""
    low = _low(spark, sf)
    full = gate.candidate_gate(low, "low").withColumnRenamed("reject_reason", "strict_reason")
    both = gate.candidate_gate(full, "low", require_scope=False, exclude_corporate=False)
    return both.select("src", "id", "strict_reason", F.col("reject_reason").alias("loose_reason"))


_MATCHES = " UNION ALL ".join(
    f"SELECT src, id, {d.q(n.id)} AS niche FROM low WHERE {d.any_of('low', n.scope_keywords)}"
    for n in vocab.NICHES
)


@query("page_niche_join", _LOW_SQL + f"SELECT * FROM ({_MATCHES}) m")
def page_niche_join(spark, sf):
    return gate.page_niches(_low(spark, sf).drop("niche"), "low").select("src", "id", "niche")


@query(
    "cand_clean",
    with_tables("fx_serp", extra=f"r AS (SELECT rank, query, {d.to_root('url')} AS url FROM fx_serp)")
    + f"SELECT rank, query, url FROM r WHERE {d.is_page('url')} AND NOT {d.denied('url')}",
)
def cand_clean(spark, sf):
    return rank.clean_candidates(table(spark, sf, "fx_serp")).select("rank", "query", "url")


# -- leads --------------------------------------------------------------------


@query(
    "lead_purge",
    with_tables("fx_leads")
    + f"""SELECT seq, website FROM fx_leads
      WHERE NOT {d.denied('website')} AND NOT {d.provider_name('business_name')}""",
)
def lead_purge(spark, sf):
    return views.purge(leads_table(spark, sf, "fx_leads")).select("seq", "website")


@query(
    "lead_filters",
    with_tables("fx_leads")
    + f"SELECT seq, website FROM fx_leads WHERE emails <> '' AND {d.score()} BETWEEN 40 AND 90",
)
def lead_filters(spark, sf):
    df = leads_table(spark, sf, "fx_leads")
    return views.filter_quality(df, emails_only=True, min_quality=40, max_quality=90).select("seq", "website")


@query(
    "lead_view",
    with_tables("fx_leads")
    + f"""SELECT seq, niche FROM fx_leads WHERE {d.label(d.score())} = 'high' AND niche = 'saas'
      AND emails <> '' AND contains(lower(business_name || ' ' || emails || ' ' || phones), 'biz 1')""",
)
def lead_view(spark, sf):
    df = merge.with_quality(leads_table(spark, sf, "fx_leads"))
    shown = views.lead_view(df, label="high", niche="saas", has_email=True, text=" Biz 1 ")
    return shown.select("seq", "niche")


@query(
    "lead_band",
    with_tables("fx_leads")
    + f"""SELECT seq, {d.label(d.score())} AS band FROM fx_leads""",
)
def lead_band(spark, sf):
    """Every band by name; together they hold each lead once."""
    df = leads_table(spark, sf, "fx_leads")
    parts = [views.filter_band(df, b).select("seq", F.lit(b).alias("band")) for b in vocab.QUALITY_BANDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "email_verify",
    with_tables(
        "fx_leads", "fx_mx",
        extra="""e AS (SELECT seq, m, lower(regexp_extract(m, '[^@]*$')) AS domain FROM
          (SELECT seq, unnest(string_split(emails, ' | ')) AS m FROM fx_leads WHERE emails <> '')),
        c AS (SELECT e.seq, e.m, x.has_mx FROM e LEFT JOIN fx_mx x ON e.domain = x.domain)""",
    )
    + """SELECT l.seq,
      coalesce((SELECT string_agg(m, ' | ' ORDER BY m) FROM c WHERE c.seq = l.seq AND coalesce(has_mx, true)), '') AS kept,
      coalesce((SELECT string_agg(m, ' | ' ORDER BY m) FROM c WHERE c.seq = l.seq AND has_mx), '') AS proven
    FROM fx_leads l""",
)
def email_verify(spark, sf):
    """Lenient (unknown domains kept) and strict check side by side."""
    df = leads_table(spark, sf, "fx_leads").select("seq", "website", "emails")
    mx = table(spark, sf, "fx_mx")
    lenient = enrich.verify_emails(df, mx, ["seq"])
    strict = enrich.verify_emails(df, mx, ["seq"], strict=True)
    return lenient.select("seq", join_list("emails").alias("kept")).join(
        strict.select("seq", join_list("emails").alias("proven")), "seq"
    )

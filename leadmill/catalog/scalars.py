"""Queries over the column functions: URLs, HTML, contact extraction, leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.catalog import duck as d
from leadmill.catalog.derived import driver_table, leads_table, table, with_tables
from leadmill.catalog.registry import query
from leadmill.functions import contacts, html, leads, urls, vocab
from leadmill.functions.text import join_list, split_list
from leadmill.operators import merge
from leadmill.plans.collect import build_leads

# -- URLs ---------------------------------------------------------------------


@query("url_host", f"SELECT page_id, {d.host('url')} AS host FROM pages")
def url_host(spark, sf):
    return driver_table(spark, sf, "pages").select("page_id", urls.host_of("url").alias("host"))


@query(
    "url_host_key",
    with_tables("fx_leads") + f"SELECT seq, {d.host_key('website')} AS host_key FROM fx_leads",
)
def url_host_key(spark, sf):
    return table(spark, sf, "fx_leads").select("seq", urls.host_key("website").alias("host_key"))


@query(
    "url_domain",
    with_tables("fx_leads") + f"SELECT seq, nullif({d.host('website')}, '') AS domain FROM fx_leads",
)
def url_domain(spark, sf):
    return table(spark, sf, "fx_leads").select("seq", urls.domain_of("website").alias("domain"))


_BARE = "h || '/contact'"


@query(
    "url_same_domain",
    with_tables("fx_page_parts")
    + f"SELECT k, {d.host('url')} = h AS same FROM fx_page_parts",
)
def url_same_domain(spark, sf):
    """Page address against the bare host text of its site."""
    bare = F.concat("h", F.lit("/contact"))
    return table(spark, sf, "fx_page_parts").select(
        "k", urls.is_same_domain("url", bare).alias("same")
    )


@query(
    "url_dedupe",
    with_tables("fx_serp") + "SELECT query, url, min(rank) AS rank FROM fx_serp GROUP BY query, url",
)
def url_dedupe(spark, sf):
    return merge.distinct_urls(table(spark, sf, "fx_serp"), ["query"]).select("query", "url", "rank")


@query(
    "url_is_page", with_tables("fx_serp") + f"SELECT rank, {d.is_page('url')} AS is_page FROM fx_serp"
)
def url_is_page(spark, sf):
    return table(spark, sf, "fx_serp").select("rank", urls.is_page_url("url").alias("is_page"))


@query(
    "url_to_root", with_tables("fx_serp") + f"SELECT rank, {d.to_root('url')} AS url FROM fx_serp"
)
def url_to_root(spark, sf):
    return table(spark, sf, "fx_serp").select("rank", urls.to_site_root("url").alias("url"))


@query(
    "seed_normalize",
    with_tables("fx_base")
    + """SELECT k, CASE k % 4 WHEN 0 THEN 'https://' || h WHEN 1 THEN 'http://' || h || '/x'
      WHEN 2 THEN 'https://www.' || h ELSE NULL END AS url FROM fx_base""",
)
def seed_normalize(spark, sf):
    raw = F.expr(
        "CASE k % 4 WHEN 0 THEN '  ' || h WHEN 1 THEN 'http://' || h || '/x' "
        "WHEN 2 THEN 'www.' || h || ' ' ELSE '   ' END"
    )
    return table(spark, sf, "fx_base").select("k", urls.normalize_seed(raw).alias("url"))


@query(
    "url_prior_key",
    with_tables("fx_leads")
    + """SELECT seq, split_part(regexp_replace(lower(website), '^https?://(www\\.)?', ''), '/', 1)
      AS prior_key FROM fx_leads""",
)
def url_prior_key(spark, sf):
    return table(spark, sf, "fx_leads").select("seq", urls.prior_key("website").alias("prior_key"))


_JOIN_CASES = (
    # href, expected (@ is the site)
    ("/contact", "@/contact"),
    ("team", "@/a/team"),
    ("../up?x=1", "@/up?x=1"),
    ("./same/./y#f", "@/a/same/y#f"),
    ("?p=2", "@/a/b?p=2"),
    ("#top", "@/a/b?q=1#top"),
    ("//cdn.example/z", "https://cdn.example/z"),
    ("http://other.example/", "http://other.example/"),
    ("../../../x/..", "@/"),
    ("", "@/a/b?q=1"),
)


@query(
    "url_join",
    with_tables("fx_base")
    + "SELECT k, CASE k % 10 "
    + " ".join(
        f"WHEN {i} THEN {d.q(want).replace('@', chr(39) + ' || h || ' + chr(39)) if want[0] != '@' else d.q('https://') + ' || h || ' + d.q(want[1:])}"
        for i, (_, want) in enumerate(_JOIN_CASES)
    )
    + " END AS url FROM fx_base",
)
def url_join(spark, sf):
    href = F.element_at(F.array(*[F.lit(h) for h, _ in _JOIN_CASES]), (F.col("k") % 10 + 1).cast("int"))
    base = F.concat(F.lit("https://"), "h", F.lit("/a/b?q=1"))
    return table(spark, sf, "fx_base").select("k", urls.url_join(base, href).alias("url"))


@query("unwrap_redirect", with_tables("fx_hrefs") + "SELECT k, engine, target AS url FROM fx_hrefs")
def unwrap_redirect(spark, sf):
    hrefs = table(spark, sf, "fx_hrefs")
    pick = None
    for engine, fn in urls.UNWRAP.items():
        test = F.col("engine") == engine
        pick = F.when(test, fn("href")) if pick is None else pick.when(test, fn("href"))
    return hrefs.select("k", "engine", pick.alias("url"))


# -- HTML ---------------------------------------------------------------------


@query("page_text", f"SELECT page_id, {d.visible_text('html')} AS text FROM pages")
def page_text(spark, sf):
    return driver_table(spark, sf, "pages").select("page_id", html.visible_text("html").alias("text"))


@query("page_text_strict", f"SELECT page_id, {d.strict_text('html')} AS text FROM pages")
def page_text_strict(spark, sf):
    return driver_table(spark, sf, "pages").select("page_id", html.strict_text("html").alias("text"))


@query(
    "page_links",
    f"""WITH t AS (SELECT page_id, {d.links('html')} AS l FROM pages)
    SELECT page_id, {d.joined(d.ordered_distinct('l'))} AS links FROM t""",
)
def page_links(spark, sf):
    pages = driver_table(spark, sf, "pages")
    return pages.select("page_id", join_list(html.page_links("html")).alias("links"))


@query(
    "page_contact_links",
    with_tables("fx_pages")
    + f"""SELECT site_seq, {d.joined(d.contact_links('html'))} AS links FROM fx_pages""",
)
def page_contact_links(spark, sf):
    pages = table(spark, sf, "fx_pages")
    return pages.select("site_seq", join_list(html.contact_links("html")).alias("links"))


@query(
    "page_name",
    with_tables("fx_pages")
    + f"""SELECT 'fx' AS src, site_seq AS id, {d.name('html', 'url')} AS name FROM fx_pages
    UNION ALL SELECT 'pages', page_id, {d.name('html', 'url')} FROM pages""",
)
def page_name(spark, sf):
    name = html.business_name("html", "url").alias("name")
    derived = table(spark, sf, "fx_pages").select(F.lit("fx").alias("src"), F.col("site_seq").alias("id"), name)
    real = driver_table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), name)
    return derived.unionByName(real)


@query(
    "page_contactable",
    with_tables("fx_pages")
    + f"SELECT site_seq, {d.contactable(d.visible_text('html'))} AS contactable FROM fx_pages",
)
def page_contactable(spark, sf):
    pages = table(spark, sf, "fx_pages")
    hint = html.looks_contactable(html.visible_text("html"))
    return pages.select("site_seq", hint.alias("contactable"))


@query(
    "page_is_challenge",
    with_tables("fx_pages")
    + f"""SELECT 'fx' AS src, site_seq AS id, html = '' OR
      {d.any_of('left(lower(html), 20000)', vocab.CHALLENGE_PHRASES)} AS challenge FROM fx_pages
    UNION ALL SELECT 'doc', doc_id, text = '' OR
      {d.any_of('left(lower(text), 20000)', vocab.CHALLENGE_PHRASES)} FROM documents""",
)
def page_is_challenge(spark, sf):
    a = table(spark, sf, "fx_pages").select(
        F.lit("fx").alias("src"), F.col("site_seq").alias("id"), html.is_challenge_page("html").alias("challenge")
    )
    b = driver_table(spark, sf, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), html.is_challenge_page("text").alias("challenge")
    )
    return a.unionByName(b)


# -- contacts -----------------------------------------------------------------

# Derived pages and driver documents, each as (src, id, text).
TEXTS_SQL = (
    with_tables("fx_pages")
    + f""", texts AS (SELECT 'fx' AS src, site_seq AS id, {d.visible_text('html')} AS text FROM fx_pages
    UNION ALL SELECT 'doc', doc_id, text FROM documents) """
).replace(") , texts", "), texts")
PAGES_SQL = (
    with_tables("fx_pages")
    + f""", p AS (SELECT site_seq, html, {d.visible_text('html')} AS text,
      {d.links('html')} AS links FROM fx_pages) """
).replace(") , p AS", "), p AS")


def _texts(spark, sf):
    a = table(spark, sf, "fx_pages").select(
        F.lit("fx").alias("src"), F.col("site_seq").alias("id"), html.visible_text("html").alias("text")
    )
    b = driver_table(spark, sf, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    return a.unionByName(b)


def _from_text(name, sql, fn):
    @query(name, TEXTS_SQL + f"SELECT src, id, {d.joined(sql('text'))} AS found FROM texts")
    def run(spark, sf):
        return _texts(spark, sf).select("src", "id", join_list(fn("text")).alias("found"))

    return run


emails_plain = _from_text("emails_plain", d.plain_emails, contacts.plain_emails)
emails_obfuscated = _from_text("emails_obfuscated", d.obfuscated_emails, contacts.obfuscated_emails)
phones = _from_text("phones", d.phones, contacts.phones)


def _page_parts(spark, sf):
    markup = table(spark, sf, "fx_pages").select(
        "site_seq", "html", html.drop_hidden("html").alias("markup")
    )
    return markup.select(
        "site_seq",
        "html",
        html.visible_text("markup", True).alias("text"),
        html.page_links("markup", True).alias("links"),
    )


def _from_page(name, sql, fn):
    @query(name, PAGES_SQL + f"SELECT site_seq, {d.joined(sql)} AS found FROM p")
    def run(spark, sf):
        return _page_parts(spark, sf).select("site_seq", join_list(fn()).alias("found"))

    return run


emails_mailto = _from_page("emails_mailto", d.mailto_emails("links"), lambda: contacts.mailto_emails("links"))
mailto_html = _from_page("mailto_html", d.mailto_html("html"), lambda: contacts.mailto_html_emails("html"))
emails_cloudflare = _from_page(
    "emails_cloudflare", d.cloudflare_emails("html"), lambda: contacts.cloudflare_emails("html")
)
emails_encoded = _from_page(
    "emails_encoded", d.encoded_emails("html"), lambda: contacts.encoded_emails("html")
)
emails_html = _from_page("emails_html", d.html_emails("html"), lambda: contacts.html_emails("html"))
whatsapp = _from_page(
    "whatsapp", d.whatsapp("links", "text"), lambda: contacts.whatsapp_numbers("links", "text")
)
instagram = _from_page(
    "instagram", d.instagram("links", "text"), lambda: contacts.instagram_handles("links", "text")
)
linkedin = _from_page(
    "linkedin", d.linkedin("links", "text"), lambda: contacts.linkedin_urls("links", "text")
)


@query(
    "contacts_all",
    PAGES_SQL
    + f"""SELECT site_seq,
      {d.joined(d.uniq(f"list_concat(list_concat({d.plain_emails('text')}, {d.obfuscated_emails('text')}), {d.mailto_emails('links')})"))} AS emails,
      {d.joined(d.whatsapp('links', 'text'))} AS whatsapp_numbers,
      {d.joined(d.instagram('links', 'text'))} AS instagram_handles,
      {d.joined(d.linkedin('links', 'text'))} AS linkedin_urls,
      CASE WHEN len({d.whatsapp('links', 'text')}) = 0 THEN {d.joined(d.phones('text'))} ELSE '' END AS phones
    FROM p""",
)
def contacts_all(spark, sf):
    found = contacts.all_contacts("text", "links")
    return _page_parts(spark, sf).select(
        "site_seq", *[join_list(c).alias(name) for name, c in found.items()]
    )


_EMAIL_CASES = """CASE k % 9 WHEN 0 THEN 'info@' || h WHEN 1 THEN 'you@example.com'
  WHEN 2 THEN 'mayor@city' || CAST(k AS STRING) || '.gov.in' WHEN 3 THEN '@' || h
  WHEN 4 THEN 'a@localhost' WHEN 5 THEN 'x' || CAST(k AS STRING) || '@army.mil'
  WHEN 6 THEN 'no-at.' || h WHEN 7 THEN repeat('a', 250) || '@' || h ELSE 'b@gov.in' END"""


@query(
    "email_valid",
    with_tables("fx_base")
    + f"SELECT k, k % 9 IN (0, 6) AS valid FROM fx_base",
)
def email_valid(spark, sf):
    email = F.expr(_EMAIL_CASES)
    return table(spark, sf, "fx_base").select("k", contacts.is_valid_email(email).alias("valid"))


@query(
    "cf_decode",
    with_tables("fx_base")
    + f"""SELECT k, CASE k % 6 WHEN 0 THEN 'hello@bizmail.com' END AS email,
      k AS n FROM fx_base""",
)
def cf_decode(spark, sf):
    """Shield texts that hold an address, no address, or are broken."""
    from leadmill.catalog.derived import SHIELDED

    cases = [SHIELDED, "zznothex", "abc", "4223", "42" + "23" * 4, ""]
    text = F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("k") % 6 + 1).cast("int"))
    return table(spark, sf, "fx_base").select(
        "k", contacts.decode_cloudflare(text).alias("email"), F.col("k").alias("n")
    )


_DIGITS = """CASE k % 8 WHEN 0 THEN '555' || lpad(CAST(k AS STRING), 7, '1')
  WHEN 1 THEN '1555' || lpad(CAST(k AS STRING), 7, '2') WHEN 2 THEN '2555' || lpad(CAST(k AS STRING), 7, '3')
  WHEN 3 THEN '4420' || lpad(CAST(k AS STRING), 8, '4') WHEN 4 THEN '9' || CAST(k % 100 AS STRING) || '555' || lpad(CAST(k AS STRING), 8, '5')
  WHEN 5 THEN '15' || lpad(CAST(k AS STRING), 10, '6') WHEN 6 THEN CAST(k AS STRING)
  ELSE '3545' || lpad(CAST(k AS STRING), 11, '7') END"""


@query(
    "phone_plausible",
    with_tables("fx_base", extra=f"t AS (SELECT k, {_DIGITS} AS digits FROM fx_base)")
    + f"SELECT k, digits, {d.plausible('digits')} AS plausible FROM t",
)
def phone_plausible(spark, sf):
    base = table(spark, sf, "fx_base").select("k", F.expr(_DIGITS).alias("digits"))
    return base.select("k", "digits", contacts.is_plausible_phone("digits").alias("plausible"))


_NUMBERS = """'1555' || lpad(CAST(k AS STRING), 7, '0') || ',555' || lpad(CAST(k AS STRING), 7, '0')
  || ',' || CAST(5550000 + k % 7 AS STRING) || ',20' || lpad(CAST(k % 11 AS STRING), 8, '5')
  || ',44' || '20' || lpad(CAST(k % 11 AS STRING), 8, '5')"""


@query(
    "phones_dedupe",
    with_tables("fx_base", extra=f"t AS (SELECT k, string_split({_NUMBERS}, ',') AS l FROM fx_base)")
    + f"SELECT k, {d.joined(d.phones_kept('l'))} AS found FROM t",
)
def phones_dedupe(spark, sf):
    base = table(spark, sf, "fx_base").select("k", F.split(F.expr(_NUMBERS), ",").alias("l"))
    return base.select("k", join_list(contacts.drop_contained("l")).alias("found"))


_HANDLES = """CASE k % 8 WHEN 0 THEN 'Biz_' || CAST(k AS STRING) WHEN 1 THEN 'instagram'
  WHEN 2 THEN 'main' || CAST(k AS STRING) || '.js' WHEN 3 THEN CAST(k AS STRING) || '.5'
  WHEN 4 THEN 'a-b' || CAST(k AS STRING) WHEN 5 THEN '.x' || CAST(k AS STRING)
  WHEN 6 THEN repeat('z', 28) || CAST(k AS STRING) ELSE 'shop.' || CAST(k AS STRING) END"""


@query(
    "handle_valid",
    with_tables("fx_base", extra=f"t AS (SELECT k, {_HANDLES} AS handle FROM fx_base)")
    + f"SELECT k, handle, {d.valid_handle('handle')} AS valid FROM t",
)
def handle_valid(spark, sf):
    base = table(spark, sf, "fx_base").select("k", F.expr(_HANDLES).alias("handle"))
    return base.select("k", "handle", contacts.is_valid_handle("handle").alias("valid"))


@query(
    "ig_from_url",
    with_tables("fx_social")
    + """SELECT domain, url, nullif(regexp_extract(url,
      '^https://www[.]instagram[.]com/([^/?]+)', 1), '') AS handle FROM fx_social""",
)
def ig_from_url(spark, sf):
    return table(spark, sf, "fx_social").select(
        "domain", "url", contacts.handle_from_url("url").alias("handle")
    )


@query(
    "li_company",
    with_tables("fx_social")
    + """SELECT domain, url, CASE WHEN contains(url, 'linkedin.com/company/') THEN
      'https://linkedin.com/company/' || regexp_extract(url, 'company/([^/?]+)', 1) END AS company
    FROM fx_social""",
)
def li_company(spark, sf):
    return table(spark, sf, "fx_social").select(
        "domain", "url", contacts.company_url("url").alias("company")
    )


# -- leads --------------------------------------------------------------------


@query("lead_score", with_tables("fx_leads") + f"SELECT seq, {d.score()} AS quality_score FROM fx_leads")
def lead_score(spark, sf):
    return leads_table(spark, sf, "fx_leads").select("seq", leads.score().alias("quality_score"))


@query(
    "lead_label", with_tables("fx_leads") + f"SELECT seq, {d.label(d.score())} AS quality_label FROM fx_leads"
)
def lead_label(spark, sf):
    return leads_table(spark, sf, "fx_leads").select("seq", leads.label(leads.score()).alias("quality_label"))


@query(
    "lead_has_contact",
    with_tables("fx_leads") + f"SELECT seq, {d.count()} > 0 AS has_contact FROM fx_leads",
)
def lead_has_contact(spark, sf):
    return leads_table(spark, sf, "fx_leads").select("seq", leads.has_contact().alias("has_contact"))


@query("lead_count", with_tables("fx_leads") + f"SELECT seq, {d.count()} AS n FROM fx_leads")
def lead_count(spark, sf):
    return leads_table(spark, sf, "fx_leads").select("seq", leads.contact_count().alias("n"))


@query(
    "lead_build",
    with_tables("fx_leads")
    + f"""SELECT seq, CASE WHEN business_name = '' THEN 'Unknown' ELSE business_name END AS business_name,
      niche, website, emails, phones, 'seed' AS source_query, email_origin,
      '2024-06-01T00:00:00+00:00' AS scraped_at FROM fx_leads WHERE {d.count()} > 0""",
)
def lead_build(spark, sf):
    found = leads_table(spark, sf, "fx_leads").withColumnRenamed("website", "url")
    built = build_leads(found, F.lit("seed"), F.lit("2024-06-01T00:00:00+00:00"))
    return built.select(
        "seq", "business_name", "niche", "website", join_list("emails").alias("emails"),
        join_list("phones").alias("phones"), "source_query", "email_origin", "scraped_at",
    )


_SEARCH = (
    "business_name", "website", "emails", "linkedin_urls", "whatsapp_numbers",
    "instagram_handles", "phones", "source_query",
)


def search_sql() -> str:
    parts = []
    for i, c in enumerate(_SEARCH):
        if c in vocab.CONTACT_LISTS:
            parts.append(f"CASE WHEN {c} = '' THEN '' ELSE ' ' || replace({c}, ' | ', ' ') END")
        else:
            parts.append(c if i == 0 else f"' ' || {c}")
    return f"lower({' || '.join(parts)})"


@query("lead_search", with_tables("fx_leads") + f"SELECT seq, {search_sql()} AS search FROM fx_leads")
def lead_search(spark, sf):
    return leads_table(spark, sf, "fx_leads").select("seq", leads.search_text().alias("search"))


@query(
    "lead_display",
    with_tables("fx_leads")
    + """SELECT seq, rtrim(regexp_replace(website, '^https?://(www[.])?', ''), '/') AS site,
      whatsapp_numbers AS wa, instagram_handles AS ig FROM fx_leads""",
)
def lead_display(spark, sf):
    wa = F.transform("whatsapp_numbers", contacts.digits_of)
    ig = F.transform("instagram_handles", leads.display_handle)
    return leads_table(spark, sf, "fx_leads").select(
        "seq", leads.display_site("website").alias("site"), join_list(wa).alias("wa"), join_list(ig).alias("ig")
    )


@query(
    "lead_stamp",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp FROM events",
)
def lead_stamp(spark, sf):
    return driver_table(spark, sf, "events").select("event_id", leads.iso_text("ts").alias("stamp"))


@query(
    "list_codec",
    with_tables("fx_leads")
    + f"SELECT seq, {d.n_items('emails')} AS n, emails AS text FROM fx_leads",
)
def list_codec(spark, sf):
    items = split_list("emails")
    return table(spark, sf, "fx_leads").select("seq", F.size(items).alias("n"), join_list(items).alias("text"))

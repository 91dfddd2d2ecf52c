"""Input tables derived from the driver's tables, as SQL both engines run.

The driver tables hold almost no contact data, so pages, leads, search results
and lookups are derived row by row from ``customer`` (and log lines from
``events``).  Nothing is sampled or filtered: each customer gives one page, one
lead, one search result, so the inputs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import split_list
from leadmill.operators.reuse import computed_once

CLOCK = "2024-06-01 00:00:00"
# "hello@bizmail.com" XOR 0x42 behind its key byte.
SHIELDED = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "hello@bizmail.com")

_S = "CAST({} AS STRING)"
K, G = _S.format("k"), _S.format("g")

_BASE = f"""
SELECT c_custkey AS k, CAST(floor(c_custkey / 3) AS BIGINT) AS g,
  'biz' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) || '.com' AS h,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'automotive'
    WHEN 'BUILDING' THEN 'real_estate' WHEN 'FURNITURE' THEN 'ecommerce'
    WHEN 'HOUSEHOLD' THEN 'hospitality' ELSE 'saas' END AS niche,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'dealership'
      WHEN 'BUILDING' THEN 'real estate' WHEN 'FURNITURE' THEN 'shop'
      WHEN 'HOUSEHOLD' THEN 'hotel' ELSE 'software' END END AS word
FROM customer"""

_PAGE_PARTS = f"""
SELECT k, g, h, niche, word,
  CASE WHEN k % 29 = 0 THEN 'https://shop.zillow.com/x' || {K}
    WHEN k % 31 = 0 THEN 'https://a' || {K} || '.gov.uk/'
    WHEN k % 37 = 0 THEN 'https://' || h || '/blog/p' || {K}
    WHEN k % 41 = 0 THEN 'https://' || h || '/price.pdf'
    WHEN k % 3 = 1 AND g % 2 = 0 THEN 'https://' || h || '/contact'
    WHEN k % 3 = 1 THEN 'http://' || h || '/contact'
    WHEN k % 3 = 2 THEN 'https://' || h || '/about-us'
    WHEN g % 2 = 0 THEN 'https://' || h || '/'
    ELSE 'https://www.' || h || '/' END AS url,
  CASE WHEN k % 43 = 0 THEN 'Microsoft Partner ' || {K}
    WHEN k % 47 = 0 THEN 'Acme | SEO'
    ELSE 'Biz ' || {G} || ' ' || word END AS title,
  CASE k % 23 WHEN 0 THEN 'investor relations'
    WHEN 1 THEN 'Sign in to your account' WHEN 2 THEN 'seo agency'
    WHEN 3 THEN 'free download' WHEN 4 THEN 'faculty of' ELSE '' END AS junk,
  CASE k % 7 WHEN 0 THEN 'Write to Sales' || {K} || '@' || h || '.'
    WHEN 1 THEN 'info' || {K} || ' [at] biz' || {G} || ' [dot] com'
    WHEN 2 THEN '<a href="mailto:Hi' || {K} || '@' || h || '?subject=x">mail</a>'
    WHEN 3 THEN '<i data-m="info' || {K} || '%40biz' || {G} || '%2Ecom"></i>'
    WHEN 4 THEN '<span class="c" data-cfemail="{SHIELDED}">[protected]</span>'
    WHEN 5 THEN 'you@example.com' ELSE '' END AS mail_block,
  CASE k % 5 WHEN 0 THEN '+1 (555) 123-' || lpad(CAST(k % 10000 AS STRING), 4, '0')
    WHEN 1 THEN '020 7946 0958' WHEN 2 THEN '+44 20 7946 0958'
    ELSE '' END AS phone_block,
  CASE WHEN k % 8 = 0 THEN '<a href="https://wa.me/1555'
    || lpad({K}, 7, '0') || '">chat</a>' ELSE '' END AS wa_block,
  CASE k % 6 WHEN 0 THEN '<a href="https://www.instagram.com/biz_' || {G} || '/">ig</a>'
    WHEN 1 THEN 'follow @biz_' || {K}
    WHEN 2 THEN '<a href="https://www.instagram.com/p/x' || {K} || '/">pic</a>'
    ELSE '' END AS ig_block,
  CASE WHEN k % 9 = 0 THEN '<a href="http://www.linkedin.com/company/biz'
    || {G} || '/">in</a>' ELSE '' END AS li_block,
  CASE WHEN k % 2 = 0 THEN '<meta property="og:site_name" content="Biz &amp; Co '
    || {G} || '">' ELSE '' END AS og_block,
  CASE WHEN k % 11 = 0 THEN '' ELSE '<nav><a href="/contact">Contact us</a> '
    || '<a class="nav" href="/about-us"><b>About</b> us</a> '
    || '<a href="/about">About</a></nav>' END AS nav_block
FROM fx_base"""

_PAGES = f"""
SELECT k AS site_seq, url, niche, title,
  CASE WHEN k % 97 = 96 THEN '' ELSE
  '<!DOCTYPE html><html><head><title>' || title || '</title>' || og_block
  || '<script>var m = "decoy' || {K} || '@decoy.com";</script>'
  || '<style>p > a {{ color: red }}</style></head><body>'
  || '<!-- old: hidden' || {K} || '@hidden.com -->' || nav_block
  || '<p title="a > b">Welcome to Biz ' || {G} || ', ' || word
  || ' people &amp; friends.</p><p>' || junk || '</p><p>' || mail_block
  || '</p><p>' || phone_block || '</p><p>' || wa_block || ' ' || ig_block
  || ' ' || li_block || '</p></body></html>' END AS html
FROM fx_page_parts"""


def _joined(n: str, item) -> str:
    """' | '-joined list of up to six items, its length given by *n*."""
    parts = [f"CASE WHEN {n} >= 1 THEN {item(1)} ELSE '' END"]
    parts += [f"CASE WHEN {n} >= {i} THEN ' | ' || {item(i)} ELSE '' END" for i in range(2, 7)]
    return "(" + " || ".join(parts) + ")"


def _leads(seq: str, shift: int, host: str) -> str:
    s = f"(k + {shift})"
    return f"""
SELECT {seq} AS seq,
  CASE WHEN k % 47 = 0 THEN 'Acme | SEO' WHEN k % 17 = 0 THEN ''
    ELSE 'Biz ' || {K} END AS business_name,
  niche,
  CASE WHEN k % 53 = 0 THEN '' WHEN k % 29 = 0 THEN 'https://shop.zillow.com/' || {K}
    WHEN k % 3 = 1 THEN 'http://www.' || {host} || '/contact'
    WHEN k % 3 = 2 THEN 'https://' || {host} || '/about-us'
    ELSE 'https://' || {host} || '/' END AS website,
  {_joined(f"{s} % 7", lambda i: f"'m{i}_' || {K} || '@' || h")} AS emails,
  {_joined(f"{s} % 5", lambda i: f"'1555' || lpad({K}, 6, '0') || '{i}'")} AS whatsapp_numbers,
  {_joined(f"{s} % 4", lambda i: f"'ig{i}_' || {K}")} AS instagram_handles,
  {_joined(f"{s} % 4", lambda i: f"'https://linkedin.com/company/c{i}-' || {K}")} AS linkedin_urls,
  {_joined(f"{s} % 6", lambda i: f"'4420' || lpad({K}, 7, '0') || '{i}'")} AS phones,
  CASE WHEN k % 19 = 0 THEN '' ELSE 'q' || CAST(k % 5 AS STRING) END AS source_query,
  CASE WHEN k % 10 = 3 THEN 'inferred' WHEN k % 10 = 4 THEN 'mixed'
    ELSE 'scraped' END AS email_origin,
  '2024-01-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') || 'T00:00:00+00:00' AS scraped_at
FROM fx_base"""


# A query holds the results of 140 neighbouring customers of one niche, about
# four per engine, whatever the size of the table.
_BLOCK = "CAST(floor(k / 140) AS BIGINT)"
_QUERY = "niche || ' q' || CAST({} AS STRING)"
_RESULT_URL = f"""CASE WHEN k % 29 = 0 THEN 'https://shop.zillow.com/x' || {K}
    WHEN k % 41 = 0 THEN 'https://' || h || '/price.pdf'
    WHEN k % 37 = 0 THEN 'ftp://' || h || '/'
    WHEN k % 3 = 0 THEN 'https://' || h || '/'
    WHEN k % 3 = 1 THEN 'https://' || h || '/blog/p' || {K}
    ELSE 'https://www.' || h || '/contact' END"""
_RESULT_TITLE = f"""CASE WHEN k % 43 = 0 THEN 'Microsoft Partner ' || {K}
    WHEN k % 7 = 0 AND {_BLOCK} % 2 = 1 THEN 'Football club ' || {K}
    WHEN k % 10 = 9 THEN 'Sign in - Biz ' || {G}
    WHEN k % 10 = 8 THEN 'Latest news and lyrics download'
    ELSE 'Biz ' || {G} || ' ' || word END"""

_SERP = f"""
SELECT {_QUERY.format(_BLOCK)} AS query, {_BLOCK} * 7919 % 100003 AS query_pos, niche, k % 7 AS engine_pos, k AS rank,
  {_RESULT_URL} AS url, {_RESULT_TITLE} AS title
FROM fx_base"""

_CACHE = f"""
SELECT {_QUERY.format(_BLOCK)} AS query, niche, ({_BLOCK} % 10) * 40 AS hours_ago, k AS rank,
  {_RESULT_URL} AS url,
  CASE WHEN k % 12 = 5 THEN '' ELSE {_RESULT_TITLE} END AS title
FROM fx_base"""

_LINK = f"'https://' || h || '/p' || {K}"
_HREFS = f"""
SELECT k,
  CASE k % 4 WHEN 0 THEN 'ddg' WHEN 1 THEN 'bing' WHEN 2 THEN 'ecosia' ELSE 'searx' END AS engine,
  CASE k % 16
    WHEN 0 THEN 'https://duckduckgo.com/l/?uddg=' || url_encode({_LINK}) || '&rut=abc'
    WHEN 4 THEN '//duckduckgo.com/l/?kh=1&uddg=' || url_encode(url_encode({_LINK}))
    WHEN 8 THEN {_LINK}
    WHEN 12 THEN '/l/?uddg=' || url_encode({_LINK} || '?a=1+2')
    WHEN 1 THEN 'https://www.bing.com/ck/a?!&mkt=en&u=a1' || @B64@ || '&ntb=1'
    WHEN 5 THEN {_LINK}
    WHEN 9 THEN 'ftp://' || h || '/x'
    WHEN 13 THEN 'https://www.bing.com/ck/a?x=1'
    WHEN 2 THEN 'https://www.ecosia.org/redirect?u=' || url_encode({_LINK})
    WHEN 6 THEN {_LINK}
    WHEN 10 THEN '/redirect?x=1&target=' || url_encode({_LINK})
    WHEN 14 THEN '/redirect?url=&x=2'
    WHEN 3 THEN 'https://search.example/search?q=' || url_encode(url_encode({_LINK}))
    WHEN 7 THEN {_LINK}
    WHEN 11 THEN '/search?q=plain+words'
    ELSE '/search?lang=en' END AS href,
  CASE k % 16 WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 13 THEN NULL WHEN 14 THEN NULL
    WHEN 11 THEN NULL WHEN 15 THEN NULL
    WHEN 12 THEN {_LINK} || '?a=1+2'
    ELSE {_LINK} END AS target
FROM fx_base"""

_LOG = """
SELECT ts, event_id,
  CASE event_type
    WHEN 'view' THEN 'INFO | Probing https://biz' || CAST(user_id AS STRING) || '.com'
    WHEN 'click' THEN 'INFO | Searching: ''q' || CAST(user_id % 25 AS STRING) || ''''
    WHEN 'purchase' THEN 'INFO | collected ' || CAST(event_id % 9 AS STRING)
      || ' qualified leads for ' || CASE user_id % 3 WHEN 0 THEN 'saas'
        WHEN 1 THEN 'legal' ELSE 'finance' END
    ELSE 'DEBUG | ' || event_type END AS line
FROM events"""

_MX = """
SELECT h AS domain, CASE WHEN min(g) % 11 = 0 THEN NULL
  ELSE min(g) % 5 <> 0 END AS has_mx
FROM fx_base GROUP BY h"""

_NAMES = f"split('{','.join(vocab.GENERIC_MAILBOXES)}', ',')"
_MAILBOX = f"""
SELECT DISTINCT name || '@' || h AS email, (g + array_position({_NAMES}, name) - 1) % 3 = 0 AS accepts
FROM (SELECT h, g, @EACH@({_NAMES}) AS name FROM (SELECT DISTINCT h, g FROM fx_base))"""

_SOCIAL = f"""
SELECT h AS domain, k % 4 AS engine_pos,
  CASE k % 5 WHEN 0 THEN 'https://www.instagram.com/ig{{}}' || {K} || '/?hl=en'
    WHEN 1 THEN 'https://instagram.com/p/x' || {K} || '/'
    WHEN 2 THEN 'https://www.linkedin.com/company/co' || {K} || '/about?trk=foo'
    WHEN 3 THEN 'https://linkedin.com/in/john' || {K}
    ELSE 'https://example.org/' || {K} END AS url
FROM fx_base""".replace("ig{}", "ig_")


def _result_page(engine: int) -> str:
    link, other = "'https://' || h || '/'", "'https://' || h || '/team'"
    ddg = "'https://duckduckgo.com/l/?uddg=' || url_encode({}) || '&amp;rut=1'"
    eco = "'/redirect?u=' || url_encode({})"
    sx = "'/search?q=' || url_encode({})"
    bing = "'https://www.bing.com/ck/a?u=a1' || @B64@ || '&amp;ntb=1'"
    title = f"'Biz ' || {G} || ' &amp; Co'"
    head = "'<html><head><title>results</title></head><body><a href=\"https://ads.example/\">ad</a>'"
    bodies = {
        0: f"""'<div class="result web"><h2><a rel="x" class="result__a" href="' || {ddg.format(link)}
          || '"><b>' || {title} || '</b></a></h2><a class="result__snippet" href="#">snip</a></div>'
          || '<div class="result"><a class="result__a" href="' || {ddg.format(other)}
          || '"></a><div class="result__snippet">About <b>us</b></div></div>'
          || '<div class="result"><a class="result__a" href="' || {ddg.format(link)} || '">dup</a></div>'""",
        1: f"""'<nav><ul><li><h2><a href="https://nav.example/">nav</a></h2></li></ul></nav><ul class="results-standard"><li class="r1"><a class="ob" href="' || {other}
          || '">cached</a><h2><a class="title" href="' || {link} || '">' || {title}
          || '</a></h2></li><li><a class="ob" href="' || {other} || '">Team</a></li>'
          || '<li><a class="title" href="/rel">rel</a></li></ul><ul><li><h2><a href="https://out.example/">out</a></h2></li></ul>'""",
        2: f"""'<ol><li class="b_algo"><div><h2><a href="' || {bing} || '">' || {title}
          || '</a></h2></div><p>x</p></li><li class="b_ad"><h2><a href="https://ad.example/">ad</a></h2></li>'
          || '<li class="b_algo x"><h2 class="t"><a target="_blank" href="' || {other}
          || '">Team</a></h2></li></ol>'""",
        3: f"""'<div class="snippet fdb"><a href="' || {other} || '">fav</a><a class="snippet-title h" href="'
          || {link} || '">' || {title} || '</a></div><div class="snippet"><div><a href="/local">l</a></div><a href="'
          || {other} || '">Team</a></div><div class="snippet">none</div>'""",
        4: f"""'<div class="result"><a class="result__link" href="' || {eco.format(link)} || '">'
          || {title} || '</a></div><div class="mainline result"><a href="' || {other}
          || '">Team</a></div><div class="result">none</div>'""",
        5: f"""'<article class="result result-default"><a class="url_header" href="' || {other}
          || '">u</a><h3><a href="' || {link} || '">' || {title} || '</a></h3></article>'
          || '<article class="result"><a class="url_header" href="' || {sx.format(other)}
          || '">Team</a></article>'""",
    }
    foot = "'<footer><a href=\"https://foot.example/\">foot</a></footer></body></html>'"
    return f"{head} || {bodies[engine]} || {foot}"


_ENGINES = ("ddg", "mojeek", "bing", "brave", "ecosia", "searx")
_SERP_HTML = (
    f"SELECT k, g, CASE k % 6 "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENGINES))
    + f" END AS engine, {_QUERY.format('k')} AS query, CASE k % 6 "
    + " ".join(f"WHEN {i} THEN {_result_page(i)}" for i in range(6))
    + " END AS html FROM fx_base"
)

_SERP_JSON = f"""
SELECT k, g, {_QUERY.format('k')} AS query,
  '{{"organic_results": [{{"title": " Biz ' || {G} || ' ", "link": "https://' || h
  || '/", "position": 1}}, {{"title": "dup", "link": " https://' || h
  || '/ "}}, {{"link": "ftp://' || h || '/"}}, {{"title": null, "link": "https://' || h
  || '/team"}}, {{"title": "no link"}}]}}' AS body
FROM fx_base"""

_SERP_RSS = f"""
SELECT k, g, {_QUERY.format('k')} AS query,
  '<?xml version="1.0"?><rss><channel><title>feed</title><link>https://feed.example/</link>'
  || '<item><title>Biz &amp; Co ' || {G} || '</title><link>https://' || h || '/</link></item>'
  || '<item><title>dup</title><link>https://' || h || '/</link></item>'
  || '<item><title>file</title><link>ftp://' || h || '/</link></item>'
  || '<item><link>https://' || h || '/team</link></item></channel></rss>' AS body
FROM fx_base"""

_EACH = {"spark": "explode", "duck": "unnest"}
_B64 = {
    "spark": "rtrim('=', base64(CAST('https://' || h || '/p' || CAST(k AS STRING) AS BINARY)))",
    "duck": "rtrim(base64(encode('https://' || h || '/p' || CAST(k AS STRING))), '=')",
}

# table -> (tables it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_base": (("customer",), _BASE),
    "fx_page_parts": (("fx_base",), _PAGE_PARTS),
    "fx_pages": (("fx_page_parts",), _PAGES),
    "fx_leads": (("fx_base",), _leads("k", 0, "h")),
    # Prior leads sit on every fourth host, so some keys meet and some do not.
    "fx_prior": (
        ("fx_base",),
        _leads("k", 1, f"'biz' || CAST(g * 4 AS STRING) || '.com'"),
    ),
    "fx_serp": (("fx_base",), _SERP),
    "fx_cache": (("fx_base",), _CACHE),
    "fx_hrefs": (("fx_base",), _HREFS),
    "fx_log": (("events",), _LOG),
    "fx_mx": (("fx_base",), _MX),
    "fx_mailbox": (("fx_base",), _MAILBOX),
    "fx_social": (("fx_base",), _SOCIAL),
    "fx_serp_html": (("fx_base",), _SERP_HTML),
    "fx_serp_json": (("fx_base",), _SERP_JSON),
    "fx_serp_rss": (("fx_base",), _SERP_RSS),
}

KEYS = {
    "customer": "c_custkey", "events": "event_id", "pages": "page_id",
    "documents": "doc_id", "orders": "o_orderkey",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when its scan has too few splits.

    A table with fewer splits than cores holds less than a split's size for
    each core; only that is redistributed, by its key.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, KEYS[name])
    return df


def _in_dialect(sql: str, dialect: str) -> str:
    return sql.replace("@B64@", _B64[dialect]).replace("@EACH@", _EACH[dialect])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived (or driver) table as a DataFrame."""
    if name not in TABLES:
        return driver_table(spark, sf_dir, name)
    # Stands for a stored table: later filters see columns, not these formulas.
    return computed_once(_formulas(spark, sf_dir, name))


def _formulas(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs, sql = TABLES[name]
    for need in needs:
        table(spark, sf_dir, need).createOrReplaceTempView(need)
    return spark.sql(_in_dialect(sql, "spark"))


def leads_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived lead table with its lists as arrays.

    The lists are made in the projection of the formulas: its lambdas keep Spark from
    fusing it into one method, which would be too large for the JVM to compile.
    """
    df = _formulas(spark, sf_dir, name)
    return computed_once(df.withColumns({c: split_list(F.col(c)) for c in vocab.CONTACT_LISTS}))


def with_tables(*names: str, extra: str = "") -> str:
    """``WITH`` clause that gives DuckDB the derived tables."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in TABLES and name not in done:
            needs, sql = TABLES[name]
            for need in needs:
                visit(need)
            done[name] = _in_dialect(sql, "duck")

    for name in names:
        visit(name)
    parts = [f"{n} AS ({s})" for n, s in done.items()]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " "

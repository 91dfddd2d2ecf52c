"""The whole run, from stored pages and results to a merged lead table.

Pages are read once into narrow facts (`page_facts`); everything after that
joins and groups facts.  A caller that runs several plans over one crawl
passes the stored facts in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.functions import leads, phrases, urls, vocab
from leadmill.functions.vocab import Niche
from leadmill.operators import deny, enrich, merge, rank, views
from leadmill.operators.reuse import computed_once
from leadmill.operators.gate import facts_reason
from leadmill.sources.readers import fresh_only


@dataclass(frozen=True)
class Lookups:
    """Supplied tables that stand in for live checks; each is optional."""

    social: DataFrame | None = None  # domain, engine_pos, url
    mx: DataFrame | None = None  # domain, has_mx
    mailboxes: DataFrame | None = None  # email, accepts


def gated_sites(sites: DataFrame, facts: DataFrame, **switches: bool) -> DataFrame:
    """Sites whose own page is stored, in scope and not a brand's.

    Captures of the same URL are reduced after the join, so the facts of the
    whole crawl are not shuffled when the sites are few enough to broadcast.
    """
    once = merge.first_per_key(
        sites.join(facts, "url"), enrich.SITE, ["final_url", "business_name"]
    )
    return (
        once.filter(~F.col("is_empty"))
        .filter(facts_reason("niche", **switches).isNull())
        .filter(~phrases.name_denied("business_name"))
    )


def page_contacts(
    sites: DataFrame, facts: DataFrame, lookups: Lookups = Lookups(), **switches: bool
) -> DataFrame:
    """Contacts of candidate sites (``url, niche, ...``) from page facts.

    Gate and name test first, then sub-pages for sites without an e-mail,
    profiles found elsewhere, mail checks, and generic mailboxes last.

    The sites that pass the gate are written to the shared folder: they are
    few next to the crawl, are used twice (with and without an e-mail), and
    the steps after them start from a short plan.
    """
    keep = [*sites.columns, "business_name", *vocab.CONTACT_LISTS]
    kept = storage.materialize(
        gated_sites(sites, facts, **switches).select(*keep, "contact_links", "is_contactable"),
        "sites",
    )
    found = enrich.add_subpages(kept, facts).select(*keep)
    found = found.withColumn("email_origin", F.lit("scraped"))
    if lookups.social is not None:
        found = enrich.fill_social(found, lookups.social)
    if lookups.mx is not None:
        found = enrich.verify_emails(found, lookups.mx)
    if lookups.mailboxes is not None:
        found = enrich.infer_mailboxes(found, lookups.mailboxes)
    return found


def build_leads(found: DataFrame, source_query: Column, now: Column | None = None) -> DataFrame:
    """Lead rows of sites with any contact."""
    stamp = leads.iso_now() if now is None else now
    return found.filter(leads.has_contact()).select(
        F.coalesce(F.nullif("business_name", F.lit("")), F.lit("Unknown")).alias("business_name"),
        "niche",
        F.col("url").alias("website"),
        *vocab.CONTACT_LISTS,
        source_query.alias("source_query"),
        "email_origin",
        stamp.alias("scraped_at"),
        "seq",
    )


def seed_sites(
    seeds: DataFrame, deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS
) -> DataFrame:
    """Usable seed addresses per niche, first mention kept.

    *seeds*: ``url, niche, seq``.  Unlike search results, seeds are not moved
    to their site root.
    """
    fixed = computed_once(seeds.withColumn("url", urls.normalize_seed("url")))
    usable = deny.drop_denied(fixed.filter(urls.is_page_url("url")), "url", deny_hosts)
    return usable.groupBy("url", "niche").agg(F.min("seq").alias("seq"))


def seed_leads(
    seeds: DataFrame,
    facts: DataFrame,
    lookups: Lookups = Lookups(),
    max_leads: int | None = 20,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    now: Column | None = None,
) -> DataFrame:
    """Leads of a list of sites; *max_leads* per niche in seed order."""
    found = page_contacts(seed_sites(seeds, deny_hosts), facts, lookups)
    made = build_leads(found, F.lit("seed"), now)
    return made if max_leads is None else merge.top_n_per_key(made, ["niche"], ["seq"], max_leads)


def search_leads(
    results: DataFrame,
    facts: DataFrame,
    lookups: Lookups = Lookups(),
    prior: DataFrame | None = None,
    max_leads: int = 20,
    niches: Sequence[Niche] = vocab.NICHES,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    now: Column | None = None,
) -> DataFrame:
    """Leads from discovered results (``query[, query_pos], niche, rank, url, title``).

    Results on a prior domain are skipped, the rest is ranked, and only the
    probe budget of each niche reaches the pages.  ``seq`` is the probe order.
    """
    clean = deny.drop_denied(results.filter(urls.is_page_url("url")), "url", deny_hosts)
    once = merge.distinct_urls(clean, ["niche"], rank.query_order(clean))
    if prior is not None:
        once = rank.skip_prior(once, prior)
    ranked = rank.rank_candidates(once, max_leads, niches)
    sites = ranked.select("url", "niche", "query", F.col("probe_pos").alias("seq"))
    found = page_contacts(sites, facts, lookups)
    made = build_leads(found, F.col("query"), now)
    return merge.top_n_per_key(made, ["niche"], ["seq"], max_leads)


def discover(
    results: DataFrame,
    cache: DataFrame,
    paid: DataFrame | None = None,
    now: Column | None = None,
    niches: Sequence[Niche] = vocab.NICHES,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
) -> DataFrame:
    """Clean results per query: paid, else fresh relevant cache, else the
    first free engine on topic; cached results always come first.

    *results*: ``query[, query_pos], niche, engine_pos, rank, url, title``; *cache*:
    ``query, niche, fetched_at, urls``; *paid*: like results, without engine.
    """
    cols = ["query", "niche", "rank", "url", "title"]
    cached = (
        fresh_only(cache, now=now)
        .select("query", "niche", F.posexplode("urls").alias("rank", "u"))
        .select("query", "niche", "rank", "u.url", "u.title")
    )
    cached = rank.clean_candidates(cached, deny_hosts)
    # With a paid engine its answers settle a query, otherwise a cache on topic
    # does; settled queries never look at the free engines.
    if paid is not None:
        settled = paid.select("query").distinct()
    else:
        settled = rank.relevance(cached, ["query"], niches).filter("relevant").select("query")
    open_results = results.join(settled, "query", "left_anti")
    live = rank.first_engine(open_results, niches, deny_hosts).select(*cols)
    parts = cached.select(*cols, F.lit(0).alias("source_rank")).unionByName(
        live.select(*cols, F.lit(1).alias("source_rank"))
    )
    if paid is not None:
        parts = parts.unionByName(paid.select(*cols, F.lit(1).alias("source_rank")))
    once = merge.distinct_urls(parts, ["query"], ["source_rank", "rank"])
    found = rank.clean_candidates(once, deny_hosts)
    if "query_pos" not in results.columns:
        return found
    places = results.groupBy("query", "niche").agg(F.min("query_pos").alias("query_pos"))
    return found.join(places, ["query", "niche"], "left")


def full_run(
    parts: Sequence[DataFrame],
    prior: DataFrame | None = None,
    emails_only: bool = False,
    min_quality: int = 0,
    max_quality: int = 100,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
) -> DataFrame:
    """From the lead tables of the niches to the table an export writes.

    One lead per host, the caller's quality filters, then the merge with the
    prior leads.  Each part carries ``niche_pos``.
    """
    once = merge.union_niches(*parts)
    kept = views.filter_quality(once, emails_only, min_quality, max_quality)
    if prior is None:
        return merge.with_quality(views.purge(kept, deny_hosts))
    old = views.purge(prior, deny_hosts)
    return merge.with_quality(views.purge(merge.merge_leads(kept, old), deny_hosts))


def search_run(
    results: DataFrame,
    cache: DataFrame,
    facts: DataFrame,
    lookups: Lookups = Lookups(),
    prior: DataFrame | None = None,
    paid: DataFrame | None = None,
    max_leads: int = 20,
    niches: Sequence[Niche] = vocab.NICHES,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    now: Column | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """From stored search results to the table an export writes.

    Discovery, the leads of each niche, one lead per host over the niches in
    their order, and the merge with the prior leads.  *as_of* dates the cache,
    *now* the leads.
    """
    found = storage.materialize(discover(results, cache, paid, as_of, niches, deny_hosts), "found")
    made = storage.materialize(
        search_leads(found, facts, lookups, prior, max_leads, niches, deny_hosts, now), "leads"
    )
    parts = [
        made.filter(F.col("niche") == n.id).withColumn("niche_pos", F.lit(i)) for i, n in enumerate(niches)
    ]
    if prior is not None and "niche_pos" not in prior.columns:
        prior = prior.withColumn("niche_pos", F.lit(None).cast("int"))
    return full_run(parts, prior, deny_hosts=deny_hosts)

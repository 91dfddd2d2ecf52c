"""What a site gets beyond its own page: sub-pages, profiles, checked mail.

All lookups are supplied tables.  Each is reduced to one row per join key
first, so a join never multiplies rows and adaptive execution may split a hot
key of the big side; which side is broadcast is left to measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import contacts, phrases, urls, vocab
from leadmill.functions.text import empty_list, sorted_set
from leadmill.operators.gate import facts_reason

SITE = ["url", "niche"]


# -- contact sub-pages --------------------------------------------------------


def frontier_urls(
    url: Column | str, found: Column | str, limit: int | None = vocab.MAX_SUBPAGES
) -> Column:
    """Sub-pages to read, in order: found links, guessed paths; first five.

    The list is at most the page's own links plus the fixed guesses, so it is
    built in place, per row.
    """
    url = F.col(url) if isinstance(url, str) else url
    found = F.col(found) if isinstance(found, str) else found
    guessed = F.array(*[F.lit(p) for p in vocab.GUESSED_CONTACT_PATHS])
    joined = F.transform(F.concat(found, guessed), lambda rel: urls.url_join(url, rel))
    home = F.concat(F.rtrim(url, F.lit("/")), F.lit("/"))
    kept = F.filter(F.array_distinct(joined), lambda u: u != home)
    return kept if limit is None else F.slice(kept, 1, limit)


def contact_frontier(sites: DataFrame, limit: int | None = vocab.MAX_SUBPAGES) -> DataFrame:
    """``url, niche, pos, sub_url`` for sites that show a way to get in touch; None: no limit."""
    open_sites = sites.filter((F.size("contact_links") > 0) | F.col("is_contactable"))
    # The outer form keeps the optimizer from building the list twice.
    return open_sites.select(
        *SITE, F.posexplode_outer(frontier_urls("url", "contact_links", limit)).alias("pos", "sub_url")
    ).filter("sub_url IS NOT NULL")


def walk_steps(frontier: DataFrame, facts: DataFrame) -> DataFrame:
    """Frontier with what the stored crawl knows of each sub-page.

    The crawl is joined from its own side: a frontier that fits a broadcast
    leaves the facts where they are, and only the few matched rows are put
    back beside the frontier.  Several captures of a URL give one step.
    """
    seen = facts.select(
        F.col("url").alias("sub_url"),
        F.struct(
            "final_url",
            "is_empty",
            F.array_sort(F.array_union("emails", "mailto_emails")).alias("emails"),
            *[c for c in vocab.CONTACT_LISTS if c != "emails"],
            "scope_ids",
            "excluded_ids",
            *[f"is_{name}" for name in phrases.PAGE_FLAGS],
        ).alias("page"),
    )
    matched = (
        frontier.join(seen, "sub_url")
        .groupBy(*SITE, "pos")
        .agg(F.min("page").alias("page"))
    )
    steps = frontier.join(matched, [*SITE, "pos"], "left").select(
        *SITE, "pos", "sub_url", F.col("page").isNotNull().alias("present"), "page.*"
    )
    return steps.select(
        *SITE,
        "pos",
        "sub_url",
        "present",
        "final_url",
        F.coalesce("is_empty", F.lit(True)).alias("is_empty"),
        (F.col("present") & facts_reason("niche").isNull()).alias("accepted"),
        *vocab.CONTACT_LISTS,
    )


_STATE = "struct<misses:int,done:boolean,visited:array<string>,kept:array<int>>"


def _state(misses: Column, done: Column, visited: Column, kept: Column) -> Column:
    return F.struct(
        misses.alias("misses"), done.alias("done"), visited.alias("visited"), kept.alias("kept")
    ).cast(_STATE)


def _advance(state: Column, step: Column, max_misses: int | None) -> Column:
    """One sub-page: found, missed, or seen before."""
    lists = [step[c] for c in vocab.CONTACT_LISTS]
    any_contact = F.lit(False)
    for c in lists:
        any_contact = any_contact | (F.size(c) > 0)
    missed = state["misses"] + 1
    visited = F.concat(state["visited"], F.array(step["final_url"]))
    useless = step["is_empty"] | ~step["accepted"] | ~any_contact
    over = state["done"] if max_misses is None else state["done"] | (state["misses"] >= max_misses)
    return (
        F.when(over, state)
        .when(~step["present"], _state(missed, state["done"], state["visited"], state["kept"]))
        .when(F.array_contains(state["visited"], step["final_url"]), state)
        .when(useless, _state(missed, state["done"], visited, state["kept"]))
        .otherwise(
            _state(
                F.lit(0),
                F.size(step["emails"]) > 0,
                visited,
                F.concat(state["kept"], F.array(step["pos"])),
            )
        )
    )


def contact_walk(steps: DataFrame, max_misses: int | None = vocab.MAX_MISSES) -> DataFrame:
    """Fold the sub-pages of each site in order and keep what they gave.

    *max_misses* in a row end the walk, so does the first e-mail; a page that
    redirects to one already read is passed over.  A site has as many steps as
    `contact_frontier` was asked for, or as its page has links.
    """
    fields = ["pos", "present", "final_url", "is_empty", "accepted", *vocab.CONTACT_LISTS]
    step = F.struct(*[F.col(f) for f in fields])
    walked = steps.groupBy(*SITE).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    start = _state(F.lit(0), F.lit(False), F.array(), F.array())
    walked = walked.withColumn("state", F.aggregate("steps", start, lambda a, x: _advance(a, x, max_misses)))
    used = F.filter("steps", lambda s: F.array_contains(F.col("state.kept"), s["pos"]))
    walked = walked.withColumn("used", used)
    return walked.select(
        *SITE,
        F.size("state.kept").alias("n_used"),
        *[
            # A field of an array of structs is the array of that field.
            sorted_set(F.flatten(F.col(f"used.{c}"))).alias(c)
            for c in vocab.CONTACT_LISTS
        ],
    )


def add_subpages(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill sites without an e-mail from their contact sub-pages.

    Sites that have one pass through untouched; *sites* is read twice and is
    best a stored table.
    """
    bare = sites.filter(F.size("emails") == 0)
    extra = contact_walk(walk_steps(contact_frontier(bare), facts)).drop("n_used")
    extra = extra.withColumnsRenamed({c: f"sub_{c}" for c in vocab.CONTACT_LISTS})
    merged = {
        c: F.array_sort(F.array_union(c, F.coalesce(f"sub_{c}", empty_list())))
        for c in vocab.CONTACT_LISTS
    }
    filled = bare.join(extra, SITE, "left").withColumns(merged).select(*sites.columns)
    return sites.filter(F.size("emails") > 0).unionByName(filled)


# -- social profiles ----------------------------------------------------------


def social_profiles(hits: DataFrame) -> DataFrame:
    """Per domain the profiles of the first engine that found any.

    *hits*: ``domain, engine_pos, url``.  Instagram and LinkedIn are decided
    separately; both come from one pass.
    """
    found = hits.select(
        "domain",
        "engine_pos",
        contacts.handle_from_url("url").alias("handle"),
        contacts.company_url("url").alias("company"),
    ).filter("handle IS NOT NULL OR company IS NOT NULL")
    per_engine = found.groupBy("domain", "engine_pos").agg(
        F.collect_set("handle").alias("handles"), F.collect_set("company").alias("companies")
    )

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.size(c) > 0, F.col("engine_pos")))

    return per_engine.groupBy("domain").agg(
        F.array_sort(first("handles")).alias("found_handles"),
        F.array_sort(first("companies")).alias("found_companies"),
    )


def fill_social(sites: DataFrame, hits: DataFrame) -> DataFrame:
    """Profiles found by search, only where the site named none itself."""
    joined = sites.withColumn("domain", urls.domain_of("url")).join(
        social_profiles(hits), "domain", "left"
    )

    def fill(own: str, found: str) -> Column:
        return F.when(
            (F.size(own) == 0) & F.col("domain").isNotNull(),
            F.coalesce(found, empty_list()),
        ).otherwise(F.col(own))

    return joined.withColumns(
        {
            "instagram_handles": fill("instagram_handles", "found_handles"),
            "linkedin_urls": fill("linkedin_urls", "found_companies"),
        }
    ).drop("domain", "found_handles", "found_companies")


# -- e-mail checks ------------------------------------------------------------


def verify_emails(
    sites: DataFrame, mx: DataFrame, keys: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """Drop undeliverable addresses from the ``emails`` list of each row.

    *mx*: ``domain, has_mx``; of several rows of a domain one with a server is
    enough, and a missing or NULL entry is unknown, which only *strict* rejects.  Each address carries its row
    along, so the sites are read once.  A domain shared by many sites (a mail
    provider) is a hot join key; the lookup side is unique per domain, so
    skew splitting applies.  Sites without an address take no part.
    """
    keys = keys or SITE
    rest = [c for c in sites.columns if c not in keys and c != "emails"]
    # Rows without an address get a key of their own that matches nothing.
    domain = F.coalesce(contacts.email_domain("email"), F.concat(F.lit("\u0000"), *keys))
    long = sites.select(
        *keys, F.struct(*rest).alias("_rest"), F.explode_outer("emails").alias("email")
    ).withColumn("_domain", domain)
    known = mx.groupBy(F.col("domain").alias("_domain")).agg(F.max("has_mx").alias("has_mx"))
    good = (
        F.col("email").isNotNull()
        & ~F.col("_domain").isin(*vocab.DISPOSABLE_EMAIL_DOMAINS)
        & F.coalesce("has_mx", F.lit(not strict))
    )
    checked = (
        long.join(known, "_domain", "left")
        .groupBy(*keys)
        .agg(
            F.any_value("_rest").alias("_rest"),
            F.array_sort(F.collect_list(F.when(good, F.col("email")))).alias("emails"),
        )
    )
    return checked.select(*keys, "_rest.*", "emails").select(*sites.columns)


def generic_mailboxes(mailboxes: DataFrame, limit: int | None = vocab.MAX_INFERRED_MAILBOXES) -> DataFrame:
    """Per domain the first *limit* generic mailboxes known to accept mail.

    *mailboxes*: ``email, accepts``.  Starting from the known mailboxes needs
    no product of prefixes and domains; at most ten names fit a domain.
    """
    names = F.array(*[F.lit(m) for m in vocab.GENERIC_MAILBOXES])
    local = F.substring_index("email", "@", 1)
    good = mailboxes.filter("accepts").select(
        F.lower(F.substring_index("email", "@", -1)).alias("domain"),
        F.array_position(names, local).alias("pos"),
        "email",
    )
    per_domain = (
        good.filter((F.col("pos") > 0) & ~F.col("domain").isin(*vocab.DISPOSABLE_EMAIL_DOMAINS))
        .groupBy("domain")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "email"))).alias("boxes"))
    )
    first = F.col("boxes") if limit is None else F.slice("boxes", 1, limit)
    return per_domain.select(
        "domain", F.transform(first, lambda b: b["email"]).alias("inferred")
    )


def infer_mailboxes(sites: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Give sites without any e-mail their accepted generic mailboxes."""
    joined = sites.withColumn("domain", urls.domain_of("url")).join(
        generic_mailboxes(mailboxes), "domain", "left"
    )
    take = (F.size("emails") == 0) & (F.size("inferred") > 0)
    take = F.coalesce(take, F.lit(False))
    return joined.withColumns(
        {
            "emails": F.when(take, F.array_sort("inferred")).otherwise(F.col("emails")),
            "email_origin": F.when(take, F.lit("inferred")).otherwise(F.col("email_origin")),
        }
    ).drop("domain", "inferred")

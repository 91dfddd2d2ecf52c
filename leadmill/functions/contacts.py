"""Contact extraction: text, links and raw HTML -> sorted distinct lists.

Each extractor is a chain of ``regexp_extract_all`` and array functions.  The
expensive patterns sit behind a plain substring test, so a page without an
``@`` never pays for the e-mail pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import col, empty_list, percent_decode, sorted_set
from leadmill.functions.urls import path_of, raw_host_of


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _guarded(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(empty_list())


def _sources(links: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.coalesce(col(links), empty_list()), F.array(F.coalesce(col(text), F.lit("")))
    )


# -- e-mail -------------------------------------------------------------------


def clean_email(raw: Column | str) -> Column:
    text = F.btrim(F.btrim(col(raw)), F.lit(".,;:<>'\""))
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


def email_domain(email: Column | str) -> Column:
    return F.lower(F.substring_index(col(email), "@", -1))


def is_valid_email(email: Column | str) -> Column:
    email = col(email)
    has_at = F.contains(email, F.lit("@"))
    domain = email_domain(email)
    denied = domain.isin(*vocab.NOISE_EMAIL_DOMAINS, "gov.in") | F.rlike(
        domain, F.lit("(?:" + "|".join(s.replace(".", "\\.") for s in vocab.DENIED_EMAIL_SUFFIXES) + ")$")
    )
    local = F.substring_index(email, "@", 1)
    rest = F.substr(email, F.length(local) + 2)
    shape = (local != "") & F.contains(rest, F.lit("."))
    return (~has_at | (~denied & shape)) & (F.length(email) <= 254)


def _valid(emails: Column, need_at: bool = False) -> Column:
    if need_at:
        return F.filter(emails, lambda e: F.contains(e, F.lit("@")) & is_valid_email(e))
    return F.filter(emails, is_valid_email)


def plain_emails(text: Column | str) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    found = F.transform(_matches(text, vocab.EMAIL_PATTERN), clean_email)
    return _guarded(F.contains(text, F.lit("@")), sorted_set(_valid(found)))


def obfuscated_emails(text: Column | str) -> Column:
    """``name [at] host [dot] com`` and its variants."""
    text = F.coalesce(col(text), F.lit(""))

    def rewrite(m: Column) -> Column:
        m = F.lower(m)
        for old, new in vocab.OBFUSCATION_STEPS:
            m = F.replace(m, F.lit(old), F.lit(new))
        return m

    found = F.transform(_matches(text, vocab.OBFUSCATED_EMAIL_PATTERN), rewrite)
    return _guarded(
        F.contains(F.lower(text), F.lit("dot")), sorted_set(_valid(found, need_at=True))
    )


def text_emails(text: Column | str) -> Column:
    return F.array_sort(F.array_union(plain_emails(text), obfuscated_emails(text)))


def mailto_emails(links: Column | str) -> Column:
    """Addresses of ``mailto:`` links."""
    marked = F.filter(
        F.coalesce(col(links), empty_list()),
        lambda x: F.startswith(F.lower(x), F.lit("mailto:")),
    )
    found = F.transform(
        marked, lambda x: F.lower(F.btrim(F.split_part(F.substr(x, F.lit(8)), F.lit("?"), F.lit(1))))
    )
    return sorted_set(_valid(found, need_at=True))


def mailto_html_emails(html: Column | str) -> Column:
    """`mailto:` addresses read from the raw markup, domain shape checked only."""
    raw = _matches(F.coalesce(col(html), F.lit("")), vocab.MAILTO_PATTERN, 1)
    found = F.transform(raw, lambda x: F.split_part(F.lower(F.btrim(x)), F.lit("?"), F.lit(1)))
    return sorted_set(
        F.filter(
            found,
            lambda e: F.contains(e, F.lit("@"))
            & F.contains(F.substring_index(e, "@", -1), F.lit(".")),
        )
    )


def decode_cloudflare(hex_text: Column | str) -> Column:
    """Undo the one-byte XOR shield; NULL when it hides no address."""
    h = F.btrim(F.coalesce(col(hex_text), F.lit("")))
    n = F.length(h)
    ok = (n >= 4) & (n % 2 == 0) & F.rlike(h, F.lit("^[0-9a-fA-F]+$"))

    def byte(at: Column) -> Column:
        return F.conv(F.substr(h, at, F.lit(2)), 16, 10).cast("int")

    # The key byte is position 1; the guard keeps short texts out of sequence().
    starts = F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3)), F.lit(2))
    plain = F.array_join(
        F.transform(starts, lambda i: F.chr(byte(i).bitwiseXOR(byte(F.lit(1))))), ""
    )
    plain = F.btrim(F.when(ok, plain))
    shape = F.contains(plain, F.lit("@")) & F.contains(
        F.substring_index(plain, "@", -1), F.lit(".")
    )
    return F.when(shape, plain)


def cloudflare_emails(html: Column | str) -> Column:
    html = F.coalesce(col(html), F.lit(""))
    decoded = F.transform(_matches(html, vocab.CLOUDFLARE_PATTERN, 1), decode_cloudflare)
    found = F.transform(F.filter(decoded, lambda x: x.isNotNull()), clean_email)
    return _guarded(F.contains(html, F.lit("data-cfemail")), sorted_set(_valid(found)))


def encoded_emails(html: Column | str) -> Column:
    """Percent-encoded addresses in the raw markup."""
    html = F.coalesce(col(html), F.lit(""))
    found = F.transform(
        _matches(html, vocab.PERCENT_EMAIL_PATTERN), lambda m: clean_email(percent_decode(m))
    )
    return _guarded(
        F.contains(html, F.lit("%40")), sorted_set(_valid(found, need_at=True))
    )


def html_emails(html: Column | str) -> Column:
    return F.array_sort(F.array_union(cloudflare_emails(html), encoded_emails(html)))


# -- phones -------------------------------------------------------------------


def digits_of(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def whatsapp_numbers(links: Column | str, text: Column | str) -> Column:
    found = F.flatten(
        F.transform(_sources(links, text), lambda s: _matches(s, vocab.WHATSAPP_PATTERN, 1))
    )
    return sorted_set(F.filter(found, lambda d: F.length(d).between(10, 15)))


def is_plausible_phone(digits: Column | str) -> Column:
    d = col(digits)
    n = F.length(d)
    coded = F.substring(d, 1, 2).isin(*vocab.CALLING_CODES_2) | F.substring(d, 1, 3).isin(
        *vocab.CALLING_CODES_3
    )
    first = F.substring(d, 1, 1)
    return (
        (n == 10)
        | ((n == 11) & first.isin("1", "7"))
        | (n.between(12, 15) & coded)
        | ((n == 12) & (first == "1"))
    )


def is_real_phone(digits: Column | str) -> Column:
    """Plausible, and not zeros, repeats or padding."""
    d = col(digits)
    zeros = F.length(d) - F.length(F.replace(d, F.lit("0"), F.lit("")))
    kinds = F.size(F.array_distinct(F.split(d, "")))
    return (
        is_plausible_phone(d)
        & (zeros * 2 <= F.length(d))
        & (kinds > 2)
        & ~F.startswith(d, F.lit("00"))
    )


def drop_contained(numbers: Column | str) -> Column:
    """Drop a number that is part of a longer one in the same list."""
    a = col(numbers)
    return F.array_sort(
        F.filter(
            a,
            lambda x: ~F.exists(
                a, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)
            ),
        )
    )


def phones(text: Column | str) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    found = F.transform(_matches(text, vocab.PHONE_PATTERN), digits_of)
    return drop_contained(F.array_distinct(F.filter(found, is_real_phone)))


# -- social -------------------------------------------------------------------


def clean_handle(raw: Column | str) -> Column:
    h = F.btrim(F.btrim(col(raw)), F.lit(",.;:!?'\"()|"))
    h = F.regexp_replace(h, "^@", "")
    h = F.substring_index(h, "/", -1)
    return F.regexp_replace(h, "[?#].*$", "")


def is_valid_handle(handle: Column | str) -> Column:
    h = F.lower(col(handle))
    return (
        F.length(h).between(2, 30)
        & ~h.isin(*vocab.INSTAGRAM_SKIP_HANDLES)
        & F.rlike(h, F.lit("^[a-z0-9_.]+$"))
        & ~F.startswith(h, F.lit("."))
        & ~F.endswith(h, F.lit("."))
        & ~F.rlike(h, F.lit(vocab.FILE_LIKE_HANDLE_PATTERN))
        & ~F.rlike(h, F.lit("^[0-9.]+$"))
    )


def instagram_handles(links: Column | str, text: Column | str) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    linked = F.flatten(
        F.transform(
            F.coalesce(col(links), empty_list()),
            lambda s: F.transform(_matches(s, vocab.INSTAGRAM_LINK_PATTERN, 1), clean_handle),
        )
    )
    linked = F.filter(linked, lambda h: ~F.lower(h).isin(*vocab.INSTAGRAM_SKIP_PATHS))
    said = _guarded(
        F.contains(text, F.lit("@")),
        F.transform(_matches(text, vocab.AT_HANDLE_PATTERN, 1), clean_handle),
    )
    return sorted_set(F.filter(F.concat(linked, said), is_valid_handle))


def _site_path(url: Column | str, site: str) -> Column:
    on_site = F.contains(raw_host_of(url), F.lit(site))
    return F.when(on_site, F.btrim(path_of(url), F.lit("/")))


def handle_from_url(url: Column | str) -> Column:
    """Profile name of an Instagram address, or NULL."""
    handle = F.split_part(_site_path(url, "instagram.com"), F.lit("/"), F.lit(1))
    keep = F.length(handle).between(2, 30) & ~F.lower(handle).isin(
        *vocab.PROFILE_URL_SKIP_PATHS
    )
    return F.when(keep, handle)


def company_url(url: Column | str) -> Column:
    """Canonical LinkedIn company address, or NULL."""
    slug = F.regexp_extract(_site_path(url, "linkedin.com"), "^company/([^/]+)", 1)
    return F.when(slug != "", F.concat(F.lit("https://linkedin.com/company/"), slug))


def linkedin_urls(links: Column | str, text: Column | str) -> Column:
    found = F.flatten(
        F.transform(_sources(links, text), lambda s: _matches(s, vocab.LINKEDIN_PATTERN))
    )

    def canonical(u: Column) -> Column:
        u = F.rtrim(u, F.lit(".,;:)'\""))
        u = F.regexp_replace(u, "^http://", "https://")
        u = F.regexp_replace(u, "^https://www\\.linkedin\\.com", "https://linkedin.com")
        return F.rtrim(u, F.lit("/"))

    return sorted_set(F.transform(found, canonical))


# -- everything ---------------------------------------------------------------


def all_contacts(text: Column | str, links: Column | str) -> dict[str, Column]:
    """The five contact lists of one page, by column name."""
    whatsapp = whatsapp_numbers(links, text)
    return {
        "emails": F.array_sort(F.array_union(text_emails(text), mailto_emails(links))),
        "whatsapp_numbers": whatsapp,
        "instagram_handles": instagram_handles(links, text),
        "linkedin_urls": linkedin_urls(links, text),
        "phones": F.when(F.size(whatsapp) == 0, phones(text)).otherwise(empty_list()),
    }

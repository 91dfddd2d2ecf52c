"""URL column functions.

``parse_url`` raises on malformed input and ``try_parse_url`` gives NULL for
hosts with an underscore or paths with a blank, both common in crawled links,
so the parts are taken with anchored patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import (
    bind,
    blank_to_null,
    col,
    contains_any,
    ends_with_any,
    percent_decode,
    trim_ws,
)

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
HOST_PATTERN = rf"^[\x00-\x20]*(?:{_SCHEME})?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
NETLOC_PATTERN = rf"^[\x00-\x20]*(?:{_SCHEME})?//([^/?#]*)"
PATH_PATTERN = rf"^[\x00-\x20]*(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)"
SCHEME_PATTERN = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), SCHEME_PATTERN, 1))


def netloc_of(url: Column | str) -> Column:
    return F.regexp_extract(col(url), NETLOC_PATTERN, 1)


def path_of(url: Column | str) -> Column:
    path = F.regexp_extract(col(url), PATH_PATTERN, 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def raw_host_of(url: Column | str) -> Column:
    """Lower-case host name, ``www.`` kept; empty when there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), HOST_PATTERN, 1))
    return F.btrim(host, F.lit("[]"))


def host_of(url: Column | str) -> Column:
    """Lower-case host name without a leading ``www.``."""
    return F.regexp_replace(raw_host_of(url), "^www\\.", "")


def host_key(url: Column | str) -> Column:
    """Key two sites are the same by: the host, else the raw text."""
    raw = F.coalesce(col(url), F.lit(""))
    return bind(host_of(raw), lambda h: F.when(h != "", h).otherwise(F.lower(raw)))


def domain_of(url: Column | str) -> Column:
    """Host or NULL."""
    return bind(host_of(url), blank_to_null)


def normalize_domain(url: Column | str) -> Column:
    """Host of a URL or of a bare ``host/path`` text, or NULL."""
    url = col(url)
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(
        F.concat(F.lit("http://"), url)
    )
    return domain_of(full)


def is_same_domain(a: Column | str, b: Column | str) -> Column:
    same = normalize_domain(a) == normalize_domain(b)
    return F.coalesce(same, F.lit(False))


def is_page_url(url: Column | str) -> Column:
    """An http(s) address that does not end like a file download."""
    path = F.lower(path_of(url))
    return scheme_of(url).isin("http", "https") & ~ends_with_any(
        path, vocab.NON_PAGE_ENDINGS
    )


def first_segment(url: Column | str) -> Column:
    return F.split_part(F.btrim(F.lower(path_of(url)), F.lit("/")), F.lit("/"), F.lit(1))


def to_site_root(url: Column | str) -> Column:
    """Content pages (blog, news, ...) become the root of their site."""
    url = col(url)
    root = F.concat(scheme_of(url), F.lit("://"), netloc_of(url), F.lit("/"))
    return F.when(first_segment(url).isin(*vocab.CONTENT_PATH_SEGMENTS), root).otherwise(url)


def normalize_seed(url: Column | str) -> Column:
    url = trim_ws(F.coalesce(col(url), F.lit("")))
    return (
        F.when(url == "", F.lit(None))
        .when(F.startswith(url, F.lit("http")), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )


def prior_key(url: Column | str) -> Column:
    """Textual site key that keeps a port or user name, unlike `host_of`."""
    key = F.lower(F.coalesce(col(url), F.lit("")))
    for prefix in ("^http://", "^https://", "^www\\."):
        key = F.regexp_replace(key, prefix, "")
    return F.split_part(key, F.lit("/"), F.lit(1))


def path_depth(url: Column | str) -> Column:
    """Number of path segments, 0 for the root."""
    path = F.btrim(path_of(url), F.lit("/"))
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/")))


def host_rule_denied(host: Column) -> Column:
    return (
        (host == "")
        | ends_with_any(host, vocab.DENIED_HOST_SUFFIXES)
        | contains_any(host, vocab.DENIED_HOST_MARKERS)
    )


def path_rule_denied(url: Column) -> Column:
    return bind(
        F.lower(path_of(url)),
        lambda path: ends_with_any(path, vocab.DENIED_PATH_ENDINGS)
        | contains_any(path, vocab.DENIED_PATH_FRAGMENTS),
    )


def url_rule_denied(url: Column | str) -> Column:
    """The deny rules that need no host list: suffixes, markers, paths.

    An address without a host is denied too.
    """
    url = F.coalesce(col(url), F.lit(""))
    return bind(host_of(url), host_rule_denied) | path_rule_denied(url)


def host_suffixes(host: Column | str) -> Column:
    """``a.b.com`` -> ``[a.b.com, b.com, com]``: every parent domain."""
    return bind(
        F.split(col(host), "\\."),
        lambda labels: F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )


# -- relative references ----------------------------------------------------


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    start = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    folded = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    # A path that ends in a dot segment names a folder.
    slash = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.regexp_replace(F.concat(folded, slash), "^/", ""))


def url_join(base: Column | str, href: Column | str) -> Column:
    """Resolve a link against the page it stands on (RFC 3986).

    Most links are absolute or plain ``/path``; dot segments are only folded
    where a link has them.
    """
    base, href = col(base), col(href)
    scheme = scheme_of(base)
    base_path = F.regexp_extract(base, PATH_PATTERN, 1)
    site = F.concat(scheme, F.lit("://"), netloc_of(base))
    tail = F.regexp_replace(F.regexp_extract(href, "^[^?#]*(.*)$", 1), "\\??#?$", "")

    def merged(path: Column) -> Column:
        folder = F.regexp_replace(base_path, "[^/]*$", "")
        joined = F.regexp_replace(F.concat(F.lit("/"), folder, path), "/{2,}", "/")
        return F.when(F.startswith(path, F.lit("/")), path).otherwise(joined)

    def resolved(path: Column) -> Column:
        dotted = F.rlike(path, F.lit(r"/\.\.?(?:/|$)"))
        return F.when(dotted, _drop_dots(path)).otherwise(path)

    target = bind(bind(F.regexp_extract(href, "^([^?#]*)", 1), merged), resolved)
    return (
        F.when(href == "", base)
        .when(F.rlike(href, F.lit(SCHEME_PATTERN)), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(site, base_path, tail))
        .otherwise(F.concat(site, target, tail))
    )


# -- search-engine redirect links --------------------------------------------


def query_param(url: Column | str, name: str) -> Column:
    """First non-blank value of a query parameter, decoded once; '' if none."""
    query = F.regexp_extract(col(url), QUERY_PATTERN, 1)
    value = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return percent_decode(value, plus_is_space=True)


def unwrap_ddg(href: Column | str) -> Column:
    query = F.regexp_extract(col(href), QUERY_PATTERN, 1)
    target = percent_decode(percent_decode(query_param(href, "uddg")))
    return F.when(F.contains(query, F.lit("uddg")), target)


def unwrap_bing(href: Column | str) -> Column:
    href = col(href)
    raw = query_param(href, "u")
    body = F.regexp_replace(raw, "^a1", "")
    target = F.try_to_binary(body, F.lit("base64")).cast("string")
    is_http = F.startswith(href, F.lit("http"))
    return F.when(
        F.contains(href, F.lit("bing.com/ck/")),
        F.when(F.startswith(target, F.lit("http")), target),
    ).when(is_http, href)


def unwrap_ecosia(href: Column | str) -> Column:
    href = col(href)
    direct = F.startswith(href, F.lit("http")) & ~F.contains(
        href, F.lit("ecosia.org/redirect")
    )
    found = F.coalesce(
        *[blank_to_null(query_param(href, p)) for p in ("u", "target", "url")]
    )
    return F.when(direct, href).otherwise(blank_to_null(percent_decode(found)))


def unwrap_searx(href: Column | str) -> Column:
    href = col(href)
    direct = F.startswith(href, F.lit("http")) & ~F.contains(href, F.lit("/search?"))
    target = percent_decode(percent_decode(query_param(href, "q")))
    return F.when(direct, href).when(F.startswith(target, F.lit("http")), target)


UNWRAP = {
    "ddg": unwrap_ddg,
    "bing": unwrap_bing,
    "ecosia": unwrap_ecosia,
    "searx": unwrap_searx,
}

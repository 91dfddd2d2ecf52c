"""Expressions of the check SQL, in DuckDB's dialect.

These restate the semantics independently of the Spark functions: other
function names, RE2 patterns instead of Java ones, no shared expression code.
Only the fixed word lists are shared.
"""

from __future__ import annotations

from leadmill.functions import vocab


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def any_of(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def ends(text: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {q(e)})" for e in endings) + ")"


def joined(lst: str) -> str:
    return f"array_to_string({lst}, ' | ')"


# -- URLs ---------------------------------------------------------------------

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"


def raw_host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^(?:{_SCHEME})?//(?:[^/?#]*@)?([^/?#:]+)', 1))"


def host(u: str) -> str:
    return f"regexp_replace({raw_host(u)}, '^www\\.', '')"


def host_key(u: str) -> str:
    return f"coalesce(nullif({host(u)}, ''), lower({u}))"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)', 1)"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_SCHEME})?//([^/?#]*)', 1)"


def is_page(u: str) -> str:
    return f"({scheme(u)} IN ('http', 'https') AND NOT {ends(f'lower({path(u)})', vocab.NON_PAGE_ENDINGS)})"


def rule_denied(u: str) -> str:
    h, p = host(u), f"lower({path(u)})"
    return (
        f"({h} = '' OR {ends(h, vocab.DENIED_HOST_SUFFIXES)} OR {any_of(h, vocab.DENIED_HOST_MARKERS)}"
        f" OR {ends(p, vocab.DENIED_PATH_ENDINGS)} OR {any_of(p, vocab.DENIED_PATH_FRAGMENTS)})"
    )


def host_listed(u: str, hosts=vocab.DEFAULT_DENY_HOSTS) -> str:
    listed = f"list_filter([{', '.join(map(q, hosts))}], lambda d: {host(u)} = d OR ends_with({host(u)}, '.' || d))"
    return f"(len({listed}) > 0)"


def denied(u: str) -> str:
    return f"({rule_denied(u)} OR {host_listed(u)})"


def to_root(u: str) -> str:
    first = f"split_part(trim(lower({path(u)}), '/'), '/', 1)"
    return (
        f"CASE WHEN {first} IN {values(vocab.CONTENT_PATH_SEGMENTS)} THEN "
        f"{scheme(u)} || '://' || {netloc(u)} || '/' ELSE {u} END"
    )


def depth(u: str) -> str:
    p = f"trim({path(u)}, '/')"
    return f"CASE WHEN {p} = '' THEN 0 ELSE len(string_split({p}, '/')) END"


# -- HTML ---------------------------------------------------------------------

_ATTRS = """(?:[^'">]+|"[^"]*"|'[^']*')*>"""


def _hidden(html: str) -> str:
    pattern = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    return f"regexp_replace({html}, {q(pattern)}, chr(1), 'g')"


def entities(t: str) -> str:
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
                       ("&middot;", "·"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, {q(name)}, {q(char)})"
    return t


def _nodes(markup: str, dropped: str) -> str:
    """Split in text nodes, trim each, drop empty ones, join by a blank."""
    pattern = rf"(?is){dropped}<[!?/a-z]{_ATTRS}"
    cut = f"regexp_replace({markup}, {q(pattern)}, chr(1), 'g')"
    node = "regexp_replace(n, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split({entities(cut)}, chr(1)), "
        f"lambda n: {node}), lambda n: n <> ''), ' ')"
    )


def visible_text(html: str) -> str:
    return _nodes(_hidden(html), r"<noscript\b[^>]*>.*?</noscript\s*>|")


def strict_text(html: str) -> str:
    return _nodes(
        _hidden(html),
        "".join(rf"<{e}\b[^>]*>.*?</{e}\s*>|" for e in ("noscript", "svg", "head")),
    )


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def links(html: str) -> str:
    tags = f"regexp_extract_all({_hidden(html)}, {q(f'(?is)<a[ ]{_ATTRS}')}, 0)"
    href = f"""trim({entities("regexp_extract(t, '(?i)[ ]href=\"([^\"]*)\"', 1)")})"""
    return f"list_filter(list_transform({tags}, lambda t: {href}), lambda t: t <> '')"


def contact_links(html: str) -> str:
    """Markup of the derived pages: double-quoted targets."""
    anchors = f"regexp_extract_all({_hidden(html)}, {q(r'(?is)<a[ ][^>]*>.*?</a>')}, 0)"
    words = "|".join(vocab.CONTACT_ANCHOR_TEXTS)
    text = "regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g')"
    hit = f"regexp_matches({text}, {q(rf'(?i)\b(?:{words})\b')})"
    href = "regexp_extract(a, '(?i)[ ]href=\"([^\"]*)\"', 1)"
    return (
        f"list_filter(list_transform(list_filter({anchors}, lambda a: {hit}), lambda a: {href}), "
        f"lambda h: h <> '' AND NOT regexp_matches(h, '^(mailto:|tel:|#|javascript:)') "
        f"AND (starts_with(h, '/') OR {netloc('h')} = ''))"
    )


def name(html: str, url: str) -> str:
    og = f"trim({entities(f'''regexp_extract({html}, '(?is)property=\"og:site_name\" content=\"([^\"]*)\"', 1)''')})"
    title = f"trim({entities(f'''regexp_extract({html}, '(?is)<title>(.*?)</title>', 1)''')})"
    label = f"split_part(regexp_replace({netloc(url)}, '^www\\.', ''), '.', 1)"
    return (
        f"coalesce(nullif(left({og}, 200), ''), nullif(left({title}, 200), ''), "
        f"CASE WHEN {url} <> '' THEN upper(left({label}, 1)) || lower(substr({label}, 2)) END, 'Unknown')"
    )


def contactable(text: str) -> str:
    return any_of(f"left(lower({text}), 20000)", vocab.CONTACTABLE_PHRASES)


# -- contacts -----------------------------------------------------------------

EMAIL = r"(?i)[\pL\pN_.+-]+@[\pL\pN_-]+\.(?:" + "|".join(vocab.EMAIL_TLDS) + r")\b"
OBFUSCATED = (
    r"(?i)[\pL\pN_.+-]+\s*\[?\(?\s*(?:at|@)\s*\)?\]?\s*[\pL\pN_-]+\s*\[?\(?\s*dot\s*\)?\]?\s*(?:"
    + "|".join(vocab.OBFUSCATED_TLDS) + r")\b"
)
PHONE = (
    r"(?:(?:\+?[0-9]{1,3}[\s\x{00a0}.-]?)?\([0-9]{2,4}\)[\s\x{00a0}.-]?[0-9]{3}[\s\x{00a0}.-]?[0-9]{4}"
    r"|(?:\+?[0-9]{1,3}[\s\x{00a0}.-]?)?[0-9]{2,4}[\s\x{00a0}.-]?[0-9]{3,4}[\s\x{00a0}.-]?[0-9]{3,4})"
)
AT_HANDLE = r"(?i)(?:^|[^\pL\pN_])@([a-zA-Z0-9_][a-zA-Z0-9_.]{1,29})"
IG_LINK = r"(?i)(?:https?://)?(?:www\.)?instagram\.com/([a-zA-Z0-9_.]{1,30})"
LINKEDIN = r"(?i)https?://(?:www\.)?linkedin\.com/(?:company|in|school)/[a-zA-Z0-9\-_./%]+"
WHATSAPP = r"""(?i)(?:wa\.me/(?:widget/)?|api\.whatsapp\.com/send[^"']*?phone=)([0-9]{7,15})"""


def matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def uniq(lst: str) -> str:
    return f"list_sort(list_distinct({lst}))"


def clean_email(e: str) -> str:
    return f"lower(replace(trim(trim({e}), {q('.,;:<>' + chr(39) + chr(34))}), ' ', ''))"


def valid_email(e: str) -> str:
    domain = f"lower(regexp_extract({e}, '[^@]*$', 0))"
    shape = f"regexp_matches({e}, '^[^@]+@[^.]*[.]')"
    return (
        f"((NOT contains({e}, '@') OR ({shape} AND {domain} NOT IN {values(vocab.NOISE_EMAIL_DOMAINS)} "
        f"AND {domain} <> 'gov.in' AND NOT {ends(domain, vocab.DENIED_EMAIL_SUFFIXES)})) AND length({e}) <= 254)"
    )


def plain_emails(text: str) -> str:
    found = f"list_transform({matches(text, EMAIL)}, lambda m: {clean_email('m')})"
    return uniq(f"list_filter({found}, lambda e: {valid_email('e')})")


def obfuscated_emails(text: str) -> str:
    m = "lower(m)"
    for old, new in vocab.OBFUSCATION_STEPS:
        m = f"replace({m}, {q(old)}, {q(new)})"
    found = f"list_transform({matches(text, OBFUSCATED)}, lambda m: {m})"
    return uniq(f"list_filter({found}, lambda e: contains(e, '@') AND {valid_email('e')})")


def mailto_emails(lst: str) -> str:
    picked = f"list_filter({lst}, lambda x: starts_with(lower(x), 'mailto:'))"
    found = f"list_transform({picked}, lambda x: lower(trim(split_part(substr(x, 8), '?', 1))))"
    return uniq(f"list_filter({found}, lambda e: contains(e, '@') AND {valid_email('e')})")


def mailto_html(html: str) -> str:
    pattern = r"""(?i)href\s*=\s*["']mailto:([^"'>\s]+)"""
    found = f"list_transform({matches(html, pattern, 1)}, lambda x: split_part(lower(trim(x)), '?', 1))"
    return uniq(f"list_filter({found}, lambda e: regexp_matches(e, '@[^@]*[.][^@]*$'))")


def cloudflare(h: str) -> str:
    """Decode one hex text; NULL when it hides no address."""
    byte = "CAST(('0x' || substr({h}, CAST({i} AS BIGINT), 2)) AS INTEGER)"
    key = byte.format(h=h, i=1)
    chars = (
        f"list_transform(range(3, length({h}), 2), lambda i: chr(xor({byte.format(h=h, i='i')}, {key})))"
    )
    plain = f"trim(array_to_string({chars}, ''))"
    ok = f"length({h}) >= 4 AND length({h}) % 2 = 0 AND regexp_matches({h}, '^[0-9a-fA-F]+$')"
    return f"CASE WHEN {ok} THEN nullif(regexp_extract({plain}, '^.*@[^@]*[.][^@]*$', 0), '') END"


def cloudflare_emails(html: str) -> str:
    pattern = 'data-cfemail="([0-9a-fA-F]+)"'
    decoded = f"list_transform({matches(html, pattern, 1)}, lambda h: {cloudflare('h')})"
    cleaned = f"list_transform(list_filter({decoded}, lambda e: e IS NOT NULL), lambda e: {clean_email('e')})"
    return uniq(f"list_filter({cleaned}, lambda e: {valid_email('e')})")


def encoded_emails(html: str) -> str:
    found = matches(html, "(?i)[A-Za-z0-9._%+-]+%40[A-Za-z0-9._%-]+")
    cleaned = f"list_transform({found}, lambda m: {clean_email('url_decode(m)')})"
    return uniq(f"list_filter({cleaned}, lambda e: contains(e, '@') AND {valid_email('e')})")


def html_emails(html: str) -> str:
    return uniq(f"list_concat({cloudflare_emails(html)}, {encoded_emails(html)})")


def whatsapp(lst: str, text: str) -> str:
    found = f"flatten(list_transform(list_append({lst}, {text}), lambda s: {matches('s', WHATSAPP, 1)}))"
    return uniq(f"list_filter({found}, lambda d: length(d) BETWEEN 10 AND 15)")


def plausible(d: str) -> str:
    return (
        f"CASE WHEN length({d}) = 10 THEN true WHEN length({d}) = 11 THEN left({d}, 1) IN ('1', '7') "
        f"WHEN length({d}) BETWEEN 12 AND 15 THEN left({d}, 2) IN {values(vocab.CALLING_CODES_2)} "
        f"OR left({d}, 3) IN {values(vocab.CALLING_CODES_3)} OR (length({d}) = 12 AND left({d}, 1) = '1') "
        f"ELSE false END"
    )


def phones_kept(lst: str) -> str:
    return (
        f"list_sort(list_filter({lst}, lambda x: len(list_filter({lst}, "
        f"lambda y: length(y) > length(x) AND contains(y, x))) = 0))"
    )


def phones(text: str) -> str:
    digits = f"list_transform({matches(text, PHONE)}, lambda m: regexp_replace(m, '[^0-9]', '', 'g'))"
    real = (
        f"list_distinct(list_filter({digits}, lambda d: {plausible('d')} "
        f"AND (length(d) - length(replace(d, '0', ''))) * 2 <= length(d) "
        f"AND len(list_distinct(string_split(d, ''))) > 2 AND NOT starts_with(d, '00')))"
    )
    return phones_kept(real)


def valid_handle(h: str) -> str:
    low = f"lower({h})"
    return (
        f"(length({low}) BETWEEN 2 AND 30 AND {low} NOT IN {values(vocab.INSTAGRAM_SKIP_HANDLES)} "
        f"AND regexp_full_match({low}, '[a-z0-9_.]+') AND NOT regexp_full_match({low}, '[0-9.]+') "
        f"AND NOT starts_with({low}, '.') AND NOT ends_with({low}, '.') "
        f"AND NOT regexp_matches({low}, {q(vocab.FILE_LIKE_HANDLE_PATTERN)}))"
    )


def instagram(lst: str, text: str) -> str:
    linked = f"flatten(list_transform({lst}, lambda s: {matches('s', IG_LINK, 1)}))"
    linked = (
        f"list_filter(list_transform({linked}, lambda h: trim(h, '.')), "
        f"lambda h: lower(h) NOT IN {values(vocab.INSTAGRAM_SKIP_PATHS)})"
    )
    said = f"list_transform({matches(text, AT_HANDLE, 1)}, lambda h: trim(h, '.'))"
    return uniq(f"list_filter(list_concat({linked}, {said}), lambda h: {valid_handle('h')})")


def linkedin(lst: str, text: str) -> str:
    found = f"flatten(list_transform(list_append({lst}, {text}), lambda s: {matches('s', LINKEDIN)}))"
    u = f"rtrim(u, {q('.,;:)' + chr(39) + chr(34))})"
    u = f"rtrim(regexp_replace(regexp_replace({u}, '^http://', 'https://'), '^https://www\\.linkedin', 'https://linkedin'), '/')"
    return uniq(f"list_transform({found}, lambda u: {u})")


# -- niches and gate ----------------------------------------------------------


def by_niche(niche: str, value, default: str) -> str:
    return (
        f"CASE {niche} "
        + " ".join(f"WHEN {q(n.id)} THEN {value(n)}" for n in vocab.NICHES)
        + f" ELSE {default} END"
    )


def in_scope(low: str, niche: str) -> str:
    return by_niche(niche, lambda n: any_of(low, n.scope_keywords), "false")


def excluded(low: str, niche: str) -> str:
    return by_niche(niche, lambda n: any_of(low, n.exclusion_keywords), "false")


def reason(low: str, niche: str, scope: bool = True, corporate: bool = True) -> str:
    tests = [("scope", f"NOT {in_scope(low, niche)}")] if scope else []
    tests.append(("exclusion", excluded(low, niche)))
    if corporate:
        tests.append(("corporate", any_of(low, vocab.CORPORATE_PHRASES)))
    tests += [
        ("education", any_of(low, vocab.EDUCATION_PHRASES)),
        ("portal", any_of(low, vocab.PORTAL_PHRASES)),
        ("reference", any_of(low, vocab.REFERENCE_PHRASES)),
        ("provider", any_of(low, vocab.PROVIDER_PHRASES)),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN {q(n)}" for n, t in tests) + " END"


# -- leads (lists held as joined text) ----------------------------------------


def n_items(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' | ')) END)"


def score_of(n: dict[str, str]) -> str:
    e, w, i, li, p = (n[c] for c in vocab.CONTACT_LISTS)
    return (
        f"least(100, least({e}, 5) * 12 + least({w}, 3) * 8 + least({i}, 3) * 5 + least({li}, 3) * 4 "
        f"+ least({p}, 3) * 2 + CASE WHEN {e} > 0 THEN 5 ELSE 0 END + CASE WHEN {w} > 0 THEN 5 ELSE 0 END)"
    )


def score() -> str:
    return score_of({c: n_items(c) for c in vocab.CONTACT_LISTS})


def label(s: str) -> str:
    return f"CASE WHEN {s} >= 60 THEN 'high' WHEN {s} >= 30 THEN 'medium' ELSE 'low' END"


def count() -> str:
    return "(" + " + ".join(n_items(c) for c in vocab.CONTACT_LISTS) + ")"


def provider_name(n: str) -> str:
    return any_of(f"lower({n})", vocab.PROVIDER_NAME_PHRASES)


def brand_name(n: str) -> str:
    return any_of(f"lower({n})", vocab.BRAND_NAME_PHRASES)

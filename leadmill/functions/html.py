"""HTML column functions.

A page is read in two regex passes: one drops comments, scripts and styles,
one turns the remaining markup into separators.  Everything stays inside the
JVM; there is no parse tree and no Python worker.  Tags are matched with
quoted attributes kept whole, so ``>`` inside an attribute does not end a tag.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions import vocab
from leadmill.functions.text import bind, blank_to_null, col, contains_any, trim_ws
from leadmill.functions.urls import netloc_of

# Inside of a tag up to its ">"; possessive, so long tags need no stack.
_ATTRS = r"""(?:[^'">]+|"[^"]*"|'[^']*')*+>"""
_COMMENT = r"<!--.*?(?:-->|\z)"
_TAG = rf"<[!?/a-z](?:{_ATTRS}|[^>]*>)"
_BREAK = "\u0001"


def _element(name: str) -> str:
    return rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)"


HIDDEN_PATTERN = "(?is)" + "|".join([_COMMENT, _element("script"), _element("style")])
MARKUP_PATTERN = "(?is)" + "|".join([_element("noscript"), _TAG])
STRICT_MARKUP_PATTERN = "(?is)" + "|".join(
    [_element("noscript"), _element("svg"), _element("head"), _TAG]
)
ANCHOR_TAG_PATTERN = rf"(?is)<a\s{_ATTRS}"
# An anchor ends at its end tag or where the next one starts, so no text is read twice.
ANCHOR_PATTERN = rf"(?is)<a\s{_ATTRS}(?:(?!<a\s|</a\s*>).)*+"
HREF_PATTERN = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
OG_TAG_PATTERN = r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:site_name\b[^>]*>"""
CONTENT_PATTERN = r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TITLE_PATTERN = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
CONTACT_ANCHOR_PATTERN = rf"(?iU)\b(?:{'|'.join(vocab.CONTACT_ANCHOR_TEXTS)})\b"

# Entities seen on nearly every page; the full table is only consulted when a
# page holds another one.
_COMMON_ENTITIES = (
    ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"),
)




def _code_point(n: Column) -> Column:
    ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    packed = F.unhex(F.lpad(F.hex(n), 8, "0"))
    return F.when(ok, F.decode(packed, "UTF-32"))


def _all_entities(text: Column) -> Column:
    # One constant the optimizer folds; a map built entry by entry would cost
    # hundreds of calls to the JVM for every use.
    table = "\u0002".join(f"{name}\u0001{chr(cp)}" for name, cp in name2codepoint.items())
    names = F.str_to_map(F.lit(table), F.lit("\u0002"), F.lit("\u0001"))
    pieces = F.split(text, "&")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(
            piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1
        )
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)$", 1)
        number = F.when(
            F.rlike(name, F.lit("^#[xX]")), F.conv(digits, 16, 10)
        ).otherwise(F.conv(digits, 10, 10))
        found = F.when(
            F.startswith(name, F.lit("#")), _code_point(number.cast("bigint"))
        ).when(name != "", F.try_element_at(names, name))
        after = F.substr(piece, F.length(name) + 2)
        return F.coalesce(F.concat(found, after), F.concat(F.lit("&"), piece))

    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


def _decode(text: Column) -> Column:
    for entity, char in _COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))

    def rest(common: Column) -> Column:
        rare = F.rlike(common, F.lit("&(?!amp;)(?:#[0-9xX]|[A-Za-z])[0-9A-Za-z]*;"))
        return F.when(rare, _all_entities(common)).otherwise(
            F.replace(common, F.lit("&amp;"), F.lit("&"))
        )

    return bind(text, rest)


def decode_entities(c: Column | str) -> Column:
    return bind(
        col(c), lambda t: F.when(F.contains(t, F.lit("&")), _decode(t)).otherwise(t)
    )


def drop_hidden(html: Column | str) -> Column:
    """Remove comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(col(html), F.lit("")), HIDDEN_PATTERN, _BREAK)


def _node_text(markup: Column, pattern: str) -> Column:
    # Every run of markup with the blanks around it becomes one blank: the
    # text nodes end up trimmed, non-empty and joined by one space.
    text = decode_entities(F.regexp_replace(markup, pattern, _BREAK))
    text = F.regexp_replace(text, rf"(?U)\s*{_BREAK}[\s{_BREAK}]*", " ")
    return trim_ws(text)


def visible_text(html: Column | str, hidden_dropped: bool = False) -> Column:
    """Text nodes joined by one space; the title counts, scripts do not."""
    markup = col(html) if hidden_dropped else drop_hidden(html)
    return _node_text(markup, MARKUP_PATTERN)


def strict_text(html: Column | str) -> Column:
    """`visible_text` without the head and drawings."""
    return _node_text(drop_hidden(html), STRICT_MARKUP_PATTERN)


def _attr_value(value: Column) -> Column:
    return trim_ws(decode_entities(F.btrim(value, F.lit("\"'"))))


def first_href(tag: Column) -> Column:
    """Target of the anchor a piece of markup starts with; '' if none."""
    return _attr_value(F.regexp_extract(tag, HREF_PATTERN, 1))


def page_links(html: Column | str, hidden_dropped: bool = False) -> Column:
    """Distinct anchor targets in page order."""
    markup = col(html) if hidden_dropped else drop_hidden(html)
    tags = F.regexp_extract_all(markup, F.lit(ANCHOR_TAG_PATTERN), F.lit(0))
    return F.filter(F.array_distinct(F.transform(tags, first_href)), lambda x: x != "")


def contact_links(html: Column | str, hidden_dropped: bool = False) -> Column:
    """Same-site links whose text announces a contact, about or team page."""
    markup = col(html) if hidden_dropped else drop_hidden(html)
    anchors = F.regexp_extract_all(markup, F.lit(ANCHOR_PATTERN), F.lit(0))
    hits = F.filter(
        anchors,
        lambda a: F.rlike(_node_text(a, MARKUP_PATTERN), F.lit(CONTACT_ANCHOR_PATTERN)),
    )

    def same_site(href: Column) -> Column:
        outside = F.rlike(href, F.lit("^(?:mailto:|tel:|#|javascript:)"))
        relative = F.startswith(href, F.lit("/")) | (netloc_of(href) == "")
        return (href != "") & ~outside & relative

    return F.filter(F.array_distinct(F.transform(hits, first_href)), same_site)


def _title_case(word: Column) -> Column:
    runs = F.regexp_extract_all(word, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def business_name(
    html: Column | str, url: Column | str, hidden_dropped: bool = False, max_chars: int | None = 200
) -> Column:
    """Site name from the page head, else its title, else its host; *max_chars* of it."""
    def cut(text: Column) -> Column:
        return text if max_chars is None else F.substring(text, 1, max_chars)

    markup = col(html) if hidden_dropped else drop_hidden(html)
    og_tag = F.regexp_extract(markup, OG_TAG_PATTERN, 0)
    og = _attr_value(F.regexp_extract(og_tag, CONTENT_PATTERN, 1))
    title = trim_ws(decode_entities(F.regexp_extract(markup, TITLE_PATTERN, 1)))
    label = F.split_part(
        F.regexp_replace(netloc_of(url), "^www\\.", ""), F.lit("."), F.lit(1)
    )
    return F.coalesce(
        blank_to_null(cut(og)),
        blank_to_null(cut(title)),
        F.when(F.coalesce(col(url), F.lit("")) != "", _title_case(label)),
        F.lit("Unknown"),
    )


def _hint(text: Column | str, phrases, window: int | None) -> Column:
    lowered = F.lower(col(text))
    return contains_any(lowered if window is None else F.substring(lowered, 1, window), phrases)


def looks_contactable(text: Column | str, window: int | None = None) -> Column:
    """The text, or its first *window* characters, mentions a way to get in touch."""
    return _hint(text, vocab.CONTACTABLE_PHRASES, window)


def is_challenge_page(text: Column | str, window: int | None = None) -> Column:
    """A capture that is empty or shows a bot check instead of content."""
    text = F.coalesce(col(text), F.lit(""))
    return (text == "") | _hint(text, vocab.CHALLENGE_PHRASES, window)


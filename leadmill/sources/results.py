"""Stored search-result captures -> ``rank, url, title`` rows.

Each engine is a row of data: inside which element its results stand, how a
result block starts, which anchors to try and how its links are wrapped.  One
pass marks block starts, the capture is cut there, each piece ends where its
element ends, and the anchor is taken from that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import html, urls
from leadmill.functions.text import bind, blank_to_null, trim_ws
from leadmill.operators.merge import first_per_key


def _classed(tag: str, name: str) -> str:
    """Start tag with *name* among its classes."""
    return rf"""<{tag}\b[^>]*?\sclass\s*=\s*["'](?:[^"'>]*\s)?{name}(?:\s[^"'>]*)?["'][^>]*>"""


def _anchor(start: str) -> str:
    return rf"(?is){start}.*?</a\s*>"


def _inside(heading: str) -> str:
    """First anchor of a heading element."""
    return rf"(?is)<{heading}\b[^>]*>(?:(?!</{heading}).)*?(<a\s[^>]*>.*?</a\s*>)"


@dataclass(frozen=True)
class EngineMarkup:
    """How one engine marks up its results."""

    engine: str
    block: str
    anchors: tuple[tuple[str, int], ...]  # (pattern, group), first match wins
    unwrap: str | None = None
    snippet: str | None = None
    scope: str | None = None  # start of the element that holds the results


_ANY = "[a-z][a-z0-9]*"
_HTTP_ANCHOR = r"""<a\s(?:[^>]*?\s)?href\s*=\s*["']http[^>]*>"""

# Result markup of the engines.
ENGINES = (
    EngineMarkup(
        "ddg", _classed(_ANY, "result"), ((_anchor(_classed("a", "result__a")), 0),), "ddg",
        snippet=rf"(?is){_classed(_ANY, 'result__snippet')}(.*?)</(?:a|div|span|td)\s*>",
    ),
    EngineMarkup(
        "mojeek", rf"(?:<li\b[^>]*>|{_classed(_ANY, 'result')})",
        ((_inside("h2"), 1), (_anchor(_classed("a", "ob")), 0), (_anchor(_classed("a", "title")), 0)),
        scope=_classed(_ANY, "results-standard"),
    ),
    EngineMarkup("bing", _classed("li", "b_algo"), ((_inside("h2"), 1),), "bing"),
    EngineMarkup(
        "brave", _classed(_ANY, "snippet"),
        ((_anchor(_classed("a", "snippet-title")), 0), (_anchor(_HTTP_ANCHOR), 0)),
    ),
    EngineMarkup(
        "ecosia", _classed(_ANY, "result"),
        ((_anchor(rf"(?:{_classed('a', 'result__link')}|{_HTTP_ANCHOR})"), 0),), "ecosia",
    ),
    EngineMarkup(
        "searx", _classed("article", "result"),
        ((_inside("h3"), 1), (_anchor(_classed("a", "url_header")), 0)), "searx",
    ),
)
_CUT = "\u0002"


def element(markup: Column) -> Column:
    """The element that *markup* starts with, to its own end tag.

    Counts start and end tags of its name; an element that is never closed runs
    to the end of the text.
    """

    def ended(name: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            low = F.lower(F.substring(x, 1, 40))
            opens = F.regexp_extract(low, r"^<([a-z][a-z0-9]*)", 1) == name
            closes = F.regexp_extract(low, r"^</([a-z][a-z0-9]*)", 1) == name
            depth = s["depth"] + opens.cast("int") - closes.cast("int")
            return F.when(s["depth"] == 0, s).otherwise(
                F.struct(depth.alias("depth"), (s["kept"] + (depth > 0).cast("int")).alias("kept"))
            )

        def inside(parts: Column) -> Column:
            rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
            first = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("kept"))
            kept = F.aggregate(rest, first, step)["kept"]
            return F.array_join(F.slice(parts, F.lit(1), kept), "")

        return bind(F.split(markup, "(?=<)"), inside)

    return bind(F.lower(F.regexp_extract(markup, r"^<([A-Za-z][A-Za-z0-9]*)", 1)), ended)


def _blocks(rule: EngineMarkup, page: Column) -> Column:
    if rule.scope:
        scoped = F.regexp_extract(page, rf"(?is){rule.scope}.*", 0)
        page = F.when(scoped == "", scoped).otherwise(element(scoped))
    marked = F.regexp_replace(page, rf"(?is)({rule.block})", f"{_CUT}$1")
    pieces = F.split(marked, _CUT)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), element)


def _result(rule: EngineMarkup, block: Column) -> Column:
    first = F.coalesce(
        *[blank_to_null(F.regexp_extract(block, p, g)) for p, g in rule.anchors], F.lit("")
    )

    def read(anchor: Column) -> Column:
        title = html.visible_text(anchor, hidden_dropped=True)
        if rule.snippet:
            said = html.visible_text(F.regexp_extract(block, rule.snippet, 1), hidden_dropped=True)
            title = bind(title, lambda t: F.coalesce(blank_to_null(t), said))
        url = html.first_href(anchor)
        if rule.unwrap:
            url = bind(url, urls.UNWRAP[rule.unwrap])
        return F.struct(url.alias("url"), title.alias("title"))

    return bind(first, read)


def html_results(captures: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Organic results of stored HTML captures, one row each.

    *captures*: *keys*, ``engine`` and ``html``.  Challenge pages give nothing.
    """
    page = F.when(~html.is_challenge_page("html"), html.drop_hidden("html"))
    marked = captures.withColumn("_page", page)
    found = None
    for rule in ENGINES:
        one = F.transform(_blocks(rule, F.col("_page")), partial(_result, rule))
        test = F.col("engine") == rule.engine
        found = F.when(test, one) if found is None else found.when(test, one)
    rows = marked.select(*keys, "engine", F.posexplode_outer(found).alias("rank", "r"))
    return _organic(rows.select(*keys, "engine", "rank", "r.url", "r.title"), [*keys, "engine"], limit)


def _organic(rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """Keep http results, the first of each URL.

    The results were exploded with the outer form: the plain one makes the
    optimizer test the array for emptiness first and so build it twice.
    """
    kept = first_per_key(rows.filter(F.startswith("url", F.lit("http"))), [*keys, "url"], ["rank"])
    if limit is None:
        return kept
    from leadmill.operators.rank import first_results

    return first_results(kept, keys, limit)


def json_results(captures: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Results of a paid search API: ``organic_results[].link/title``."""
    doc = F.from_json(
        F.col(body), "organic_results array<struct<link:string,title:string>>"
    )
    rows = captures.select(*keys, F.posexplode_outer(doc["organic_results"]).alias("rank", "r"))
    clean = rows.select(
        *keys,
        "rank",
        trim_ws(F.coalesce("r.link", F.lit(""))).alias("url"),
        trim_ws(F.coalesce("r.title", F.lit(""))).alias("title"),
    )
    return _organic(clean, keys, None)


def rss_results(
    captures: DataFrame, keys: list[str], body: str = "body", limit: int | None = None
) -> DataFrame:
    """Results of an RSS capture: every ``item`` with its title and link.

    Empty captures and those that show a bot check have none; *limit* keeps the
    first so many distinct results of each key.
    """
    captures = captures.filter(~html.is_challenge_page(body))
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item\b[^>]*>.*?</item\s*>"), F.lit(0))
    rows = captures.select(*keys, F.posexplode_outer(items).alias("rank", "item"))
    parsed = rows.withColumn("r", F.from_xml("item", "title string, link string"))
    clean = parsed.select(
        *keys,
        "rank",
        trim_ws(F.coalesce("r.link", F.lit(""))).alias("url"),
        trim_ws(F.coalesce("r.title", F.lit(""))).alias("title"),
    )
    return _organic(clean, keys, limit)

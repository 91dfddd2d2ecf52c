"""From stored pages to one narrow row of facts per page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import contacts, html, phrases, vocab
from leadmill.functions.vocab import Niche
from leadmill.operators.reuse import built_once, computed_once


def with_text(pages: DataFrame) -> DataFrame:
    """Add ``text``, ``links`` and what else needs the markup, drop the markup."""
    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    marked = pages.select(
        "url",
        F.coalesce(final, F.col("url")).alias("final_url"),
        F.coalesce("html", F.lit("")).alias("html"),
        html.drop_hidden("html").alias("markup"),
    )
    return marked.select(*built_once("page text", None, _text_columns))


def _text_columns() -> list[Column]:
    return [
        F.col("url"),
        F.col("final_url"),
        (F.col("html") == "").alias("is_empty"),
        html.visible_text("markup", hidden_dropped=True).alias("text"),
        html.page_links("markup", hidden_dropped=True).alias("links"),
        html.contact_links("markup", hidden_dropped=True).alias("contact_links"),
        html.business_name("markup", "url", hidden_dropped=True).alias("business_name"),
        contacts.html_emails("html").alias("html_emails"),
        contacts.mailto_html_emails("html").alias("mailto_emails"),
    ]


def _fact_columns(niches: Sequence[Niche]) -> list[Column]:
    found = contacts.all_contacts("text", "links")
    lists = {k: v for k, v in found.items() if k != "emails"}
    return [
        *[F.col(c) for c in ("url", "final_url", "is_empty", "business_name", "contact_links")],
        html.looks_contactable("text").alias("is_contactable"),
        phrases.scope_ids("lowered", niches).alias("scope_ids"),
        phrases.excluded_ids("lowered", niches).alias("excluded_ids"),
        *[test("lowered").alias(f"is_{n}") for n, test in phrases.PAGE_FLAGS.items()],
        F.array_sort(F.array_union(found["emails"], "html_emails")).alias("emails"),
        *[c.alias(name) for name, c in lists.items()],
        F.col("mailto_emails"),
    ]


def page_facts(pages: DataFrame, niches: Sequence[Niche] = vocab.NICHES) -> DataFrame:
    """Everything later steps need from a page, without its text or markup.

    Pages are wide and read once; this row is a few hundred bytes.  All joins
    and shuffles downstream move these rows, never HTML.  Expected input:
    ``url, html`` and optionally ``final_url`` (after redirects).
    """
    lowered = with_text(pages).withColumn("lowered", F.lower("text"))
    columns = built_once("page facts", niches, lambda: _fact_columns(niches))
    return computed_once(lowered.select(*columns))

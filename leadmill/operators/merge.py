"""Dedupe and merge: first wins, richer wins, union of contact lists.

"Keep one row per key" is a ``max_by`` / ``min_by`` aggregate: every task
reduces its own rows first, so a key that holds a third of the table reaches
the shuffle as one row per task.  The order that decides ties is always an
explicit column; row position is never relied on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.functions import leads, urls, vocab
from leadmill.functions.text import empty_list

def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order (nulls form one key)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_n_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    n: int,
    pos: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first *n* rows of each key; *n* is the report size asked for.

    *pos* keeps the position in a column of that name.

    A key is cut in salted pieces first, so no task ever sorts a whole hot group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if pos:
        return top.withColumn("_rn", F.col("_rn").cast("bigint")).withColumnRenamed("_rn", pos)
    return top.drop("_rn")


# -- URLs ---------------------------------------------------------------------


def distinct_urls(results: DataFrame, within: list[str] | None = None, order=("rank",)) -> DataFrame:
    """First result per URL (inside the *within* columns), order kept."""
    return first_per_key(results, [*(within or []), "url"], list(order))


def cached_then_live(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Ordered union of two result tables of the same query, without repeats.

    ``source_rank`` 0 is the cache; both need ``query, rank, url, title``.
    """
    cols = ["query", "rank", "url", "title"]
    both = cached.select(*cols, F.lit(0).alias("source_rank")).unionByName(
        live.select(*cols, F.lit(1).alias("source_rank"))
    )
    return distinct_urls(both, ["query"], ["source_rank", "rank"])


# -- contact lists ------------------------------------------------------------

_ORIGIN = "email_origin"


def contact_values(df: DataFrame, key: str) -> DataFrame:
    """Long form: one row per distinct (site, kind, value).

    This is the form to keep for sites without a size bound.  Repeats collapse
    inside each task before anything is shuffled.
    """

    def tagged(c: str) -> Column:
        return F.transform(
            F.coalesce(F.col(c), empty_list()),
            lambda v: F.struct(F.lit(c).alias("kind"), v.alias("value")),
        )

    values = F.concat(*[tagged(c) for c in vocab.CONTACT_LISTS])
    # The outer form keeps the optimizer from building the values twice.
    return df.select(key, F.inline_outer(values)).filter("value IS NOT NULL").distinct()


def contact_counts(df: DataFrame, key: str) -> DataFrame:
    """Distinct contact points per site and kind, without building lists."""
    counts = [
        F.count_if(F.col("kind") == c).cast("int").alias(f"n_{c}") for c in vocab.CONTACT_LISTS
    ]
    return contact_values(df, key).groupBy(key).agg(*counts)


def origin_fold(origin: Column, has_emails: Column) -> Column:
    """Origin of a union of e-mail lists, as an aggregate expression."""
    inferred = F.bool_and(F.when(has_emails, origin == "inferred"))
    mixed = F.bool_or(F.when(has_emails, origin != "scraped"))
    return (
        F.when(inferred, F.lit("inferred")).when(mixed, F.lit("mixed")).otherwise(F.lit("scraped"))
    )


def merge_origins(df: DataFrame, key: str) -> DataFrame:
    has = leads.list_size("emails") > 0
    return df.groupBy(key).agg(origin_fold(F.col(_ORIGIN), has).alias(_ORIGIN))


def merge_contacts(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct union of the five lists per site, with the origin.

    The lists are made from the distinct long form, so the last step of a hot
    site handles its distinct values only.
    """
    lists = (
        contact_values(df, key)
        .groupBy(key)
        .agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("value")))).alias(c)
                for c in vocab.CONTACT_LISTS
            ]
        )
    )
    merged = merge_origins(df, key).join(lists, key, "left")
    return merged.select(
        key,
        *[F.coalesce(c, empty_list()).alias(c) for c in vocab.CONTACT_LISTS],
        _ORIGIN,
    )


# -- leads --------------------------------------------------------------------


def _keep(df: DataFrame, key: Column, order: Column, pick, place: Column | None = None) -> DataFrame:
    """One whole row per key; *place*, if given, is folded into ``first_seen``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    aggs = [pick("_row", order).alias("_row")]
    if place is not None:
        aggs.append(F.min(place).alias("first_seen"))
    kept = df.withColumn("_row", row).groupBy(key.alias("_key")).agg(*aggs)
    return kept.select("_row.*", *[a for a in ("first_seen",) if place is not None])


def dedupe_leads(df: DataFrame, key: str = "website", seq: str = "seq") -> DataFrame:
    """First lead per key; ``website`` compares by host, others by text.

    Leads without a value share the empty key.
    """
    value = urls.host_key(key) if key == "website" else F.lower(
        F.coalesce(F.col(key).cast("string"), F.lit(""))
    )
    return _keep(df, value, F.col(seq), F.min_by)


def place_of(df: DataFrame, seq: str = "seq") -> Column:
    """Row order as ``struct<file, row>``: tables number their rows, files
    also name the file the row stands in."""
    if df.schema[seq].dataType.typeName() == "struct":
        return F.col(seq)
    return F.struct(F.lit("").alias("file"), F.col(seq).cast("bigint").alias("row"))


def merge_leads(new: DataFrame, existing: DataFrame, seq: str = "seq") -> DataFrame:
    """Richer version per host wins, the later one on ties; no host, no lead.

    Existing leads count as earlier than new ones.  ``first_seen`` keeps the
    place the host first had, which orders leads of equal score.
    """
    old = existing.withColumns({"_src": F.lit(0), seq: place_of(existing, seq)})
    both = old.unionByName(new.withColumns({"_src": F.lit(1), seq: place_of(new, seq)}))
    both = both.filter(urls.host_key("website") != "")
    place = F.struct(F.col("_src"), F.col(seq))
    order = F.struct(leads.contact_count(), F.col("_src"), F.col(seq))
    return _keep(both, urls.host_key("website"), order, F.max_by, place).drop("_src")


def merge_lead_files(df: DataFrame, order: list[str]) -> DataFrame:
    """View over several lead files: richer wins, the older file on ties.

    *order* lists columns that put the newest file first (file rank, row).
    Leads without a website are keyed by their name.
    """
    name = F.coalesce(F.nullif("website", F.lit("")), "business_name")
    key = urls.host_key(name)
    place = F.struct(*order)
    kept = df.filter(key != "")
    rank = F.struct(leads.contact_count(), place)
    return _keep(kept, key, rank, F.max_by, place)


def best_first(df: DataFrame, *tie: str) -> DataFrame:
    """Score descending; equal scores keep the order of the *tie* columns."""
    return df.orderBy(F.desc("quality_score"), *tie)


def newest_best_first(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(F.desc("quality_score"), F.desc("scraped_at"), *tie)


def numbered(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Number the rows of a globally sorted table from 1.

    Every sorted partition numbers its own rows; only the row counts of the
    partitions, one small row each, are added up.
    """
    held = storage.materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(place, F.col("_before") + within + 1).drop("_part", "_before", "_id")
    )


def with_quality(df: DataFrame) -> DataFrame:
    """Add the derived score and label (always recomputed)."""
    scored = df.withColumn("quality_score", leads.score())
    return scored.withColumn("quality_label", leads.label("quality_score"))


def union_niches(*parts: DataFrame) -> DataFrame:
    """Leads of several niche runs, one per host; the earlier niche wins.

    Each part carries ``niche_pos`` and ``seq``.
    """
    whole = reduce(DataFrame.unionByName, parts)
    return _keep(whole, urls.host_key("website"), F.struct("niche_pos", "seq"), F.min_by)

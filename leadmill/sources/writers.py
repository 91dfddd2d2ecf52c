"""Lead exports and the search-cache table.

Every write goes to a fresh folder and is swapped in when it is complete, so a
file that is being read is never overwritten and a failed job leaves the old
export in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.functions import leads, vocab
from leadmill.functions.text import empty_list, join_list
from leadmill.operators.merge import best_first, merge_leads, newest_best_first, with_quality
from leadmill.operators.views import purge
from leadmill.sources import keyed_log
from leadmill.sources.readers import read_leads

_BOM = "﻿"
DASHBOARD_COLUMNS = tuple(c for c in vocab.EXPORT_COLUMNS if c != "email_origin")


def _value(c: str) -> Column:
    if c in vocab.CONTACT_LISTS:
        return join_list(F.coalesce(c, empty_list())).alias(c)
    if c in ("website", "source_query"):
        return F.coalesce(c, F.lit("")).alias(c)
    return F.col(c)


def flat_rows(df: DataFrame) -> DataFrame:
    """The 13 export columns, lists joined, quality recomputed."""
    return with_quality(df).select(*[_value(c) for c in vocab.EXPORT_COLUMNS])


def dashboard_rows(df: DataFrame) -> DataFrame:
    """The 12 columns of the dashboard download; keeps the shown quality."""
    return df.select(*[_value(c) for c in DASHBOARD_COLUMNS])


def nested_row() -> Column:
    """One lead as the nested record of the JSON exports."""
    order = (
        "business_name", "niche", "website", *vocab.CONTACT_LISTS, "source_query",
        "quality_score", "quality_label", "email_origin", "scraped_at",
    )
    parts = []
    for c in order:
        if c in vocab.CONTACT_LISTS:
            parts.append(F.coalesce(c, empty_list()).alias(c))
        elif c in ("website", "source_query"):
            parts.append(F.coalesce(c, F.lit("")).alias(c))
        else:
            parts.append(F.col(c))
    return F.struct(*parts)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per lead, in a column ``value``."""
    return with_quality(df).select(
        F.to_json(nested_row(), {"ignoreNullFields": "false"}).alias("value")
    )


def envelope_header(df: DataFrame, now: Column | None = None) -> DataFrame:
    """``generated_at`` and ``lead_count`` of an export, one row."""
    stamp = leads.iso_now() if now is None else now
    return df.agg(F.count(F.lit(1)).alias("lead_count")).select(
        stamp.alias("generated_at"), "lead_count"
    )


def _tie(df: DataFrame) -> str:
    """Column that orders leads of equal score."""
    return "first_seen" if "first_seen" in df.columns else "seq"


def envelope_lines(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The JSON envelope as ordered lines: opening, leads, closing.

    Leads stay rows; no list of all leads is ever built.  The columns ``part``,
    ``by`` and ``place`` order the lines.  All leads but the first are written
    with a comma before them.
    """
    tie = _tie(df)
    place = df.schema[tie].dataType
    rows = with_quality(df).select(
        F.lit(1).alias("part"),
        (-F.col("quality_score")).alias("by"),
        F.col(tie).alias("place"),
        F.to_json(nested_row(), {"ignoreNullFields": "false"}).alias("value"),
    )

    def frame(source: DataFrame, part: int, value: Column) -> DataFrame:
        return source.select(
            F.lit(part).alias("part"), F.lit(None).cast("int").alias("by"),
            F.lit(None).cast(place).alias("place"), value.alias("value"),
        )

    opening = F.concat(
        F.lit('{"generated_at": "'), "generated_at", F.lit('", "lead_count": '),
        F.col("lead_count").cast("string"), F.lit(', "leads": ['),
    )
    first = rows.agg(F.min(F.struct("by", "place"))).scalar()
    comma = F.when(F.struct("by", "place") > first, F.lit(",")).otherwise(F.lit(""))
    rows = rows.withColumn("value", F.concat(comma, "value"))
    head = frame(envelope_header(df, now), 0, opening)
    last = frame(df.sparkSession.range(1), 2, F.lit("]}"))
    return head.unionByName(rows).unionByName(last)


def _staged(df: DataFrame, path: str, write) -> None:
    spark = df.sparkSession
    staged = f"{path}.staged-{storage.new_path(spark, 'x').rsplit('-', 1)[1]}"
    write(staged)
    storage.swap_in(spark, staged, path)


def write_csv(flat: DataFrame, path: str, single_file: bool = False) -> None:
    """Write already flat, already ordered rows as CSV with a UTF-8 BOM.

    The result is a folder of ordered part files.  *single_file* asks for one
    part, written by one task; only for exports meant for a spreadsheet.
    """
    first = flat.columns[0]
    out = flat.withColumnRenamed(first, _BOM + first)
    if single_file:
        out = out.coalesce(1)
    _staged(
        out,
        path,
        lambda p: out.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(p),
    )


def write_json(
    df: DataFrame, path: str, now: Column | None = None, single_file: bool = False, envelope: bool = False
) -> None:
    """JSON lines and a header beside them; *envelope* writes one JSON document.

    The document is a folder of ordered part files, one lead per line, that give
    the text one after the other in the order of their names.  *single_file* asks
    for one part, written by one task.
    """
    if envelope or single_file:
        text = envelope_lines(df, now).orderBy("part", "by", "place").select("value")
        if single_file:
            text = text.coalesce(1)
        _staged(text, path, lambda p: text.write.text(p))
        return
    ordered = best_first(with_quality(df), _tie(df))
    rows = ordered.select(nested_row().alias("lead")).select("lead.*")
    _staged(rows, path, lambda p: rows.write.json(p))
    header = envelope_header(df, now)
    _staged(header, path + ".header", lambda p: header.coalesce(1).write.json(p))


def merged_export(
    new: DataFrame,
    existing: DataFrame | None,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
) -> DataFrame:
    """What an export holds: purge the old, merge, purge again."""
    if existing is None:
        return purge(new, deny_hosts)
    return purge(merge_leads(new, purge(existing, deny_hosts)), deny_hosts)


def export_leads(
    new: DataFrame,
    path: str,
    merge: bool = True,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
    single_file: bool = False,
    now: Column | None = None,
) -> None:
    """Write leads, by default merged into what *path* already holds.

    The format follows the file name: ``.json`` or CSV.
    """
    spark = new.sparkSession
    existing = read_leads(spark, path, now) if merge and storage.exists(spark, path) else None
    whole = merged_export(new, existing, deny_hosts)
    if path.lower().endswith(".json"):
        write_json(whole, path, now, single_file, envelope=True)
    elif path.lower().endswith(".jsonl"):
        write_json(whole, path, now)
    else:
        ordered = best_first(with_quality(whole), _tie(whole))
        write_csv(ordered.select(*[_value(c) for c in vocab.EXPORT_COLUMNS]), path, single_file)


def export_dashboard(view: DataFrame, path: str, *tie: str, single_file: bool = False) -> None:
    write_csv(dashboard_rows(newest_best_first(view, *tie)), path, single_file)


# -- search cache -------------------------------------------------------------


def cache_key(query: Column | str) -> Column:
    """Name of a query's cache entry: 16 hex digits of its SHA-256."""
    return F.substring(F.sha2(F.col(query) if isinstance(query, str) else query, 256), 1, 16)


def _last_documents(docs: DataFrame) -> DataFrame:
    """One document per query: the one fetched last."""
    keyed = docs.select(cache_key("query").alias("query_key"), "query", "fetched_at", "urls")
    last = F.max(F.struct("fetched_at", "query", "urls"))
    return keyed.groupBy("query_key").agg(last.alias("last")).select(
        "query_key", "last.query", "last.fetched_at", "last.urls"
    )


def log_cache(
    spark: SparkSession, docs: DataFrame, path: str, max_pieces: int = keyed_log.MAX_PIECES
) -> None:
    """Replace the entries of the queries in *docs* in a cache kept as a log.

    Writes these entries only, however large the cache is; ``read_cache_log`` reads it.
    Of several documents of a query the one fetched last is written; the document
    of a later call replaces that of an earlier one, as a file would be replaced.
    """
    earlier = keyed_log.last_commit(spark, path)
    number = 0 if earlier is None else earlier.number + 1
    changed = _last_documents(docs).withColumns({"_key": F.col("query_key"), "_gone": F.lit(False)})
    keyed_log.put(spark, path, number, changed, max_pieces=max_pieces)


def read_cache_log(spark: SparkSession, path: str) -> DataFrame:
    """``query_key, query, fetched_at, urls`` of a cache that ``log_cache`` wrote."""
    found = keyed_log.read(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return found


def upsert_cache(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Replace the entries of the queries in *docs*, keep all others.

    Of several documents of a query the one fetched last is written.  The folder
    is plain Parquet and is rewritten; ``log_cache`` is the form for a large cache.
    """
    new = _last_documents(docs)
    if storage.exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        new = new.unionByName(old.join(new.select("query_key"), "query_key", "left_anti"))
    _staged(new, path, lambda p: new.write.parquet(p))

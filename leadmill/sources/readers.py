"""Lead, seed, niche, cache and log scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill import storage
from leadmill.functions import leads, vocab
from leadmill.functions.text import split_list, trim_ws
from leadmill.functions.vocab import Niche
from leadmill.sources.schemas import LEAD, LEAD_COLUMNS, NICHE, empty_leads, file_place

_BOM = "﻿"


# -- small dimensions ---------------------------------------------------------


def niche_table(
    spark: SparkSession,
    ids: Sequence[str] | None = None,
    niches: Sequence[Niche] = vocab.NICHES,
) -> DataFrame:
    """The niche dimension; *ids* picks and orders, unknown ids are ignored."""
    by_id = {n.id: n for n in niches}
    chosen = [by_id[i] for i in ids if i in by_id] if ids else list(niches)
    rows = [
        (i, n.id, n.label, n.search_queries, n.scope_keywords, n.exclusion_keywords)
        for i, n in enumerate(chosen)
    ]
    return spark.createDataFrame(rows, NICHE)


def load_niches(
    ids: Sequence[str] | None = None, niches: Sequence[Niche] = vocab.NICHES
) -> list[Niche]:
    by_id = {n.id: n for n in niches}
    return [by_id[i] for i in ids if i in by_id] if ids else list(niches)


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A deny list, one host per line, as the table `drop_denied` takes."""
    lines = read_seeds(spark, path)
    return lines.select(F.col("url").alias("host")).distinct()


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """URL list, one per line; blanks and ``#`` comments dropped, order kept."""
    raw = spark.read.text(path).select(
        trim_ws(F.regexp_replace("value", f"^{_BOM}", "")).alias("url"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    keep = (F.col("url") != "") & ~F.startswith("url", F.lit("#"))
    return raw.filter(keep).select("url", F.struct("file", "start", "row").alias("seq"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their order key ``file, start, row``."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


# -- leads --------------------------------------------------------------------


def _text(c: str, default: str | None) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias(c)


def _defaults(df: DataFrame, now: Column | None) -> DataFrame:
    """What a missing value means."""
    stamp = F.coalesce(F.nullif("scraped_at", F.lit("")), leads.iso_now() if now is None else now)
    empty = F.array().cast("array<string>")
    return df.select(
        _text("business_name", "Unknown"),
        F.coalesce("niche", F.lit("")).alias("niche"),
        F.nullif("website", F.lit("")).alias("website"),
        *[F.coalesce(c, empty).alias(c) for c in vocab.CONTACT_LISTS],
        _text("source_query", None),
        _text("email_origin", "scraped"),
        stamp.alias("scraped_at"),
        "seq",
    )


def _csv_rows(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    """All columns of CSV files as text, found by name; absent ones are NULL.

    The header is read by name (no type inference), so column order is free.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv(paths)
    )
    place = file_place()
    have = {c.lstrip(_BOM): c for c in raw.columns}
    wanted = [*LEAD_COLUMNS, "quality_label", "quality_score"]
    cols = [
        F.col(f"`{have[c]}`").cast("string").alias(c)
        if c in have
        else F.lit(None).cast("string").alias(c)
        for c in wanted
    ]
    return raw.select(*cols, place.alias("seq"))


def read_lead_csv(
    spark: SparkSession, path: str, now: Column | None = None, multi_line: bool = True
) -> DataFrame:
    """An earlier CSV export.  *multi_line* allows line breaks inside quotes;
    turn it off for large exports without them, so files can be split."""
    rows = _csv_rows(spark, path, multi_line)
    split = {c: split_list(c) for c in vocab.CONTACT_LISTS}
    return _defaults(rows.withColumns(split | {"website": trim_ws("website")}), now)


# How `writers.envelope_lines` lays out a document: opening, leads, closing.
_OPENING = r'^\{"generated_at": "[^"\\\\]*", "lead_count": (\d+), "leads": \[$'
_CLOSING = "]}"


def _envelope_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Leads of a document (one file, or ordered parts) with one lead per line.

    None if the document is laid out in any other way or is not whole.  One pass
    checks that: one opening line at the start, one closing line at the end, and
    between them as many unbroken leads as announced, all but the first after a comma.
    """
    lines = spark.read.text(path).filter("value != ''").select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    count = F.regexp_extract("value", _OPENING, 1)
    is_lead = (count == "") & (F.col("value") != _CLOSING)
    schema = T.StructType([*LEAD.fields, T.StructField("_broken", T.StringType())])
    text = F.regexp_replace("value", r"^,(?=\{)", "")
    lead = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_broken"})
    place = F.struct("file", "start", "row")
    checked = lines.select(
        place.alias("place"), "value", count.alias("count"), is_lead.alias("is_lead"),
        F.startswith("value", F.lit(",")).alias("follows"),
        F.when(is_lead, ~text.rlike(r"^\{.*\}$") | lead["_broken"].isNotNull()).alias("broken"),
    )
    seen = checked.agg(
        F.count_if(F.col("count") != "").alias("openings"),
        F.count_if(F.col("value") == _CLOSING).alias("closings"),
        F.min_by("value", "place").alias("first"),
        F.max_by("value", "place").alias("last"),
        F.max("count").alias("announced"),
        F.count_if("is_lead").alias("leads"),
        F.count_if(F.col("is_lead") & ~F.col("follows")).alias("without_comma"),
        F.min_by("follows", F.when(F.col("is_lead"), F.col("place"))).alias("first_follows"),
        F.count_if("broken").alias("broken"),
    ).withColumn("opens", F.col("first").rlike(_OPENING)).first()
    whole = (
        seen.openings == seen.closings == 1 and seen.opens and seen.last == _CLOSING and not seen.broken
        and int(seen.announced) == seen.leads and seen.without_comma == min(seen.leads, 1)
        and not seen.first_follows
    )
    if not whole:
        return None
    return lines.filter(is_lead).select(lead.alias("lead"), "file", "row")


def read_lead_json(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """An earlier JSON export (envelope with ``leads``); stored scores are
    ignored.

    A document with a line per lead, as the writer makes it, is split and read by
    many tasks; any other is read whole, a task for each file.
    """
    rows = _envelope_lines(spark, path)
    if rows is None:
        schema = T.StructType([T.StructField("leads", T.ArrayType(LEAD))])
        docs = spark.read.schema(schema).option("multiLine", True).json(path)
        rows = docs.select(
            F.col("_metadata.file_path").alias("file"), F.posexplode("leads").alias("row", "lead")
        )
    columns = [F.col(f"lead.{c}").alias(c) for c in LEAD_COLUMNS]
    place = F.struct("file", F.col("row").cast("bigint").alias("row")).alias("seq")
    return _defaults(rows.select(*columns, place), now)


def read_lead_lines(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """JSON-lines export: one lead per line, splittable; broken lines are left out."""
    schema = T.StructType([*LEAD.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    good = rows.select("*", file_place().alias("seq")).filter(F.col("_broken").isNull())
    return _defaults(good.drop("_broken"), now)


def read_leads(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Earlier leads by file type; a missing or unreadable input is no leads.

    A malformed envelope explodes to nothing; broken JSON lines are left out.
    """
    if not storage.exists(spark, path):
        return empty_leads(spark)
    if path.lower().endswith(".json"):
        return read_lead_json(spark, path, now)
    if path.lower().endswith(".jsonl"):
        return read_lead_lines(spark, path, now)
    return read_lead_csv(spark, path, now)


# -- lenient reading for the combined view ------------------------------------


def _clean_items(items: Column) -> Column:
    return F.filter(F.transform(items, trim_ws), lambda x: x != "")


def list_or_text(text: Column) -> Column:
    """A list that may have been stored as one joined text."""
    one = F.when(trim_ws(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(text, F.lit(" | ")), _clean_items(F.split(text, " \\| "))).otherwise(one)


def _with_view_score(df: DataFrame) -> DataFrame:
    """Keep a stored score only beside a valid label and a real value.

    Expects ``stored_label``, ``stored_score`` (int or NULL), ``has_score``.
    """
    label = F.lower(trim_ws(F.coalesce("stored_label", F.lit(""))))
    keep = label.isin("high", "medium", "low") & F.coalesce("has_score", F.lit(False))
    own = leads.score()
    return df.withColumns(
        {
            "quality_score": F.when(keep, F.coalesce("stored_score", F.lit(0))).otherwise(own),
            "quality_label": F.when(keep, label).otherwise(leads.label(own)),
        }
    ).drop("stored_label", "stored_score", "has_score")


def _view_defaults(df: DataFrame) -> DataFrame:
    texts = {c: F.coalesce(c, F.lit("")) for c in ("niche", "website", "source_query", "scraped_at")}
    empty = F.array().cast("array<string>")
    return df.withColumns(
        texts
        | {c: F.coalesce(c, empty) for c in vocab.CONTACT_LISTS}
        | {
            "business_name": F.coalesce(F.nullif("business_name", F.lit("")), F.lit("Unknown")),
            "email_origin": F.coalesce(F.nullif("email_origin", F.lit("")), F.lit("scraped")),
        }
    )


def _lenient_json(spark: SparkSession, path: str, one_per_line: bool) -> DataFrame:
    docs = spark.read.option("wholetext", not one_per_line).text(path)
    doc = F.try_parse_json("value")
    items = F.coalesce(
        F.try_variant_get(doc, "$.leads", "array<variant>"),
        F.try_variant_get(doc, "$", "array<variant>"),
    )
    rows = docs.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("doc"),
        F.posexplode(items).alias("pos", "item"),
    ).filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))

    def get(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("item", f"$.{name}", kind)

    def items_of(name: str) -> Column:
        listed = get(name, "array<string>")
        return F.when(listed.isNotNull(), _clean_items(F.array_compact(listed))).otherwise(
            list_or_text(get(name))
        )

    raw_score = get("quality_score", "variant")
    is_text = F.schema_of_variant(raw_score) == "STRING"
    number = get("quality_score", "double")
    return rows.select(
        *[
            items_of(c).alias(c) if c in vocab.CONTACT_LISTS else get(c).alias(c)
            for c in LEAD_COLUMNS
        ],
        get("quality_label").alias("stored_label"),
        F.when(is_text, get("quality_score").try_cast("int")).otherwise(number.cast("int")).alias("stored_score"),
        F.when(is_text, get("quality_score") != "").otherwise(F.coalesce(number, F.lit(0.0)) != 0).alias("has_score"),
        F.struct("file", F.col("doc").alias("row"), "pos").alias("seq"),
    )


def _lenient_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv_rows(spark, path, multi_line=True)
    lists = {c: list_or_text(F.coalesce(c, F.lit(""))) for c in vocab.CONTACT_LISTS}
    return (
        rows.withColumns(lists)
        .withColumn("stored_label", F.col("quality_label"))
        .withColumn("stored_score", F.col("quality_score").try_cast("int"))
        .withColumn("has_score", F.coalesce("quality_score", F.lit("")) != "")
        .withColumn("seq", F.struct("seq.file", "seq.row", F.lit(0).alias("pos")))
        .drop("quality_label", "quality_score")
    )


def read_lead_files(
    spark: SparkSession, paths: Sequence[str], json_per_line: bool = False
) -> DataFrame:
    """Every given lead file in one table, ready for `merge_lead_files`.

    Missing and empty files are skipped.  Lists may be arrays or joined text;
    JSON may be an envelope or a bare array, one per file (or per line, which
    lets Spark split the file).  ``age`` is the rank of a file, newest first.
    """
    stats = {p: storage.file_stats(spark, p) for p in dict.fromkeys(paths)}
    present = [p for p, st in stats.items() if st and st[1] > 0]
    present.sort(key=lambda p: stats[p][0], reverse=True)
    parts = []
    for age, path in enumerate(present):
        if path.lower().endswith(".json"):
            part = _lenient_json(spark, path, json_per_line)
        else:
            part = _lenient_csv(spark, path)
        parts.append(part.withColumn("age", F.lit(age)))
    if not parts:
        out = _view_defaults(empty_leads(spark)).withColumn("age", F.lit(0))
        return out.withColumns({"quality_score": F.lit(0), "quality_label": F.lit("low")})
    return _with_view_score(_view_defaults(reduce(DataFrame.unionByName, parts)))


# -- search cache -------------------------------------------------------------


def cache_results(docs: DataFrame) -> DataFrame:
    """``urls array<variant>`` -> ``array<struct<url,title>>``; bare text is a
    URL without a title."""

    def one(u: Column) -> Column:
        url = F.coalesce(F.try_variant_get(u, "$.url", "string"), F.try_variant_get(u, "$", "string"))
        title = F.coalesce(F.try_variant_get(u, "$.title", "string"), F.lit(""))
        return F.struct(url.alias("url"), title.alias("title"))

    return docs.withColumn("urls", F.transform("urls", one))


def read_cache(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Search-cache documents with the time their file was written."""
    docs = (
        spark.read.schema("query string, fetched_at string, urls array<variant>")
        .option("multiLine", multi_line)
        .json(path)
    )
    return cache_results(docs.select("*", F.col("_metadata.file_modification_time").alias("modified")))


def fresh_only(
    docs: DataFrame,
    hours: int = vocab.CACHE_HOURS,
    now: Column | None = None,
    by: str = "fetched_at",
) -> DataFrame:
    """Documents still valid; *by* may also be the file time, ``modified``."""
    at = F.col(by).cast("timestamp") if by == "modified" else F.try_to_timestamp(F.col(by))
    limit = (F.current_timestamp() if now is None else now) - F.make_dt_interval(hours=F.lit(hours))
    return docs.filter(at > limit)

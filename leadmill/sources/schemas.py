"""Explicit schemas of the tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.functions import vocab

_LIST = T.ArrayType(T.StringType(), False)

LEAD = T.StructType(
    [
        T.StructField("business_name", T.StringType()),
        T.StructField("niche", T.StringType()),
        T.StructField("website", T.StringType()),
        *[T.StructField(c, _LIST) for c in vocab.CONTACT_LISTS],
        T.StructField("source_query", T.StringType()),
        T.StructField("email_origin", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
    ]
)
LEAD_COLUMNS = LEAD.fieldNames()

# Row order of a file: the file it stands in, then its position.
PLACE = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("row", T.LongType())]
)
LEAD_FILE = T.StructType([*LEAD.fields, T.StructField("seq", PLACE)])

RESULT = "struct<url:string,title:string>"
NICHE = (
    "niche_pos int, id string, label string, search_queries array<string>, "
    "scope_keywords array<string>, exclusion_keywords array<string>"
)


def empty_leads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEAD_FILE)


def file_place() -> Column:
    """Order of a row read from unsplit files (text, whole JSON, quoted CSV)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("row"),
    )

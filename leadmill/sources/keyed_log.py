"""A keyed table kept as a log: a batch writes its own keys, not the table.

Layout below the table's folder:

* ``v<n>/_part=<p>/``: the rows batch *n* put, split by the hash of their key;
* ``c<n>/_part=<p>/``: parts that were merged to one piece when batch *n* came;
* ``log/<n>.json``: the commit of batch *n*.  It names the pieces of every part,
  oldest first, so a reader never lists folders and sees a batch whole or not at all.

The row of the latest batch wins.  A part of one piece is read as it stands; only
parts with later pieces are merged, by key, which holds at most *max_pieces* rows a
key.  A part with more pieces is merged in the same commit, so a table of any age
is read from a bounded number of files per part.

A batch that is run again after a failure replaces its own commit, and starts from
the commit before it.  One writer at a time; readers of the last two commits are safe.
Rows have the columns ``_key`` (not null, one row a key in a batch) and ``_gone``
(the key leaves the table).  An empty batch commits no pieces.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadmill import storage

PARTS = 64
MAX_PIECES = 8


@dataclass(frozen=True)
class Commit:
    """What a table holds after a batch; *tag* is the caller's, kept as it is."""

    number: int
    parts: int
    schema: StructType
    pieces: dict[int, list[str]]
    tag: str = ""


def _log_name(path: str, number: int) -> str:
    return f"{path}/log/{number:012d}.json"


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that are kept, ascending."""
    names = storage.names(spark, f"{path}/log")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commit_of(spark: SparkSession, path: str, number: int) -> Commit:
    held = json.loads(storage.read_text(spark, _log_name(path, number)))
    pieces = {int(part): found for part, found in held["pieces"].items()}
    return Commit(number, held["parts"], StructType.fromJson(held["schema"]), pieces, held["tag"])


def last_commit(spark: SparkSession, path: str, before: int | None = None) -> Commit | None:
    found = [n for n in commits(spark, path) if before is None or n < before]
    return commit_of(spark, path, found[-1]) if found else None


def part_of(key: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table that no Python worker has to make."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _latest(
    spark: SparkSession, path: str, commit: Commit, parts: set[int] | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """The last row of every key, or of these keys, keys that are gone included.

    Rows of other keys are left out before the pieces of a part are merged.
    """
    wanted = [found for part, found in sorted(commit.pieces.items()) if parts is None or part in parts]

    def read(pieces: list[str]) -> DataFrame:
        held = spark.read.schema(commit.schema).parquet(*[f"{path}/{p}" for p in pieces])
        return held if keys is None else held.join(keys.select("_key"), "_key", "left_semi")

    whole = [found[0] for found in wanted if len(found) == 1]
    several = [p for found in wanted if len(found) > 1 for p in found]
    if not several:
        return read(whole) if whole else _no_rows(spark, commit.schema)
    last = Window.partitionBy("_key").orderBy(F.desc("_batch"))
    merged = read(several).withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return read(whole).unionByName(merged) if whole else merged


def rows(spark: SparkSession, path: str, commit: Commit, keys: DataFrame | None = None) -> DataFrame:
    """The rows of a commit with their ``_key``; with *keys* (column ``_key``) only theirs.

    Of the table only the parts that hold these keys are read.
    """
    parts = None
    if keys is not None:
        touched = keys.select(part_of("_key", commit.parts).alias("part")).distinct().collect()
        parts = {r["part"] for r in touched}  # at most as many as the table has parts
    return _latest(spark, path, commit, parts, keys).filter("NOT _gone").drop("_gone", "_batch")


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table after its last commit (older than *before*); None if there is none."""
    commit = last_commit(spark, path, before)
    return None if commit is None else rows(spark, path, commit).drop("_key")


def _write_parts(df: DataFrame, path: str, name: str, parts: int) -> dict[int, str]:
    """Write rows split by part; the folder of every part that has rows."""
    split = df.withColumn("_part", part_of("_key", parts))
    split.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{name}")
    found = [n for n in storage.names(df.sparkSession, f"{path}/{name}") if n.startswith("_part=")]
    return {int(n.partition("=")[2]): f"{name}/{n}" for n in found}


def _same_columns(given: StructType, schema: StructType) -> list[str]:
    """The columns in the order of the table; types must agree, nullable or not."""
    has = {f.name: f.dataType.simpleString() for f in given}
    want = {f.name: f.dataType.simpleString() for f in schema}
    if has != want:
        raise ValueError(f"the batch has {has}, the table {want}")
    return schema.names


def put(
    spark: SparkSession,
    path: str,
    number: int,
    changed: DataFrame,
    tag: str = "",
    parts: int = PARTS,
    max_pieces: int = MAX_PIECES,
) -> Commit:
    """Commit batch *number*: the rows of *changed* replace those of their keys.

    *parts* counts for a new table only; a table keeps the number it began with.
    """
    earlier = last_commit(spark, path, before=number)
    changed = changed.withColumn("_batch", F.lit(number).cast("long"))
    if earlier is None:
        schema, pieces = changed.schema, {}
    else:
        schema, parts = earlier.schema, earlier.parts
        pieces = {part: list(found) for part, found in earlier.pieces.items()}
        changed = changed.select(*_same_columns(changed.schema, schema))
    for part, piece in _write_parts(changed, path, f"v{number}", parts).items():
        pieces.setdefault(part, []).append(piece)

    long = {part for part, found in pieces.items() if len(found) > max_pieces}
    if long:
        held = Commit(number, parts, schema, pieces)
        merged = _write_parts(
            _latest(spark, path, held, long).filter("NOT _gone"), path, f"c{number}", parts
        )
        for part in long:
            pieces[part] = [merged[part]] if part in merged else []
    pieces = {part: found for part, found in pieces.items() if found}
    commit = Commit(number, parts, schema, pieces, tag)
    text = json.dumps({"parts": parts, "schema": schema.jsonValue(), "pieces": pieces, "tag": tag})
    storage.write_text(spark, _log_name(path, number), text)
    _forget(spark, path)
    return commit


def _forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all but the last commits, and the pieces that only these name."""
    numbers = commits(spark, path)
    held = {p for n in numbers[-keep:] for found in commit_of(spark, path, n).pieces.values() for p in found}
    batches = {p.partition("/")[0] for p in held} | {f"v{n}" for n in numbers[-keep:]}
    for number in numbers[:-keep]:
        old = {p for found in commit_of(spark, path, number).pieces.values() for p in found} - held
        for name in {p if p.partition("/")[0] in batches else p.partition("/")[0] for p in old}:
            storage.delete(spark, f"{path}/{name}")
        storage.delete(spark, _log_name(path, number))

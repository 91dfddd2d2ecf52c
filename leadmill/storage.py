"""Shared-folder storage: scratch tables and versioned tables.

Nothing here relies on one machine.  Scratch tables go to the folder the
cluster names in ``spark.checkpoint.dir``; a temporary folder is only used
when that is unset and the master is local.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="leadmill-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Write a table used more than once and read it back.

    This cuts the lineage: a lost executor re-reads a file instead of
    re-extracting pages, and later filters cannot re-run the extraction.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- Hadoop file system, so the same code works on any store -----------------


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, jpath = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, jpath = _fs(spark, path)
    opened = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then give it its own: never seen in part."""
    staged = f"{path}.{uuid.uuid4().hex[:8]}"
    fs, source = _fs(spark, staged)
    opened = fs.create(source)
    try:
        opened.write(bytearray(text, "utf-8"))
    finally:
        opened.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    if not fs.rename(source, target):
        raise OSError(f"{staged} could not be moved to {path}")


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Move the data files of a written folder into *target*, *prefix* before their names."""
    fs, folder = _fs(spark, target)
    fs.mkdirs(folder)
    for name in names(spark, source):
        if name.startswith(("_", ".")):
            continue
        moved = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{prefix}{name}")
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{source}/{name}"), moved):
            raise OSError(f"{source}/{name} could not be moved to {target}")


def file_stats(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(modified at in ms, size in bytes) of a file or folder, None if absent."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    size = fs.getContentSummary(jpath).getLength()
    return fs.getFileStatus(jpath).getModificationTime(), size


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a versioned table, ascending."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    found = []
    for status in fs.listStatus(jpath):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            if exists(spark, f"{path}/{name}/_SUCCESS"):
                found.append(int(name[1:]))
    return sorted(found)


def version_path(path: str, version: int) -> str:
    return f"{path}/v{version}"


def prune_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all but the newest versions; readers of the last one stay safe."""
    for version in versions(spark, path)[:-keep]:
        fs, jpath = _fs(spark, version_path(path, version))
        fs.delete(jpath, True)


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Put a finished folder in the place of *path*, keeping the old one as
    ``<path>.previous`` until the next swap."""
    fs, target = _fs(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(staged)
    old = spark._jvm.org.apache.hadoop.fs.Path(path + ".previous")
    if not fs.exists(source):
        raise FileNotFoundError(staged)
    if not fs.exists(target):
        if not fs.rename(source, target):
            raise OSError(f"{staged} could not be moved to {path}")
        return
    fs.delete(old, True)
    if not fs.rename(target, old):
        raise OSError(f"{path} could not be set aside")
    moved = False
    try:
        moved = fs.rename(source, target)
    finally:
        if not moved:
            fs.rename(old, target)
    if not moved:
        raise OSError(f"{staged} could not be moved to {path}; the former version is back in place")

"""Run registered queries next to their check SQL and report differences.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leadmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float) and v == int(v):
        return repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None if got else "no rows on either side"
    for a, b in zip(got, want):
        if a != b:
            return f"{len(got)} / {len(want)} rows; first: {sorted(df.columns)}\n  spark {a}\n  duck  {b}"
    return f"{len(got)} / {len(want)} rows"


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            problem = check(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        print(f"{mark} {name:24s} {time.time() - t:6.2f}s {'' if name in oracles else '(rows only)'}", flush=True)
        if problem:
            print("   ", problem[:3000], flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

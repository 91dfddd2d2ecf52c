"""Seen domains with a lifetime: what is taken, and a state that stays flat."""

import datetime as dt

from pyspark.sql import functions as F
from test_semantics import lead

from leadmill.streaming import incremental

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "url string, seen_at timestamp"


def test_state_of_seen_domains_stays_flat(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    prior = lead(spark, [(0, "p", "https://known.net/", 1, 0)])
    sizes = []
    for day in range(8):
        at = T0 + dt.timedelta(hours=30 * day)
        rows = [(f"https://d{day}x{i}.net/p", at) for i in range(20)]
        rows += [("https://always.net/", at), ("https://known.net/a", at), (None, at), ("https://untimed.net/", None)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        q = (
            incremental.live_domains(stream, prior, hours=24, late_hours=1)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = [(r.domain, r.seen_at) for r in spark.read.parquet(out).collect()]
    assert sorted(at for d, at in got if d == "always.net") == [T0 + dt.timedelta(hours=30 * n) for n in range(8)]
    assert len(got) == len(set(got)) == 8 * 21 and not {"known.net", "untimed.net"} & {d for d, _ in got}
    assert max(sizes) <= 42 and sizes[-1] <= sizes[1] + 1, sizes


def test_inside_the_lifetime_a_domain_is_taken_once(spark, tmp_path):
    hours = [0, 5, 23, 24, 30, 47, 50]
    rows = [(f"https://a.net/{h:02d}", T0 + dt.timedelta(hours=h)) for h in hours]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("domain", F.lit("a.net"))
    df.select("url", "seen_at").coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/src")
    taken = incremental.live_domains(stream, lead(spark, [(0, "p", None, 0, 0)]), hours=24)
    q = (
        taken.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == ["https://a.net/00", "https://a.net/24", "https://a.net/50"]

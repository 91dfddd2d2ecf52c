"""What must not grow with the number of keys, phrases or leads."""

import datetime as dt
import json

from pyspark.sql import functions as F
from test_semantics import lead

from leadmill import storage
from leadmill.catalog import streams
from leadmill.catalog.derived import leads_table
from leadmill.functions import phrases
from leadmill.sources import keyed_log, readers, writers
from leadmill.streaming import incremental

T0 = dt.datetime(2024, 1, 1)


def _run(stream, tmp_path):
    q = (
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def _hours(n):
    return T0 + dt.timedelta(hours=n)


def test_results_with_a_lifetime_share_state_rows(spark, tmp_path):
    """more keys than groups, over two triggers; null queries and URLs are keys, too."""
    schema = "query string, fetched_at timestamp, urls array<struct<url:string,title:string>>"
    keys = [("q", f"u{i}") for i in range(1500)] + [(None, "u0"), ("q", None)]
    for hours in ((5, 0, 24), (30, 48, 60)):
        rows = [(q, _hours(h), [(u, "b"), (u, None)]) for h in hours for q, u in keys]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/src")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/src")
        size = _run(incremental.refreshed_results(stream, hours=24, late_hours=100), tmp_path)
        assert size <= incremental.GROUPS < len(keys)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.title for r in got} == {""}
    want = sorted((u or "", h) for _, u in keys for h in (0, 24, 48))
    assert sorted((r.url or "", (r.fetched_at - T0).total_seconds() / 3600) for r in got) == want


def test_domains_with_a_lifetime_share_state_rows(spark, tmp_path):
    """as above; a key whose life is over leaves its group, the others stay."""
    schema = "url string, seen_at timestamp"
    prior = lead(spark, [(0, "p", "https://d7.net/", 1, 0)])
    for hours in ((0,), (30,)):
        rows = [(f"https://d{i}.net/", _hours(h + i % 2)) for h in hours for i in range(1500)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/src")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/src")
        size = _run(incremental.live_domains(stream, prior, hours=24, late_hours=1), tmp_path)
        assert size <= incremental.GROUPS
    got = sorted((r.domain, r.seen_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((f"d{i}.net", _hours(h + i % 2)) for h in (0, 30) for i in range(1500) if i != 7)


def test_a_text_is_made_once_for_all_phrases(spark):
    """the expression behind a text must not stand inside the loop over the phrases."""
    rows = [("we sell shoes",), ("our INVESTOR RELATIONS",), ("wikipedia",), (None,), ("",)]
    texts = spark.createDataFrame(rows, "t string").select(F.lower("t").alias("low"))
    for flag in phrases.PAGE_FLAGS.values():
        plan = texts.select(flag("low").alias("hit"))
        shown = plan._jdf.queryExecution().optimizedPlan().toString()
        for loop in ("exists(", "filter("):
            at = shown.find(loop)
            assert at < 0 or "lower(" not in shown[at:].splitlines()[0]
    got = [r.hit for r in texts.select(phrases.is_corporate("low").alias("hit")).collect()]
    assert got == [False, True, False, False, False]
    listed = F.array(*map(F.lit, ("shoes", "sell", "none")))
    assert [r.n for r in texts.select(phrases.hits("low", listed).alias("n")).collect()][:2] == [2, 0]


def test_an_envelope_is_written_and_read_by_many_tasks(spark, tmp_path):
    """ordered parts that make one document; its lines are split, other layouts still read."""
    df = lead(spark, [(i, f"n{i}, {{x", f"https://h{i}.com", i % 4, i % 3) for i in range(3000)]).repartition(4)
    path = f"{tmp_path}/out.json"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        writers.write_json(df, path, envelope=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out.json").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    doc = json.loads(text)
    assert len(parts) > 1 and doc["lead_count"] == len(doc["leads"]) == 3000
    got = readers.read_leads(spark, path).orderBy("seq").collect()
    assert [(r.business_name, r.emails) for r in got] == [(x["business_name"], x["emails"]) for x in doc["leads"]]

    def names(name, content):
        (tmp_path / name).write_text(content)
        return [r.business_name for r in readers.read_leads(spark, f"{tmp_path}/{name}").orderBy("seq").collect()]

    want = [x["business_name"] for x in doc["leads"]]
    assert names("one.json", text) == want
    assert names("pretty.json", json.dumps(doc, indent=1)) == want
    assert names("dense.json", json.dumps(doc)) == want
    lines = text.splitlines()
    for cut in (lines[:-1], lines[:5] + lines[6:5] + ["{broken"], lines[1:], ["{broken"]):
        assert names("cut.json", "\n".join(cut)) == []
    head = lines[0].replace("3000", "0")
    assert names("none.json", head + "\n]}\n") == []


def test_waves_are_written_by_many_tasks(spark, tmp_path):
    """a wave is one trigger however many files it has; together they hold the table once."""
    df = spark.range(400).repartition(4)
    sizes = []
    for stream in streams._in_waves(df, "id", f"{tmp_path}/src"):
        q = (
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        sizes.append(q.lastProgress["numInputRows"])
    assert sizes == [100] * 4 and len(list((tmp_path / "src").glob("*.parquet"))) > 4
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(400))


def test_a_wave_is_moved_in_and_not_written_again(spark, tmp_path):
    """scratch and source hold every row once; waves without rows are no fault."""
    held = {p for p in storage.names(spark, storage.shared_dir(spark)) if p.startswith("arriving-")}
    df = spark.createDataFrame([(0,), (1,), (100,), (None,)], "id long")
    for stream in streams._in_waves(df, "id", f"{tmp_path}/src", top=100):
        q = (
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 4 and set(got) == {0, 1, 100, None}  # without an order: the last wave
    scratch = storage.shared_dir(spark)
    [made] = {p for p in storage.names(spark, scratch) if p.startswith("arriving-")} - held
    left = [n for i in range(4) for n in storage.names(spark, f"{scratch}/{made}/_wave={i}")]
    assert not [n for n in left if n.endswith(".parquet")]


def test_rows_of_other_keys_are_left_out_before_pieces_are_merged(spark, tmp_path):
    """an upsert sorts and shuffles the hosts of its batch, not the table."""
    path = f"{tmp_path}/t"
    for n in range(2):
        rows = spark.range(100).select(
            F.concat(F.lit("k"), "id").alias("_key"), F.lit(n).alias("v"), (F.col("id") == 7).alias("_gone")
        )
        keyed_log.put(spark, path, n, rows, parts=4)
    keys = spark.createDataFrame([("k3",), ("k7",), ("none",)], "_key string")
    got = keyed_log.rows(spark, path, keyed_log.last_commit(spark, path), keys)
    assert [(r["_key"], r.v) for r in got.collect()] == [("k3", 1)]
    shown = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= shown.index("Window") < shown.index("LeftSemi")
    none = keyed_log._latest(spark, path, keyed_log.last_commit(spark, path), set())
    assert none.columns == ["_key", "v", "_gone", "_batch"] and none.collect() == []
    assert "RDD" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_the_formulas_of_the_leads_are_no_single_method(spark, sf_dir):
    """fused into one generated method, they were too large for the JVM to compile."""
    spark.conf.set("spark.sql.adaptive.enabled", False)  # else fused methods are not shown
    try:
        shown = leads_table(spark, sf_dir, "fx_leads")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in shown.splitlines() if "Project" in line and "| m2_" in line]
    assert made and not any("*(" in line for line in made)

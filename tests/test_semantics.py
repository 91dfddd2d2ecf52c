"""Folds, merges and ranking against small models written here; skew; files;
streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.functions import vocab
from leadmill.operators import deny, enrich, merge, views
from leadmill.sources import readers, writers
from leadmill.sources.schemas import LEAD
from leadmill.streaming import incremental

LISTS = vocab.CONTACT_LISTS


def lead(spark, rows):
    """rows: (seq, name, website, n_emails, phones)"""
    data = [
        (n, "saas", w, [f"{i}n{s}@x.com" for i in range(e)], [], [], [], [str(10**9 + j) for j in range(p)], "q",
         "scraped", "2024-01-01", s)
        for s, n, w, e, p in rows
    ]
    return spark.createDataFrame(data, _schema())


def _schema():
    from pyspark.sql import types as T

    return T.StructType([*LEAD.fields, T.StructField("seq", T.LongType())])


def test_walk_matches_model(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for site in range(120):
        steps = []
        for pos in range(rng.randint(1, 5)):
            present = rng.random() < 0.8
            n = rng.choice([0, 0, 1])
            steps.append(
                dict(pos=pos, present=present, final=f"f{rng.randint(0, 3)}" if present else None,
                     empty=rng.random() < 0.2, ok=rng.random() < 0.7,
                     emails=[f"e{site}_{pos}@x.com"] * n if present else None,
                     phones=[f"1{site}{pos}"] * rng.choice([0, 1]) if present else None)
            )
        misses, visited, emails, phones = 0, set(), set(), set()
        for s in steps:
            if misses >= 3:
                break
            if not s["present"]:
                misses += 1
                continue
            if s["final"] in visited:
                continue
            visited.add(s["final"])
            if s["empty"] or not s["ok"] or not (s["emails"] or s["phones"]):
                misses += 1
                continue
            misses = 0
            emails |= set(s["emails"])
            phones |= set(s["phones"])
            if emails:
                break
        want[f"u{site}"] = (sorted(emails), sorted(phones))
        rows += [
            (f"u{site}", "n", s["pos"], "", s["present"], s["final"], s["empty"], s["ok"], s["emails"],
             [] if s["present"] else None, [] if s["present"] else None, [] if s["present"] else None, s["phones"])
            for s in steps
        ]
    rng.shuffle(rows)
    cols = "url string, niche string, pos int, sub_url string, present boolean, final_url string, is_empty boolean, accepted boolean, " + ", ".join(
        f"{c} array<string>" for c in LISTS
    )
    got = enrich.contact_walk(spark.createDataFrame(rows, cols)).collect()
    assert {r.url: (r.emails, r.phones) for r in got} == want


def test_merge_ties(spark):
    old = lead(spark, [(0, "old", "https://www.a.com/", 1, 0), (1, "rich", "https://b.com", 3, 0), (2, "none", "", 1, 0)])
    new = lead(spark, [(0, "new", "http://a.com/x", 0, 1), (1, "poor", "https://B.com/", 1, 0)])
    merged = merge.best_first(merge.with_quality(merge.merge_leads(new, old)), "first_seen").collect()
    assert [r.business_name for r in merged] == ["rich", "new"]
    both = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    files = merge.merge_lead_files(both, ["age", "seq"]).collect()
    assert {r.business_name for r in files} == {"rich", "old", "none"}
    first = merge.dedupe_leads(both.withColumn("seq", F.col("age") * 10 + F.col("seq"))).collect()
    assert {r.business_name for r in first} == {"new", "poor", "none"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_hot_host(spark, partitions):
    """One host with half of all rows gives the same result on any layout."""
    rows = [(i, f"n{i}", "https://hot.com/" if i % 2 else f"https://s{i}.com/", i % 5, i % 3) for i in range(400)]
    df = lead(spark, rows).repartition(partitions)
    empty = lead(spark, rows[:0])
    hot = [r for r in merge.merge_leads(df, empty).collect() if "hot" in r.website]
    best = max((r for r in rows if r[0] % 2), key=lambda r: (r[3] + r[4], r[0]))
    assert [r.business_name for r in hot] == [best[1]]
    site = df.withColumn("site", F.col("website"))
    merged = {r.site: r for r in merge.merge_contacts(site, "site").collect()}
    want = sorted({f"{i}n{r[0]}@x.com" for r in rows if r[0] % 2 for i in range(r[3])})
    assert merged["https://hot.com/"].emails == want
    top = merge.top_n_per_key(site, ["niche"], ["seq"], 1500).count()
    assert top == 400 and merge.top_n_per_key(site, ["niche"], ["seq"], 3).count() == 3


def test_deny_table_equals_list(spark):
    urls = ["https://a.b.com/", "https://b.com/", "https://xb.com/", "https://c.commonfloor/", "nohost"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    hosts = ["b.com", "commonfloor"]
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    by_table = {r.url for r in deny.drop_denied_hosts(df, "url", table).collect()}
    by_list = {r.url for r in df.filter(~deny.host_denied("url", hosts)).collect()}
    assert by_table == by_list == {"https://xb.com/", "nohost"}


def test_seed_order_and_comments(spark, tmp_path):
    f = tmp_path / "seeds.txt"
    f.write_text("﻿b.com\n# no\n\n  a.com \nc.com", encoding="utf-8")
    got = readers.read_seeds(spark, str(f)).orderBy("seq").collect()
    assert [r.url for r in got] == ["b.com", "a.com", "c.com"]


def test_csv_and_json_files(spark, tmp_path):
    df = lead(spark, [(0, 'A "quoted", | name', "https://a.com", 2, 1), (1, "line\nbreak", "https://b.com", 0, 0)])
    path = str(tmp_path / "out.csv")
    writers.export_leads(df, path, single_file=True)
    part = next((tmp_path / "out.csv").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and part.read_text("utf-8-sig").startswith("business_name,niche")
    back = {r.business_name: r.emails for r in readers.read_leads(spark, path).collect()}
    assert back == {r.business_name: r.emails for r in df.collect()}
    path = str(tmp_path / "out.json")
    writers.export_leads(df, path)
    text = "".join(p.read_text() for p in (tmp_path / "out.json").glob("part-*"))
    doc = json.loads(text)
    assert doc["lead_count"] == 2 and [x["quality_score"] for x in doc["leads"]] == [31, 0]
    assert readers.read_leads(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert readers.read_leads(spark, str(tmp_path / "bad.json")).count() == 0
    assert readers.read_lead_files(spark, [str(tmp_path / "none.csv")]).count() == 0


def test_cache_upsert(spark, tmp_path):
    def docs(rows):
        return spark.createDataFrame(
            [(q, "2024-01-01", [(u, "t")]) for q, u in rows],
            "query string, fetched_at string, urls array<struct<url:string,title:string>>",
        )

    path = str(tmp_path / "cache")
    writers.upsert_cache(spark, docs([("q1", "a"), ("q2", "b")]), path)
    writers.upsert_cache(spark, docs([("q2", "c")]), path)
    got = {r.query: r.urls[0].url for r in spark.read.parquet(path).collect()}
    assert got == {"q1": "a", "q2": "c"}


def test_purge_and_delta(spark):
    df = lead(spark, [(0, "ok", "https://a.com", 1, 0), (1, "X | SEO", "https://b.com", 1, 0), (2, "z", "https://zillow.com", 1, 0), (3, "n", None, 1, 0)])
    assert [r.business_name for r in views.purge(df).collect()] == ["ok"]
    change = {r.site: r.change for r in views.run_delta(df.limit(1), df.filter("seq > 0")).collect()}
    assert change["a.com"] == "removed" and change["b.com"] == "added"


def test_restarted_stream_adds_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df = lead(spark, [(i, f"n{i}", f"https://h{i % 5}.com", i % 4, 0) for i in range(40)])
    df.filter("seq < 20").coalesce(1).write.parquet(src)
    for more in (df.filter("seq >= 20"), None):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        incremental.upsert_stream(stream, out, state).awaitTermination()
    streamed = {(r.website, r.business_name) for r in incremental.current_leads(spark, out).collect()}
    batch = merge.merge_leads(df, df.limit(0))
    assert streamed == {(r.website, r.business_name) for r in batch.collect()}
    # The last batch run again gives the same table.
    last = storage.versions(spark, out)[-1]
    incremental.upsert_batch(df.filter("seq >= 20"), last, out)
    again = {(r.website, r.business_name) for r in incremental.current_leads(spark, out).collect()}
    assert again == streamed


def test_cache_lifetime_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "query string, fetched_at timestamp, urls array<struct<url:string,title:string>>"

    def wave(at):
        rows = spark.createDataFrame([("q", at)], "query string, at string")
        rows.select(
            "query", F.col("at").cast("timestamp").alias("fetched_at"),
            F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"))).alias("urls"),
        ).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = (
            incremental.valid_results(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert wave("2024-01-01 00:00:00") == 1
    assert wave("2024-01-03 00:00:00") == 1  # still valid
    wave("2024-02-01 00:00:00")  # moves the watermark past the lifetime
    assert wave("2024-02-20 00:00:00") >= 2  # taken again


def test_scratch_goes_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    shared = storage.shared_dir(spark)
    assert shared == named.rstrip("/") if named else shared.startswith("/")
    assert storage.materialize(spark.range(3)).count() == 3


# -- repeated lookups, broken input, order -------------------------------------


def test_lookups_with_repeated_rows(spark):
    sites = spark.createDataFrame([("u", "saas", ["a@kiln.net", "b@loom.net"])], "url string, niche string, emails array<string>")
    mx = spark.createDataFrame([("kiln.net", True), ("kiln.net", True), ("loom.net", False), ("loom.net", False)], "domain string, has_mx boolean")
    assert enrich.verify_emails(sites, mx).first().emails == ["a@kiln.net"]
    boxes = spark.createDataFrame([(f"info@{d}", True) for d in ("kiln.net", "mailinator.com")], "email string, accepts boolean")
    assert [r.domain for r in enrich.generic_mailboxes(boxes).collect()] == ["kiln.net"]


def test_broken_lines_are_left_out(spark, tmp_path):
    path = tmp_path / "old.jsonl"
    path.write_text('{"business_name": "Kiln", "website": "https://kiln.net/"}\n{"business_name": "Lo\n[1, 2\n')
    assert [r.business_name for r in readers.read_leads(spark, str(path)).collect()] == ["Kiln"]


def test_cache_keeps_the_last_document(spark, tmp_path):
    urls_ = "array<struct<url: string, title: string>>"
    docs = spark.createDataFrame(
        [("q", "2024-01-0%d" % i, [(f"https://k{i}.net/", "")]) for i in (1, 3, 2)] + [("r", "2024-01-01", [])],
        f"query string, fetched_at string, urls {urls_}",
    )
    for _ in range(2):
        writers.upsert_cache(spark, docs, f"{tmp_path}/cache")
    got = {r["query"]: r.fetched_at for r in spark.read.parquet(f"{tmp_path}/cache").collect()}
    assert got == {"q": "2024-01-03", "r": "2024-01-01"} and spark.read.parquet(f"{tmp_path}/cache").count() == 2


def test_upsert_is_the_same_in_one_batch_and_in_many(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"n{i}", rng.choice(["https://kiln.net/", "https://www.kiln.net/x", "https://loom.net/", ""]), rng.randint(0, 3), 1) for i in range(40)]
    for n in (1, 4):
        for batch in range(n):
            incremental.upsert_batch(lead(spark, rows[batch * 40 // n : (batch + 1) * 40 // n]), batch, f"{tmp_path}/t{n}")
    one, four = (
        sorted((r.website, r.business_name) for r in incremental.current_leads(spark, f"{tmp_path}/t{n}").collect()) for n in (1, 4)
    )
    assert one == four and len(one) == 2


def test_numbered_is_the_global_order(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id").repartition(7)
    got = merge.numbered(df.orderBy(F.desc("v"), "id")).collect()
    want = sorted(((r.v, r.id) for r in got), key=lambda r: (-r[0], r[1]))
    assert {r.place: (r.v, r.id) for r in got} == dict(enumerate(want, 1))


def test_swap_in_puts_the_former_version_back(spark, tmp_path):
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "old").write_text("x")
    with pytest.raises(Exception):
        storage.swap_in(spark, f"{tmp_path}/not-there", f"{tmp_path}/table")
    assert (tmp_path / "table" / "old").exists()


def test_result_blocks_end(spark):
    from leadmill.sources import results

    pages = [
        ("ecosia", '<div class="result"><p>none</p></div><footer><a href="https://foot.net/">f</a></footer>', []),
        ("brave", '<div class="snippet"><div>x</div></div><a href="https://foot.net/">f</a>'
                  '<div class="snippet"><a class="snippet-title" href="https://b.net/">B</a></div>', ["https://b.net/"]),
        ("mojeek", '<nav><li><h2><a href="https://nav.net/">n</a></h2></li></nav><ul class="results-standard"><li><h2>'
                   '<a href="https://m.net/">M</a></h2></li></ul><li><h2><a href="https://out.net/">o</a></h2></li>', ["https://m.net/"]),
        ("searx", '<article class="result"><article>x</article><h3><a href="https://s.net/">S</a></h3></article>', ["https://s.net/"]),
    ]
    df = spark.createDataFrame([(e, h) for e, h, _ in pages], "engine string, html string")
    got = {}
    for r in results.html_results(df, ["engine"]).collect():
        got.setdefault(r.engine, []).append(r.url)
    assert got == {e: u for e, _, u in pages if u}


def test_cached_results_are_taken_again_after_their_lifetime(spark, tmp_path):
    schema = "query string, fetched_at timestamp, urls array<struct<url: string, title: string>>"
    start = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
    for hours in ((167, 100, 0), (168, 300), (336,), (900, 905)):
        rows = [("q", start + dt.timedelta(hours=h), [("https://a.com/", "A")]) for h in hours]
        rows += [("q", start + dt.timedelta(hours=h), [("https://b.com/", None)]) for h in hours if h in (0, 900)]
        rows.append((None, None, None))
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = (
            incremental.refreshed_results(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).selectExpr("url", "unix_micros(fetched_at) AS at")
    base = int(start.timestamp()) * 1_000_000
    got = sorted((r.url, (r.at - base) // 3_600_000_000) for r in out.collect())
    assert got == [("https://a.com/", h) for h in (0, 168, 336, 900)] + [("https://b.com/", h) for h in (0, 900)]

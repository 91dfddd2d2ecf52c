"""The keyed log against a dictionary; what a batch writes; batches run again."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_semantics import lead

from leadmill.sources import keyed_log, writers
from leadmill.streaming import incremental


def put(spark, path, number, change, **options):
    df = spark.createDataFrame(
        [(k, v is None, v) for k, v in change.items()], "_key string, _gone boolean, v long"
    )
    return keyed_log.put(spark, path, number, df, parts=4, **options)


def held(spark, path, **options):
    commit = keyed_log.last_commit(spark, path, **options)
    return {r["_key"]: r["v"] for r in keyed_log.rows(spark, path, commit).collect()}


def test_log_matches_a_dictionary(spark, tmp_path):
    rng, path, want, before = random.Random(5), str(tmp_path / "t"), {}, {}
    for number in range(9):
        change = {f"k{rng.randrange(20)}": rng.choice([None, rng.randrange(100)]) for _ in range(6)}
        commit = put(spark, path, number, change, max_pieces=3)
        before, want = want, {k: v for k, v in {**want, **change}.items() if v is not None}
        assert held(spark, path) == want
        assert max(map(len, commit.pieces.values())) <= 3
        if number:
            assert held(spark, path, before=number) == before
    # The batch run again, whole or with other rows, starts from the commit before it.
    put(spark, path, 8, change, max_pieces=3)
    assert held(spark, path) == want
    put(spark, path, 8, {"k1": 7}, max_pieces=3)
    assert held(spark, path) == {**before, "k1": 7}
    # Commits and pieces that nothing names are gone.
    assert keyed_log.commits(spark, path) == [7, 8]
    named = {p for n in (7, 8) for ps in keyed_log.commit_of(spark, path, n).pieces.values() for p in ps}
    on_disk = {str(p.relative_to(path)) for p in Path(path).glob("[vc]*/_part=*")}
    assert named <= on_disk and len(on_disk - named) <= 8


def test_log_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed_log.read(spark, path) is None
    put(spark, path, 0, {})
    assert keyed_log.read(spark, path).count() == 0
    put(spark, path, 1, {"a": 1})
    assert held(spark, path) == {"a": 1}
    with pytest.raises(ValueError):
        other = spark.createDataFrame([("a", False, 1)], "_key string, _gone boolean, w long")
        keyed_log.put(spark, path, 2, other)
    with pytest.raises(FileNotFoundError):
        writers.read_cache_log(spark, str(tmp_path / "none"))


def test_only_parts_of_the_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, {f"k{i}": i for i in range(200)})
    commit = keyed_log.last_commit(spark, path)
    keys = spark.createDataFrame([("k7",), ("none",)], "_key string")
    found = keyed_log.rows(spark, path, commit, keys)
    assert [(r["_key"], r["v"]) for r in found.collect()] == [("k7", 7)]
    assert len(commit.pieces) == 4 and len(found.inputFiles()) <= 2


def _written(spark, path, number):
    return spark.read.parquet(f"{path}/v{number}").count()


def test_upsert_writes_the_hosts_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.upsert_batch(lead(spark, [(i, f"n{i}", f"https://h{i}.net/", 1, 0) for i in range(1000)]), 0, path)
    batch = [(2000 + i, f"m{i}", f"https://www.h{i * 90}.net/x", 2, 0) for i in range(10)]
    for _ in range(2):  # the second time as after a failure
        incremental.upsert_batch(lead(spark, batch), 1, path)
        assert _written(spark, path, 0) == 1000 and _written(spark, path, 1) == 10
        now = {r.website: r.business_name for r in incremental.current_leads(spark, path).collect()}
        assert len(now) == 1000 and now["https://www.h90.net/x"] == "m1" and now["https://h1.net/"] == "n1"


def test_another_deny_list_is_applied_to_every_host(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.upsert_batch(lead(spark, [(i, f"n{i}", f"https://h{i}.net/", 1, 0) for i in range(20)]), 0, path, ["zz.net"])
    more = lead(spark, [(50, "new", "https://new.net/", 1, 0), (51, "no", "https://h4.net/", 3, 0)])
    listed = spark.createDataFrame([("h3.net",), ("h4.net",)], "host string")
    incremental.upsert_batch(more, 1, path, listed)
    got = {r.website for r in incremental.current_leads(spark, path).collect()}
    assert got == {f"https://h{i}.net/" for i in range(20) if i not in (3, 4)} | {"https://new.net/"}


def test_cache_log_writes_one_file_for_one_query(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "query string, fetched_at string, urls array<struct<url:string,title:string>>"

    def docs(queries, at):
        return spark.createDataFrame([(q, at, [(f"https://{q}.net/", "")]) for q in queries], schema)

    writers.log_cache(spark, docs([f"q{i}" for i in range(300)], "2024-01-01"), path)
    writers.log_cache(spark, docs(["q5", "q5"], "2024-01-02"), path)
    assert len(list(Path(path).glob("v1/_part=*/*.parquet"))) == 1
    got = {r["query"]: r.fetched_at for r in writers.read_cache_log(spark, path).collect()}
    assert len(got) == 300 and got.pop("q5") == "2024-01-02" and set(got.values()) == {"2024-01-01"}
    keys = writers.read_cache_log(spark, path).select(F.col("query_key") == writers.cache_key("query"))
    assert all(r[0] for r in keys.collect())

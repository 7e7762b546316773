"""The bucketed label cache: upserts rewrite only what they touch, and a write that dies leaves the version before."""

import os

import pytest
from pyspark.sql import functions as F

from phaseflux.sources import cachefiles, readers
from phaseflux.sources.cachefiles import Cache

SCHEMA = "cache_key string, disease_area string, created_at string"


def entries(spark, ids, area="x", at="1"):
    return spark.createDataFrame([(i,) for i in ids], "id long").select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.lit(area).alias("disease_area"), F.lit(at).alias("created_at"))


def rows(frame):
    return sorted(map(tuple, frame.select("cache_key", "disease_area", "created_at").collect()))


def files(path):
    return {os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_an_upsert_rewrites_only_its_parts(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=32)
    assert cache.read().count() == 0 and cache.versions() == [] and cache.read().columns == ["cache_key", "disease_area", "created_at"]
    first = entries(spark, range(5000))
    assert cache.upsert(first) == set(range(32)) and cache.versions() == [0]
    before = files(tmp_path)
    assert len(before) == 32
    few = entries(spark, [3, 4, 6000], "y", "2")
    touched = cache.upsert(few)
    assert touched == {r[0] for r in few.select(cachefiles.part(32)).collect()} and len(touched) <= 3
    added = files(tmp_path) - before
    assert len(added) == len(touched) and before <= files(tmp_path)  # nothing else was written, nothing deleted
    assert rows(cache.read()) == rows(readers.cache_upsert(first, few))
    assert cache.upsert(few.where("false")) == set() and cache.versions() == [0, 1]
    # another process with another default keeps the table's own parts
    again = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=7)
    assert rows(again.read()) == rows(cache.read()) and again.upsert(few) == touched
    want = rows(cache.read())
    assert cache.vacuum() == 1 and rows(Cache(spark, str(tmp_path / "c"), SCHEMA).read()) == want and again.versions() == [2]


def test_a_probe_does_not_move_the_cache(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=8)
    cache.upsert(entries(spark, range(2000)))
    cache.upsert(entries(spark, range(0, 2000, 700), "y"))
    probes = entries(spark, range(1500, 2500)).select("cache_key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, n in (("inner", 500), ("left_anti", 500)):
            got = probes.join(cache.read(), "cache_key", how)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and got.count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=4)
    cache.upsert(entries(spark, range(100)))
    want = rows(cache.read())

    @F.udf("string")
    def fails(x):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):  # while parts are written
        cache.upsert(entries(spark, range(50), "y", "2").withColumn("disease_area", fails("disease_area")))
    assert rows(cache.read()) == want and cache.versions() == [0]

    def dies(self, manifest):
        raise OSError("machine is gone")

    with monkeypatch.context() as m, pytest.raises(OSError, match="gone"):  # after the parts, before the manifest
        m.setattr(Cache, "_commit", dies)
        cache.upsert(entries(spark, range(50), "y", "2"))
    assert rows(cache.read()) == want and cache.versions() == [0]
    (tmp_path / "c" / "versions" / "1.json").write_text('{"parts": 4, "pla')  # within the manifest
    (tmp_path / "c" / "versions" / ".1.json.crc").unlink(missing_ok=True)
    assert rows(cache.read()) == want and cache.versions() == [0]
    cache.upsert(entries(spark, range(50), "y", "2"))
    assert cache.versions() == [0, 2] and len(rows(cache.read())) == 100 and rows(cache.read()) != want


def test_migration_rewrites_changed_parts(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=64)
    cache.upsert(entries(spark, range(300), "oncology").unionByName(entries(spark, [1000, 1001], "Onco logy")))
    whole = cache.read()
    new, _ = readers.cache_migrate(whole)
    want = rows(new)
    changed = new.join(whole.select("cache_key", F.col("disease_area").alias("old")), "cache_key").where("old != disease_area").drop("old")
    assert 1 <= len(cache.migrate(changed)) <= 2 and rows(cache.read()) == want


def test_a_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=2)
    cache.upsert(entries(spark, range(9)))
    monkeypatch.setattr(Cache, "_written", lambda self: [])
    with pytest.raises(Exception, match="(?i)exist"):
        cache._commit({"parts": 2, "places": {}})


def test_a_stream_rewrites_parts(spark, tmp_path):
    from phaseflux.streaming import keep_parts

    cache = Cache(spark, str(tmp_path / "c"), SCHEMA, parts=16)
    for i, part in enumerate((entries(spark, range(200)), entries(spark, [5], "z", "2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = files(tmp_path / "c")
        keep_parts(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), cache, str(tmp_path / "cp")).awaitTermination()
        assert len(files(tmp_path / "c") - before) == (16, 1)[i]
    assert rows(cache.read()) == rows(readers.cache_upsert(entries(spark, range(200)), entries(spark, [5], "z", "2")))

"""Numbers of rows and draws, against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from phaseflux.operators import evaluate, numbering


def single(frame):
    """Windows that gather all rows in one task."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition")


def test_ordered(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), f"{i:05d}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "a long, b string").repartition(5)
    got = numbering.ordered(frame, "a", "b", start=1)
    assert single(got) == 0
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r["at"])] == sorted(rows) and sorted(r["at"] for r in got.collect()) == list(range(1, 3001))
    assert numbering.ordered(frame.where("false"), "a").count() == 0


def test_in_files(spark, tmp_path):
    """Files of very different sizes, one of several blocks: Spark reads the large ones first."""
    sizes, want = {"b.csv": 3000, "a.csv": 5, "c.csv": 1, "d.csv": 0, "e.csv": 700}, []
    for name in sorted(sizes):
        lines = [f"{name}-{i}" for i in range(sizes[name])]
        (tmp_path / name).write_text("\n".join(["value", *lines]) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for multi in (False, True):
            rows = spark.read.csv(str(tmp_path), schema="value string", header=True, multiLine=multi)
            assert rows.rdd.getNumPartitions() >= 3
            got = sorted(numbering.in_files(rows).collect(), key=lambda r: r["at"])
            assert [r.value for r in got] == want and [r["at"] for r in got] == list(range(1, len(want) + 1)), multi
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_draws(spark):
    rng = random.Random(4)
    rows = [(f"id{i}", rng.choice("abbbb")) for i in range(2000)] + [(None, "c")]
    frame = spark.createDataFrame(rows, "id string, g string").repartition(4)
    key = lambda i: (hashlib.md5(":".join(["7", *([i] if i is not None else [])]).encode()).hexdigest(), i or "")
    picked = evaluate.sample(frame, "g", "id", 30, seed=7)
    want = {(i, g) for g in "abc" for i in sorted((i for i, x in rows if x == g), key=key)[:30]}
    assert {tuple(r) for r in picked.collect()} == want
    plan = picked._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in after  # below the shuffle: each task hands on 30 rows of a group at most
    order = [r.id for r in evaluate.shuffled(frame, "id", 7).collect()]
    assert order == sorted((i for i, _ in rows), key=key)
    assert {tuple(r) for r in evaluate.sample(frame.withColumn("x", F.lit(1)), "g", "id", 30, seed=8).drop("x").collect()} != want

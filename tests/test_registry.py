"""The registry's tables: what hangs on a study in one shuffle, and reads by ranges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from phaseflux.operators import ingest
from phaseflux.sources import adapter, database

SF = "/root/testdata/sf0.001"
SIDES = ("sponsors", "browse_interventions", "browse_conditions", "mesh_terms")


def odd_tables(spark):
    """Studies with and without each kind of row, nulls, repeats, and terms without tree numbers."""
    rng = random.Random(3)
    ids = [f"N{i}" for i in range(40)] + [None]
    pick = lambda *x: rng.choice(x)
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return {
        "sponsors": make([(pick(*ids), pick(None, *range(5)), f"s{rng.randint(0, 9)}", pick("lead", "lead", "collaborator", None)) for _ in range(150)], "nct_id string, id long, name string, lead_or_collaborator string"),
        "browse_interventions": make([(pick(*ids), pick("a", "B", "b c", None)) for _ in range(80)], "nct_id string, mesh_term string"),
        "browse_conditions": make([(pick(*ids), x, x and x.lower()) for _ in range(80) for x in [pick("X", "y", "Z", "none", None)]], "nct_id string, mesh_term string, downcase_mesh_term string"),
        "mesh_terms": make([("x", "C04.1"), ("x", "C04.1"), ("x", "F02"), ("x", "D01"), ("y", "F02"), ("y", None), ("z", "B1"), (None, "C09")], "downcase_mesh_term string, tree_number string"),
    }


def test_sides_equal_the_separate_queries(spark):
    t = odd_tables(spark)
    lead = t["sponsors"].where("lead_or_collaborator = 'lead' AND id IS NOT NULL").groupBy("nct_id").agg(F.min(F.struct("id", "name")).alias("x"))
    wanted = {
        "sponsor": {r.nct_id: r.x.name for r in lead.collect()},
        "mesh_drug_terms": {r.nct_id: r.terms for r in ingest.term_sets(t["browse_interventions"], "nct_id", "mesh_term").collect()},
        "mesh_condition_terms": {r.nct_id: r.terms for r in ingest.term_sets(t["browse_conditions"], "nct_id", "mesh_term").collect()},
        "trees": {r.nct_id: r.terms for r in ingest.tree_numbers(t["browse_conditions"], t["mesh_terms"]).collect()},
    }
    got = ingest.sides(t).collect()
    assert len(got) == len({r.nct_id for r in got})
    for name, want in wanted.items():
        assert {r.nct_id: r[name] for r in got if r[name]} == want, name
    empty = {k: v.where("false") for k, v in t.items()}
    assert ingest.sides(empty).count() == 0


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition)", plan)


def test_sides_are_shuffled_once(spark, tmp_path):
    """By study one exchange for all side tables, and each is read once, even where nothing is small enough to be broadcast."""
    for name, frame in adapter.registry(spark, SF).items():
        frame.write.parquet(str(tmp_path / name))
    t = {name: spark.read.parquet(str(tmp_path / name)) for name in (*database.TABLES,)}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        by_study = [x for x in exchanges(ingest.sides(t)) if "nct_id" in x]
        assert len(by_study) == 1
        whole = ingest.scan(t)
        assert len([x for x in exchanges(whole) if "nct_id" in x]) == 4  # studies, drugs, conditions, all that hangs on them
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 7  # every table but the summaries, once
    finally:
        for k in settings:
            spark.conf.unset(k)


@pytest.mark.parametrize("low, high, n", [("NCT00000001", "NCT00000009", 4), ("NCT00000000", "NCT99999999", 7), ("N1", "N1", 3), ("N1", "N2", 5), ("O'B01", "O'B99", 3), ("N1", "N10", 3), ("a", "b", 3), (None, None, 3), ("N1", "M2", 2), ("5", "9", 2)])
def test_ranges_hold_every_key_once(spark, low, high, n):
    parts = database.ranges("k", low, high, n)
    assert 1 <= len(parts) <= n
    digits = re.fullmatch(r"(.*?)(\d+)", low or "")
    keys = [low, high, None, "", "zz", "NCT00000005", "NCT5", "nct00000003", *([f"{digits[1]}{i:0{len(digits[2])}d}" for i in range(int(digits[2]), min(int(digits[2]) + 20, 10 ** len(digits[2])))] if digits else [])]
    frame = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "k string")
    met = frame.select(sum((F.coalesce(F.expr(f"({p})"), F.lit(False))).cast("int") for p in (x.replace("''", "\\'") for x in parts)).alias("n"))
    assert {r.n for r in met.collect()} == {1}


def test_tables_are_read_by_ranges(spark, caplog):
    config = database.Config(url="jdbc:derby:memory:ranges;create=true")
    t = adapter.registry(spark, SF)
    t = {n: t[n].dropna(subset=[c for c, kind in t[n].dtypes if kind == "string"]) for n in database.TABLES}  # Spark writes null texts as large objects
    for name in database.TABLES:  # Derby keeps names without quotes in capitals
        frame = t[name].select(*(F.col(c).alias(c.upper()) for c in t[name].columns))
        frame.write.format("jdbc").options(url=config.url, dbtable=name, createTableColumnTypes=", ".join(f"{c.upper()} VARCHAR(200)" for c, kind in t[name].dtypes if kind == "string")).save()
    studies = database.table(spark, "studies", config, rows=100)
    count = t["studies"].count()
    assert studies.rdd.getNumPartitions() == -(-count // 100) > 5
    sizes = [r["count"] for r in studies.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == count and max(sizes) < 2 * count / len(sizes) + 10 and len(sizes) == studies.rdd.getNumPartitions()
    assert sorted(map(tuple, studies.select("NCT_ID", "STUDY_TYPE").collect())) == sorted(map(tuple, t["studies"].select("nct_id", "study_type").collect()))
    pushed = studies.where("study_type = 'Observational'").select("nct_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(STUDY_TYPE,Observational)" in pushed and "ReadSchema: struct<NCT_ID:string>" in pushed
    assert database.table(spark, "studies", config).rdd.getNumPartitions() == 1  # not worth a second connection
    assert database.table(spark, "studies", config, rows=1, connections=3).rdd.getNumPartitions() == 3
    assert database.table(spark, "mesh_terms", config, rows=1).rdd.getNumPartitions() == 1  # no key
    assert "" == caplog.text
    assert database.table(spark, "studies", config, key="brief_title", rows=100).rdd.getNumPartitions() < 5 or "no even ranges" in caplog.text
    # the whole scan is the same as over files
    got = ingest.scan({n: database.table(spark, n, config, rows=100) for n in database.TABLES})
    plain = ingest.scan({n: t[n] for n in database.TABLES})
    shown = lambda x: sorted(map(str, x.select("nct_id", "intervention", "indication", "sponsor", "mesh_drug_terms", "mesh_condition_terms", "trees").collect()))
    assert shown(got) == shown(plain) and len(shown(got)) > 1000
    with pytest.raises(RuntimeError):
        database.table(spark, "nothing", config)

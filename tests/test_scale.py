"""What work grows with: replies are read once for each request, kept frames hold packed columns."""

import pytest

from pyspark.sql import functions as F

from phaseflux.functions import text as texts
from phaseflux.functions import vocab
from phaseflux.operators import label, membership, numbering
from phaseflux.plans import catalog, labels, reports  # noqa: F401  the last two add their queries to the catalogue
from phaseflux.sources import adapter, shared

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_reply_is_read_before_its_members_become_rows(spark):
    reply = '[{"candidate_index": 2, "drug_modality": "mrna"}, {"candidate_index": 1, "drug_modality": "peptide"}, {"candidate_index": 2, "drug_modality": "vaccine"}]'
    answers = spark.createDataFrame([([(1, "a"), (2, "b"), (3, "c")], reply), ([(1, "d")], None)], "members array<struct<candidate_index:int,id:string>>, reply string")
    got = label.parsed(shared.kept(answers), label.classification(), "id")
    assert sorted((r.id, r.modality) for r in got.collect()) == [("a", "peptide"), ("b", "vaccine")]  # the last of repeated indexes; no item is no row
    above, below = plan(got).split("Generate explode", 1)
    assert "from_json" not in above and "Python" not in above and "from_json" in below


def test_a_kept_frame_is_read_by_its_columns(spark):
    rows = shared.kept(spark.range(10).selectExpr("id", "repeat('x', 1000) AS text"))
    assert "ReadSchema: struct<id:bigint>" in plan(rows.select("id")) and rows.selectExpr("sum(length(text))").first()[0] == 10_000


@pytest.fixture
def unbroadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_items_are_shuffled_by_order_and_by_part_alone(spark, unbroadcast, monkeypatch):
    monkeypatch.setattr(adapter, "_SPLIT", 0, raising=False)  # the table counts as a large one
    text = plan(adapter.trials(spark, SF))
    moved = [x for x in text.split("Exchange ")[1:] if x.startswith("hashpartitioning(")]
    assert "REPARTITION" not in text and len(moved) == 8  # both sides of four joins


def test_values_are_gathered_from_counted_rows(spark, unbroadcast):
    """One row for a trial, not one for each of its values."""
    rows = shared.kept(catalog.trials(spark, SF))
    text = plan(membership.clustered(rows).candidates)
    assert "Generate" not in text and text.count("Exchange hashpartitioning(") == 3


def test_candidates_without_values(spark, unbroadcast):
    rows = shared.kept(catalog.trials(spark, SF).select(*membership.COLUMNS, "intervention", "indication", "start_date", "completion_date", "p_value"))
    got = membership.clustered(rows, values=False)
    assert plan(got.candidates).count("Exchange hashpartitioning(") == 1 and not {"sponsors", "trees", "mesh_drug"} & set(got.candidates.columns)
    merged, whole = (membership.remerged(x._replace(candidates=catalog.numbered(x.candidates))) for x in (got, membership.clustered(shared.kept(catalog.trials(spark, SF)))))
    assert sorted(map(tuple, merged.members.collect())) == sorted(map(tuple, whole.members.collect()))


def test_plain_names_take_no_replacement(spark):
    names = ["large ring 7", "NATION_3", "", " a", "a ", "a  b", "a\tb", "Sodium x", "x sodiumy", "a b", "É  b", "a\n", "İ hcl", " x", None]
    rows = spark.createDataFrame([(x,) for x in names], "name string")
    got = rows.select("name", texts.cluster_key(F.col("name")).alias("a"), texts.match_key(F.col("name")).alias("plain"), texts.strip(F.regexp_replace(texts.match_key(F.col("name")), rf"(?U)\b({'|'.join(vocab.SALTS)})\b", "")).alias("b"))
    assert all(r.a == r.b for r in got.collect()) and "RLIKE(lower(name" in plan(rows.select(texts.cluster_key(F.col("name"))))


def test_the_view_is_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    for before, after in (("65535", "8000"), ("4000", "4000")):
        spark.conf.set(name, before)
        adapter.trials(spark, SF)
        assert spark.conf.get(name) == after
    spark.conf.set(name, "8000")


def test_tasks_of_the_view_are_bounded(spark):
    """Neither a broadcast of packed line items nor a task of many packed rows: tables this small would pass any size check."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    for value, after in (("64MB", "16777216"), ("8m", "8m")):
        spark.conf.set(name, value)
        text = plan(adapter.trials(spark, SF))
        assert spark.conf.get(name) == after and text.count("SortMergeJoin") == 1
    spark.conf.set(name, before)


def test_candidates_are_dealt_as_rows(spark, unbroadcast):
    """Nothing is gathered before the rows of a candidate meet, and what a query does not use is not shuffled."""
    dealt = plan(catalog.cands(spark, SF, ids=False).select("candidate_id", "sponsors", "disease_area")).split("REPARTITION_BY_COL", 1)
    assert len(dealt) == 2 and "Aggregate" not in dealt[1] and "Aggregate" in dealt[0]
    assert not any(f"AS {x}#" in dealt[1] for x in ("nct_id", "approval_date", "market_date", "p_value", "outcome", "trees"))


@pytest.mark.parametrize(("name", "times"), [("p18_fields", 1), ("a34_metadata", 0), ("g9_bubbles", 0)])
def test_the_view_is_read_once(spark, name, times):
    """Once by the query, or once while a frame is kept that the query then reads."""
    assert plan(catalog.QUERIES[name](spark, SF)).count("lineitem.parquet") == times


def test_start_years_are_read_from_a_kept_frame(spark):
    assert "lineitem.parquet" not in plan(catalog.QUERIES["g3_default_periods"](spark, SF))


def test_plain_texts_are_not_searched_for_white_space(spark):
    """Two characters tell that nothing is to be stripped, and a reply without a fence is not searched for one."""
    names = ["a", "a b", "", " ", " a", "a ", " a ", "é", "é ", "\x1ca", "a\x85", "~a!", None]
    rows = spark.createDataFrame([(x,) for x in names], "name string")
    got = rows.select(texts.strip(F.col("name")).alias("a"), F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert all(r.a == r.b for r in got) and "ascii(name" in plan(rows.select(texts.strip(F.col("name"))))
    replies = [' [{"candidate_index": 1}]\n', '```json\n[{"candidate_index": 1}]\n``` ', 'x ```[{"candidate_index": 1}]```']
    rows = spark.createDataFrame([(x,) for x in replies], "reply string")
    assert [len(r[0]) for r in rows.select(texts.reply(F.col("reply"))).collect()] == [1, 1, 1]
    assert "Contains(" in plan(rows.select(texts.reply(F.col("reply"))))


def test_the_funnel_deals_rows_by_study(spark, unbroadcast):
    """Lists are made where the rows of a study meet, and contributions are summed by labels before they are dealt to strata."""
    above, below = plan(catalog.QUERIES["a8_funnel"](spark, SF)).split("REPARTITION_BY_COL", 1)
    assert "collect_list" in above and "collect_list" not in below and "labels" in above


def test_labels_meet_by_shuffles(spark, monkeypatch):
    """Tables this small pass any size check, as packed files of millions of candidates do; what is kept on the way counts as well."""
    plans = []
    for module in (label, numbering):
        monkeypatch.setattr(module, "kept", lambda frame: plans.append(plan(frame)) or shared.kept(frame))
    rows = labels._parts(spark, SF)
    failures = rows.where("candidate_id % 10 = 3").select("candidate_id", F.lit("Failed Phase 2").alias("outcome"), F.lit(1.0).alias("confidence"))
    outcomes = label.adjudicate(rows, labels._outcome_cache(rows), labels._judge(False), labels._judge(True), F.lit(1), failures)
    none = spark.createDataFrame([], "cache_key string, modality string, disease_area string, modality_confidence double, disease_confidence double, reasoning string, created_at int")
    classes = label.classify(rows, none, catalog._answer(False), catalog._answer(True), F.lit(1))
    plans += [plan(x) for got in (outcomes, classes) for x in (got.labels, got.entries, got.cache)]
    assert sum("SortMergeJoin" in x for x in plans) > 6 and not any("Broadcast" in x for x in plans)


def test_membership_sends_little_of_a_trial(spark, monkeypatch):
    """What is known of a trial beside its names and its order is not sent, and members go to the merged candidates' ids once."""
    plans, write = [], shared.kept
    for module in (shared, membership):
        monkeypatch.setattr(module, "kept", lambda frame: plans.append(plan(frame)) or write(frame), raising=False)
    plans.append(plan(catalog.QUERIES["j11_membership"](spark, SF)))
    assert len(plans) == 4 and not any(x in "".join(plans) for x in ("l_discount", "o_orderpriority", "p_value", "earliest_start"))
    assert plans[2].count("SortMergeJoin") == 2 and not any("Broadcast" in x for x in plans[2:])

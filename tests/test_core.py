"""Literal expectations, edge cases, and queries against their SQL on the smallest tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from phaseflux.functions import stats, text
from phaseflux.operators import cluster, evaluate, funnel, ingest, label, report
from phaseflux.plans import catalog
from phaseflux.sources import readers, sinks

SF = "/root/testdata/sf0.001"
CANDS = "candidate_id string, modality string, disease_area string, highest_phase string, outcome string, approval_date date, market_date date"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [(" phase 1 ", "Phase 1"), ("Phase 1/Phase 2", "Phase 2"), ("PHASE1/PHASE2", "Unknown"), ("EARLY_PHASE1", "Unknown"), ("na", "N/A"), (None, "Unknown"), ("", "Unknown")])
def test_phase(spark, raw, want):
    assert one(spark, raw, text.phase) == want


@pytest.mark.parametrize(("raw", "want"), [("Suspended", "Active, not recruiting"), ("not yet recruiting", "Recruiting"), ("NOT_YET_RECRUITING", "Unknown"), (None, "Unknown")])
def test_status(spark, raw, want):
    assert one(spark, raw, text.status) == want


@pytest.mark.parametrize(("raw", "want"), [("  Drug  Sodium  X ", "drug  x"), ("Aspirin HCl", "aspirin"), ("a b", "a b")])
def test_cluster_key(spark, raw, want):
    assert one(spark, raw, text.cluster_key) == want


@pytest.mark.parametrize(("raw", "want"), [("Placebo", ""), ("177 Lu-PSMA (test) II", "177lu psma 2"), ("Café IV tablet", "cafe"), (None, ""), ("A/B 'c'", "a b c")])
def test_canonical_drug(spark, raw, want):
    assert one(spark, raw, text.canonical_drug) == want


@pytest.mark.parametrize(("trees", "want"), [(["C04.588.180", "C04.588.443", "C18.452"], "oncology"), (["C04.1", "C18.2"], None), (["C05.1", "C17.2"], "other"), ([], None), (None, None)])
def test_area_vote(spark, trees, want):
    assert one(spark, trees, text.area_vote, "array<string>") == want


def test_reply(spark):
    good = '[{"candidate_index": 1, "drug_modality": "adc"}, {"candidate_index": "x"}]'
    for raw in (good, f"```json\n{good}\n```", f"Here [is it]: {good}"):
        assert [x["candidate_index"] for x in one(spark, raw, text.reply)] == [1]
    for raw in ("{}", "nothing", "", None, "[broken"):
        assert one(spark, raw, text.reply) == []


def test_iso_date(spark):
    raws = ["2020-02-03", "20200203", "2021-W01-1", "2021W011", "2021-W01", "2021W01", "2020-W53-7", "2021-W53-1", "2021-W00-1", "2021-W01-8", "2021-W011", "2021W01-1", "2020", "2020-1-1", "2020-13-01", "20201301", "2021-001", " 2021-01-01", "2021-01-01T00:00", "0000-W01-1", None]

    def python(raw):
        try:
            return dt.date.fromisoformat(raw)
        except (ValueError, TypeError):
            return None

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, x string").select("i", text.iso_date(F.col("x")).alias("d")).collect()
    assert {raws[r.i]: r.d for r in rows} == {x: python(x) for x in raws}


def test_wilson(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(6), F.lit(10))).first()
    assert math.isclose(low, 0.3126737, abs_tol=1e-6) and math.isclose(high, 0.8318197, abs_tol=1e-6)
    assert spark.range(1).select(*stats.wilson(F.lit(0), F.lit(0))).first() == (None, None)


def test_funnel_resolves_missing_outcomes(spark):
    rows = [("a", "peptide", "oncology", "Phase 2", "Approved", None, None), ("b", "peptide", "", "Phase 1", "Failed Phase 1", None, None), ("c", None, "oncology", "Phase 3", "Ongoing", None, None), ("d", "adc", "oncology", "Phase 4", None, None, None), ("e", "adc", "other", "Phase 1", None, None, None)]
    got = {(r.stratum, r.modality, r.disease_area, r.from_phase): (r.numerator, r.denominator, r.candidate_count) for r in funnel.funnel(spark.createDataFrame(rows, CANDS)).collect()}
    assert got["overall", None, None, "Phase 1"] == (1, 3, 5)
    assert got["overall", None, None, "Phase 3"] == (1, 1, 5)
    assert got["modality", "adc", None, "Phase 1"] == (0, 1, 2)
    assert not any(k[2] == "" or k[0] == "modality" and k[1] is None for k in got)


def test_funnel_of_nothing_is_four_zero_rows(spark):
    got = funnel.funnel(spark.createDataFrame([], CANDS)).collect()
    assert [(r.stratum, r.numerator, r.denominator, r.rate) for r in got] == [("overall", 0, 0, 0.0)] * 4


def test_transition_excludes_missing_outcomes(spark):
    rows = spark.createDataFrame([("x", "Phase 1", None), ("x", "Phase 2", "Failed Phase 2")], "area string, highest_phase string, outcome string")
    assert {(r.from_phase): r.denominator for r in funnel.transition(rows, ["area"]).collect()}["Phase 1"] == 1


def test_loa_is_the_product_of_later_rates(spark):
    rows = [("s", "Phase 1", 0.5, 2), ("s", "Phase 2", 0.3, 2), ("s", "Phase 3", 0.6, 2), ("s", "Approval", 0.9, 2)]
    r = funnel.loa(spark.createDataFrame(rows, "s string, from_phase string, rate double, denominator long"), ["s"]).first()
    assert math.isclose(r.loa_1, 0.081) and r.loa_4 == 0.9 and r.loa_market == 1.0


def test_rebucket_weighs_durations(spark):
    rows = [("dermatology", "Approval", "Market", 10, 5, 10, 2.0), ("other", "Approval", "Market", 20, 15, 20, 3.0), ("unknown", "Approval", "Market", 1, 0, 7, None)]
    r = funnel.rebucketed(spark.createDataFrame(rows, "disease_area string, from_phase string, to_phase string, candidate_count long, numerator long, denominator long, avg_duration_years double")).first()
    assert (r.numerator, r.denominator, r.candidate_count) == (20, 37, 31) and math.isclose(r.avg_duration_years, 80 / 30)


def test_arms_count_null_as_a_value(spark):
    rows = [("n1", "a", "x"), ("n1", None, "x"), ("n2", "a", "x"), ("", "a", "x"), (None, "a", "x")]
    got = {r.nct_id: r.is_single_arm for r in ingest.arms(spark.createDataFrame(rows, "nct_id string, intervention string, indication string")).collect()}
    assert got == {"n1": False, "n2": True}


def test_best_row_and_two_levels(spark):
    lookup = spark.createDataFrame([("1", "insulin", None, 0), ("2", "insulin", "peptide", 1), ("3", "insulin human", "peptide", 2)], "drug_id string, query_norm string, modality string, pos int")
    best = readers.best_rows(lookup, "query_norm", "pos").drop("pos")
    names = spark.createDataFrame([("insulin human",), ("insulin lispro",), ("",), ("x",)], "norm string")
    assert {r.norm: (r.drug_id, r.match) for r in cluster.two_level(names, best).collect()} == {"insulin human": ("3", "exact"), "insulin lispro": ("2", "first_word"), "": (None, "none"), "x": (None, "none")}


def test_ledger_price(spark):
    row = spark.createDataFrame([("s", "tier1", 100_000, 500_000, 400_000, 200_000, 0)], "stage string, model string, input_tokens long, cache_write long, cache_read long, output_tokens long, n_candidates long")
    r = label.ledger(row).first()
    assert math.isclose(r.cost, 5.295) and r.cost_each is None


def test_tiers_fall_back(spark):
    rows = spark.createDataFrame([(str(i), f"d {i}", "x") for i in range(120)], "candidate_id string, drug_name_raw string, indication string")

    def broken(system, prompt):
        raise RuntimeError

    task = label.classification()
    got = label.tiered(rows, task, broken, lambda system, prompt: "no json").labels.collect()
    assert len(got) == 120 and {(r.modality, r.modality_confidence) for r in got} == {("unknown", 0.0)}
    run = label.tiered(rows, task, broken, catalog._answer(True))
    assert {r.modality for r in run.labels.collect()} == {"peptide", "vaccine"}
    assert [(r.model, r.n_candidates) for r in run.entries.orderBy("n_candidates").collect()] == [("tier2", 20), ("tier2", 50), ("tier2", 50)]
    assert label.classify_one(spark, "d 7", "x", broken, catalog._answer(True))["modality"] == "peptide"


def test_no_request_is_sent_twice(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"d {i}", "x") for i in range(60)], "candidate_id string, drug_name_raw string, indication string")
    answer, folder = catalog._answer(True), str(tmp_path)

    def counted(system, prompt):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).touch()
        return answer(system, prompt)

    run = label.tiered(rows, label.classification(), counted, lambda system, prompt: None)
    for _ in range(3):
        assert run.labels.count() == 60
    assert len(list(tmp_path.iterdir())) == 2


def test_second_tier_without_answer_keeps_the_first(spark):
    rows = spark.createDataFrame([("1", "d 10", "x"), ("2", "d 3", "x")], "candidate_id string, drug_name_raw string, indication string")
    got = {r.candidate_id: (r.modality, r.modality_confidence) for r in label.tiered(rows, label.classification(), catalog._answer(False), lambda system, prompt: "[]").labels.collect()}
    assert got == {"1": ("vaccine", 0.25), "2": ("unknown", 0.0)}


def test_milestone_is_before_the_day(spark):
    row = spark.createDataFrame([(dt.date(2030, 1, 1), dt.date(2019, 5, 1), None)], "a date, b date, c date")
    assert row.select(report.milestone(["a", "b", "c"], dt.date(2020, 1, 1))).first()[0] == dt.date(2019, 5, 1)


def test_metrics_cascade(spark):
    rows = spark.createDataFrame([("commercialized", "approved"), ("approved", "commercialized"), ("investigational", None)], "truth string, predicted string")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in evaluate.metrics(rows).collect()}
    assert got == {"investigational": (0, 0, 0), "approved": (2, 0, 0), "commercialized": (0, 1, 1)}


def test_replies(spark, tmp_path):
    (tmp_path / "a.txt").write_text('[{"x": "1"}, {"x": "2"}]')
    (tmp_path / "b.txt").write_text('{"x": "3"}\n\n{"x": "4"}\n')
    assert [r["item"]["x"] for r in readers.replies(spark, str(tmp_path / "*.txt")).orderBy("file", "at").collect()] == ["1", "2", "3", "4"]


def test_sinks(tmp_path):
    rows = [{"a": 1, "b": None}, {"a": 0.5, "b": "<x>"}]
    sinks.write_csv(rows, tmp_path / "a.csv")
    assert (tmp_path / "a.csv").read_text() == "a,b\n1,\n0.5,<x>\n"
    sinks.write_xlsx({"t" * 40: rows}, tmp_path / "a.xlsx")
    sinks.write_html("T", [("h", "t", rows)], tmp_path / "a.html")
    assert "&lt;x&gt;" in (tmp_path / "a.html").read_text() and "—" in (tmp_path / "a.html").read_text()


def test_sources(spark):
    with pytest.raises(NotImplementedError):
        readers.source(spark, "api")
    with pytest.raises(ValueError):
        readers.source(spark, "x")


def test_cache_stream(spark, tmp_path):
    from phaseflux.streaming import keep_cache

    schema = "cache_key string, disease_area string, created_at long"
    for i, part in enumerate(([("a", "x", 1), ("b", "y", 1)], [("a", "z", 2)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keep_cache(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.cache_key: r.disease_area for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()} == {"a": "z", "b": "y"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(x[0] for x in want.description)
    frame = __spark_entry__.queries()[name](spark, SF)
    assert sorted(frame.columns) == names
    order = [x[0] for x in want.description]
    show = lambda v: "~" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(show(r[order.index(n)]) for n in names) for r in want.fetchall())
    assert sorted(tuple(show(r[n]) for n in names) for r in frame.collect()) == rows


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Registry, files, labelling stages and the report as a whole."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from phaseflux.functions import vocab
from phaseflux.operators import cluster, evaluate, funnel, ingest, report
from phaseflux.plans import catalog
from phaseflux.reporting import COMPONENTS, Component, Context, compose, console, narrative, write, write_report
from phaseflux.sources import adapter, database, readers, sinks

SF = "/root/testdata/sf0.001"
DAY = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def context(spark):
    rows = ingest.flagged(catalog.trials(spark, SF))
    return Context(cluster.candidates(rows).persist(), funnel.of_trials(rows), DAY, periods=catalog.PERIODS)


def test_report_has_every_part(context, tmp_path):
    made = compose(context)
    assert [k for k, _, _ in made.sections] == ["spider", "disease_breakdown", "heatmaps", "bubble_heatmaps", "loa", "oncology", "timeline", "time_period", "modality_trend", "sponsor", "candidate_summary"]
    assert len(COMPONENTS) == 12 and all(isinstance(c, Component) for c in COMPONENTS)
    assert {"overall_spider", "disease_breakdown", "modality_breakdown", "modality_heatmap", "disease_heatmap_all", "disease_heatmap", "phase1_by_disease", "phase2_by_disease", "phase3_by_disease", "loa_by_disease", "loa_by_modality", "oncology_comparison", "timeline_by_disease", "time_period_comparison", "modality_proportion", "sponsor_concentration"} <= set(made.figures)
    assert all(v.startswith("<svg") for v in made.figures.values())
    assert set(made.html_figures) == {"modality_bubble_heatmap", "disease_bubble_heatmap", "modality_proportion"}
    assert set(made.tables) == {"funnel_by_disease", "funnel_by_modality", "loa_by_disease", "loa_by_modality", "oncology_comparison", "time_period_loa", "modality_proportion", "sponsor_concentration"}
    assert made.tables["loa_by_disease"][-1]["stratum"] == "All indications"
    write_report(made, str(tmp_path), DAY, ("html", "excel"))
    assert {x.name for x in tmp_path.iterdir()} == {"index.html", "candidate_summary.csv", "heatmap_data.xlsx", "report.xlsx"}
    page = (tmp_path / "index.html").read_text()
    assert "{{" not in page and "Figure 1:" in page and "Table 1:" in page and all(x in page for x in write.PARTS.values()) and page.count("<h3") == 11
    lines = (tmp_path / "candidate_summary.csv").read_text().splitlines()
    assert lines[0] == "candidate_id,drug_name,indication,highest_phase,modality,disease_area,outcome,latest_milestone_date,p_value_inconsistent" and len(lines) == context.cands.count() + 1
    book = zipfile.ZipFile(tmp_path / "heatmap_data.xlsx")
    names = book.read("xl/workbook.xml").decode()
    assert all(f'name="{x}"' in names for x in ("Modality Heatmap", "Disease Heatmap", "Modality - Oncology", "Disease - peptide", "LOA by Disease", "LOA by Modality", "Oncology vs Non-Oncology", "Development Timelines", "Time Period LOA", "Modality Proportion", "Sponsor Concentration"))
    assert "P1→P2 CI High" in book.read("xl/worksheets/s0.xml").decode()
    write.write_interactive(made, str(tmp_path))
    assert "Modality Bubble Heatmap" in (tmp_path / "interactive_heatmaps.html").read_text()
    write_report(made, str(tmp_path), DAY, sections=False)
    assert "Pipeline Report" in (tmp_path / "index.html").read_text()
    with pytest.raises(ValueError):
        write_report(made, str(tmp_path), DAY, ("pdf",))


def test_peptide_report(context):
    own = Context(context.cands, context.funnel, DAY, peptide_only=True)
    made = compose(own)
    assert [k for k, _, _ in made.sections] == ["spider", "disease_breakdown", "candidate_summary"]
    assert {r.modality for r in made.summary.select("modality").distinct().collect()} == {"peptide"}
    assert "peptide candidates" in made.introduction and len(made.executive) == 2


def test_report_of_nothing(spark, context, tmp_path):
    empty = context.cands.limit(0)
    made = compose(Context(empty, funnel.funnel(empty), DAY))
    assert made.tables["funnel_by_disease"] == [] and "the period studied" in made.introduction
    write_report(made, str(tmp_path), DAY)
    assert not (tmp_path / "candidate_summary.csv").exists() and (tmp_path / "index.html").exists()


def test_fold_words():
    assert [narrative.fold(a, b) for a, b in ((1, 0), (5, 2), (1.9, 1), (1.3, 1), (1.1, 1), (1, 1), (0.8, 1), (0.1, 1))] == [vocab.INFINITE, "2-fold higher than", "nearly 2-fold higher than", *(w for _, w in vocab.FOLDS), vocab.FEWEST]


def test_narratives_of_known_rows():
    steps = [{"from_phase": p, "to_phase": "", "numerator": 1, "denominator": d, "rate": r, "avg_duration_years": y, "area": "A"} for p, d, r, y in (("Phase 1", 10, 0.5, 1.0), ("Phase 2", 5, 0.2, 2.5), ("Phase 3", 0, 0.0, None), ("Approval", 1, 1.0, None))]
    text = narrative.overall_success(steps)
    assert "Phase 1: 50.0% advanced (n=10)." in text and "Phase 3" not in text
    words = narrative.timeline(steps, steps, [{"from_phase": "Phase 2", "shortest": "A", "shortest_years": 2.5, "longest": "B", "longest_years": 4.0}])
    assert "3.5 years" in words and "In Phase 2, B takes the longest, 4.0 years (mean 2.5)." in words
    moved = [{"kind": "decline", "area": "A", "loa_first": 0.5, "loa_last": 0.25}]
    assert "Areas in decline: A (50.0% → 25.0%)" in narrative.periods(["a", "b"], 3, {"a": 0.5, "b": 0.25}, moved)
    assert narrative.periods(["a"], 0, {}, []) == "" and narrative.sponsor([], {"uniques": 0}) == ""


def test_default_periods():
    today = dt.date(2026, 5, 1)
    assert report.default_periods({2012: 1, 2018: 5}, today) == [(2012, 2016), (2017, 2018)]
    assert report.default_periods({2018: 1, 2019: 1, 2020: 1, 2021: 1}, today) == [(2018, 2020), (2021, 2021)]
    assert report.default_periods({}, today) == []


def test_inconsistent_without_phase_p_values(spark):
    """P-values of another phase only: not missing, and no contradiction."""
    rows = spark.createDataFrame([("Failed Phase 1", None, None, None, True), ("Failed Phase 2", None, 0.01, None, True), ("Approved", None, None, 0.2, True), ("Approved", None, None, None, False), (None, 0.01, None, None, True)], "outcome string, p_1 double, p_2 double, p_3 double, has_p boolean")
    flag = report.inconsistent(F.col("outcome"), {i: F.col(f"p_{i}") for i in (1, 2, 3)}, F.col("has_p"))
    assert [r[0] for r in rows.select(flag).collect()] == [False, True, True, None, False]


def test_funnel_durations_use_all_rows_of_a_study(spark):
    cands = spark.createDataFrame([("a", "peptide", "oncology", "Phase 2", "Approved", dt.date(2010, 1, 1), dt.date(2011, 1, 1), ["n1", "n1"]), ("b", None, "oncology", "Phase 1", "Ongoing", None, None, ["n2"])], "candidate_id string, modality string, disease_area string, highest_phase string, outcome string, approval_date date, market_date date, trial_ids array<string>")
    d = dt.date
    trials = spark.createDataFrame([("n1", "Phase 1", d(2000, 1, 1), d(2001, 1, 1)), ("n1", "Phase 1", d(2000, 1, 1), d(2002, 1, 1)), ("n2", "Phase 1", d(2000, 1, 1), d(2005, 1, 1)), ("n2", "Phase 1", d(2005, 1, 1), d(2000, 1, 1)), ("n9", "Phase 1", d(2000, 1, 1), d(2009, 1, 1))], "nct_id string, phase string, start_date date, completion_date date")
    got = {(r.stratum, r.modality, r.from_phase): (r.avg_duration_years, r.n_durations) for r in funnel.funnel(cands, trials).collect()}
    assert got["modality", "peptide", "Phase 1"] == (pytest.approx((366 + 731) / 2 / 365.25), 2)
    assert got["overall", None, "Phase 1"] == (pytest.approx((366 + 731 + 1827) / 3 / 365.25), 3)
    assert got["overall", None, "Approval"] == (pytest.approx(365 / 365.25), 1) and got["overall", None, "Phase 2"] == (None, 0)


def test_hybrid_keys_use_terms_of_both_sides(spark):
    rows = spark.createDataFrame([("Aspirin HCl", "Pain", ["B ", "a"], ["Z"]), ("Aspirin HCl", "Pain", [], ["z"]), ("Aspirin HCl", "Head  Pain", ["a"], [])], "intervention string, indication string, mesh_drug_terms array<string>, mesh_condition_terms array<string>")
    assert [r[0] for r in rows.select(cluster.hybrid_key()).collect()] == ["a|b__z", "aspirin__z", "a__head pain"]
    assert set(cluster.STRATEGIES) == {"fuzzy", "embeddings", "hybrid"}


def test_database(spark, tmp_path, caplog):
    config = database.Config(url="jdbc:derby:memory:registry;create=true")
    tables = adapter.registry(spark, SF)
    database.execute(spark, "CREATE TABLE studies (nct_id VARCHAR(20), n INT)", config)
    with pytest.raises(RuntimeError):
        database.fetch_all(spark, "SELECT * FROM nothing", config)
    database.execute(spark, "INSERT INTO studies VALUES ('N1', 1), ('N2', NULL)", config)
    assert database.check_connection(spark, config) == {"study_count": 2}
    assert [x["N"] for x in database.fetch_all(spark, "SELECT * FROM studies ORDER BY nct_id", config)] == [1, None]
    assert database.fetch_one(spark, "SELECT * FROM studies WHERE n > 5", config) is None
    with pytest.raises(ValueError):
        database.Config().options()
    with pytest.raises(ValueError):
        database.Config(user="u").options()
    options = database.configured(user="u", password="p", port="99", schema="s").options()
    assert options["url"].startswith("jdbc:postgresql://localhost:99/") and options["sessionInitStatement"] == "SET search_path TO s, public"
    for name in database.TABLES:
        tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = database.fetch(spark, "parquet", path=str(tmp_path), most=7)
    assert rows.count() == 7 and "the cap of 7 rows was met" in caplog.text
    with pytest.raises(NotImplementedError):
        database.fetch(spark, "api")
    with pytest.raises(ValueError):
        database.fetch(spark, "x")


def test_files(spark, tmp_path):
    (tmp_path / "drugs.csv").write_text('drug_id,query_name,query_norm,modality\n1,"Insulin, human",insulin,\n2,Insulin,insulin,peptide\n3,Insulin,insulin,peptide\n')
    by_name, by_norm = readers.drug_lookup(spark, str(tmp_path / "drugs.csv"))
    assert sorted(r.drug_id for r in by_name.collect()) == ["1", "2"] and [r.drug_id for r in by_norm.collect()] == ["2"]
    names = readers.synonym_names(spark, str(tmp_path / "drugs.csv"))
    assert names.columns == ["drug_id", "query_norm", "name"] and names.count() == 3
    (tmp_path / "prompt.txt").write_text("\n say \u00e9 \n", encoding="utf-8")
    assert readers.prompt(str(tmp_path / "prompt.txt")) == "say \u00e9"
    state = str(tmp_path / "deep" / "state.csv")
    assert readers.state(spark, state).count() == 0
    sinks.write_state([{"drug_name": "a", "indication": "b", "approval_label": "positive", "other": 1}], state)
    row = readers.state(spark, state).first()
    assert (row.drug_name, row.approval_label, row.commercialization_label) == ("a", "positive", None) and len(row) == 10
    (tmp_path / "p.csv").write_text("drug_name,indication,outcome\nA,x,Approved\n a ,X,Commercialized\nB,y,odd\n")
    assert {(r.drug, r.predicted) for r in readers.predictions_csv(spark, str(tmp_path / "p.csv")).collect()} == {("a", "commercialized"), ("b", "investigational")}
    assert dict(readers.summary_csv(spark, str(tmp_path / "p.csv")).dtypes)["outcome"] == "string"
    old, new = spark.createDataFrame([("a", 1)], "drug_name string, x int"), spark.createDataFrame([("b", "y")], "drug_name string, weak_label string")
    sinks.write_sample(old, new, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text() == "drug_name,x,weak_label\na,1,\nb,,y\n"


def test_console(spark):
    pairs = spark.createDataFrame([("commercialized", "approved"), ("approved", "approved"), ("investigational", None)], "truth string, predicted string")
    text = console.evaluation(evaluate.metrics(pairs), evaluate.evaluation(pairs), 4)
    assert "2 matched, 4 skipped, 1 unmatched" in text and "macro avg" in text and "3-class accuracy 0.500" in text
    found = spark.createDataFrame([("A", "x", "approved", "approval", "FP")], "drug_name string, indication string, predicted string, task string, error string")
    assert "False positives (1)" in console.errors(found, 2) and "(none)" in console.errors(found, 2)
    kinds = spark.createDataFrame([("drugbank", 1, 3), ("none", 1, 1)], "match string, n_candidates long, n_trial_rows long")
    assert "75.0%" in console.coverage(kinds, 2, 2)
    assert console.progress([{}, {}], 1) == "1/2 labelled, 1 remaining" and console.table([]) == "(none)"

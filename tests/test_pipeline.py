"""The pipeline from the registry's tables to files, and the command line."""

import datetime as dt
import importlib
import sys

import pytest
from pyspark.sql import functions as F

from phaseflux import cli
from phaseflux.pipeline import Config, run
from phaseflux.sources import adapter, cachefiles, database

SF = "/root/testdata/sf0.001"
DAY = dt.date(2001, 1, 1)
MODELS = '''
import json

from phaseflux.operators import label


def answer(system, prompt):
    """Answers both kinds of request by the drug's number."""
    items = []
    for part in prompt.split("\\n\\n")[1:]:
        lines = part.split("\\n")
        number = int("".join(c for c in lines[1] if c.isdigit()) or 0)
        own = {"candidate_index": int(lines[0].strip("[]"))}
        if "modality" in system:
            own |= {"drug_modality": ("peptide", "vaccine", "adc")[number % 3], "disease_area": "oncology", "modality_confidence": "HIGH", "disease_confidence": "HIGH"}
        else:
            own |= {"outcome": ("APPROVED", "FAILED_PHASE_2", "ONGOING")[number % 3], "confidence": "HIGH", "approval_date": "2000-05-05" if number % 3 == 0 else None}
        items.append(own)
    return label.Answer(json.dumps(items), 10, 5)


def silent(system, prompt):
    return None
'''


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    """A module of models that the workers can import."""
    folder = tmp_path_factory.mktemp("models")
    (folder / "stand_in_models.py").write_text(MODELS)
    spark.sparkContext.addPyFile(str(folder / "stand_in_models.py"))
    sys.path.insert(0, str(folder))
    yield importlib.import_module("stand_in_models")
    sys.path.remove(str(folder))


@pytest.fixture(scope="module")
def tables(spark):
    got = adapter.registry(spark, SF)
    got["outcomes"] = got["studies"].select(F.col("nct_id").alias("outcome_id"), "nct_id", F.lit("PRIMARY").alias("outcome_type"))
    got["outcome_analyses"] = got["studies"].select(F.col("nct_id").alias("outcome_id"), "nct_id", F.lit(0.03).alias("p_value"))
    return got


def test_run(spark, tables, models, tmp_path):
    (tmp_path / "drugs.csv").write_text("drug_id,query_name,query_norm,modality\nDB1,Red,red,\nDB2,Blue,blue,\n")
    config = Config(DAY, most=400, drug_lookup=str(tmp_path / "drugs.csv"), drop_unmatched=False, cache=str(tmp_path / "cache"), output=str(tmp_path / "out"), periods=[(1990, 1995), (1996, 2000)])
    got = run(spark, tables, models.answer, models.silent, config)
    assert got.trials.count() == 400 and got.candidates.count() == got.attributes.count() == got.outcomes.count() > 50
    assert {r.modality for r in got.attributes.select("modality").distinct().collect()} <= {"peptide", "vaccine", "adc"}
    assert got.candidates.where("drug_id IS NOT NULL").count() > 0 and {x.name for x in (tmp_path / "out").iterdir()} >= {"index.html", "candidate_summary.csv", "heatmap_data.xlsx"}
    spent = {r.stage: r for r in got.ledger.collect()}
    assert spent["Classification"].asked == got.candidates.count() and spent["Classification"].cost > 0
    # another run finds everything in the cache
    again = run(spark, tables, models.silent, models.silent, config)
    assert sorted(map(str, again.outcomes.collect())) == sorted(map(str, got.outcomes.collect()))
    assert {(r.stage, r.asked, r.cost) for r in again.ledger.collect()} == {("Classification", 0, 0.0), ("Adjudication", 0, 0.0)}
    assert cachefiles.versions(spark, str(tmp_path / "cache" / "adjudication")) == [0, 1]


def test_peptides_only(spark, tables, models):
    got = run(spark, tables, models.answer, models.silent, Config(DAY, most=200, method="fuzzy", peptide_only=True, single_arm_only=True, stopped_fail=True))
    peptides = got.attributes.where("modality = 'peptide'").count()
    assert got.outcomes.count() == peptides < got.attributes.count()
    assert [k for k, _, _ in got.report.sections] == ["spider", "disease_breakdown", "candidate_summary"]


def test_command_line(spark, tables, models, tmp_path):
    for name in (*database.TABLES, "outcomes", "outcome_analyses"):
        tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    text = cli.main(["run", "--source", "parquet", "--path", str(tmp_path), "--as-of", "2001-01-01", "--most", "60", "--tier1", "stand_in_models:answer", "--tier2", "stand_in_models:silent", "--output", str(tmp_path / "out"), "--periods", "1990-1995", "1996-2000"], spark)
    assert "Executive Summary" in text and "Classification" in text and (tmp_path / "out" / "index.html").exists()
    pairs, bench = tmp_path / "pairs.csv", tmp_path / "bench.csv"
    pairs.write_text("drug_name,indication,highest_phase,modality,disease_area,outcome,weak_label\nA,x,Phase 2,,,Approved,\nB,y,,,,Ongoing,\nC,z,,,,Failed Phase 1,\n")
    bench.write_text("drug_name,indication,commercialization_label,approval_label\na,X,positive,positive\nB,y,negative,negative\nC,z,unknown,negative\n")
    (tmp_path / "replies").mkdir()
    (tmp_path / "replies" / "one.txt").write_text('{"outcome": "COMMERCIALIZED"}\n\n{"outcome": "Approved"}\n')
    text = cli.main(["score", "--responses", str(tmp_path / "replies"), "--pairs", str(pairs), "--benchmark", str(bench)], spark)
    assert "2 replies, 3 pairs" in text and "2 matched, 1 skipped, 0 unmatched" in text and "False positives (1)\n    - B" in text
    preds = tmp_path / "preds.csv"
    preds.write_text("drug_name,indication,outcome\nA,x,Commercialized\n")
    assert "1 matched, 1 skipped, 1 unmatched" in cli.main(["validate", "--benchmark", str(bench), "--predictions", str(preds)], spark)
    text = cli.main(["prompts", "--pairs", str(pairs)], spark)
    assert text.startswith("[1] A / x\nDrug name: A") and "Highest phase reached: Unknown" in text and text.endswith("Total: 3 prompts")
    summary = tmp_path / "summary.csv"
    summary.write_text("drug_name,indication,outcome\nA,q,Approved\nD,q,Approved\nE,q,Commercialized\nF,q,Ongoing\nG,q,Failed Phase 1\n")
    cli.main(["sample", "--summary", str(summary), "--pairs", str(pairs), "--number", "Post-Clinical=5", "Clinical=1"], spark)
    lines = pairs.read_text().splitlines()
    assert len(lines) == 7 and {x.split(",")[0] for x in lines[4:]} == {"D", "E", "G"}
    state = tmp_path / "state.csv"
    state.write_text("drug_name,indication,commercialization_label,approval_label,commercialization_evidence,approval_evidence,application_number,drugsatfda_overview_url,sponsor,notes\nA,x,positive,positive,e,,,,,n\n")
    assert cli.main(["label", "--pairs", str(pairs), "--state", str(state)], spark) == "1/6 labelled, 5 remaining"
    assert "A,x,positive,positive,e" in state.read_text()

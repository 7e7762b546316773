"""Stages side by side, and the journal of requests."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from phaseflux import stages
from phaseflux.operators import label
from phaseflux.sources import shared
from phaseflux.sources.journal import SCHEMA, Journal


def test_both_run_at_the_same_time(spark):
    """Each stage's Spark job waits for the other's: one after the other they would never end."""
    gates = {name: threading.Event() for name in "ab"}

    def stage(own, other):
        def work():
            n = spark.range(100).where("id % 2 = 0").count()
            gates[own].set()
            assert gates[other].wait(60)
            return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")

        return work

    ran = stages.run(spark, {"a": stage("a", "b"), "b": stage("b", "a")})
    assert ran.results == {"a": (50, "a"), "b": (50, "b")}
    spans = {r.stage: r for r in ran.spans.collect()}
    assert max(r.began for r in spans.values()) < min(r.ended for r in spans.values()) and not any(r.failed for r in spans.values())
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_in_order(spark):
    seen = []
    ran = stages.run(spark, {"b": lambda: seen.append("b") or spark.range(3).count(), "a": lambda: seen.append("a")}, together=False)
    assert seen == ["b", "a"] and ran.results["b"] == 3
    b, a = ran.spans.orderBy("began").collect()
    assert (b.stage, a.stage) == ("b", "a") and b.ended <= a.began


def test_an_error_reaches_the_caller_and_ends_the_other(spark):
    def slow(rows):
        for part in rows:
            time.sleep(30)
            yield part

    def bad():
        time.sleep(2)
        raise KeyError("lost")

    began = time.time()
    with pytest.raises(KeyError, match="lost"):
        stages.run(spark, {"slow": lambda: spark.range(8).mapInPandas(slow, "id long").count(), "bad": bad})
    assert time.time() - began < 20
    with pytest.raises(KeyError):
        stages.run(spark, {"bad": bad, "never": lambda: pytest.fail("ran after an error")}, together=False)
    assert spark.range(5).count() == 5  # the session goes on


def candidates(spark, n):
    return spark.createDataFrame([(f"{i:04d}", f"drug {i}", "x") for i in range(n)], "candidate_id string, drug_name_raw string, indication string").repartition(2)


def model(folder, dies_at=None):
    """Answers each request, and leaves a file for each call; with `dies_at` the worker dies when so many calls were made."""

    def call(system, prompt):
        if dies_at is not None and len(os.listdir(folder)) >= dies_at:
            os._exit(1)
        with open(os.path.join(folder, f"{time.time_ns()}-{os.getpid()}"), "w") as file:
            file.write(prompt)
        items = [{"candidate_index": i + 1, "drug_modality": "peptide", "disease_area": "oncology", "modality_confidence": "HIGH", "disease_confidence": "HIGH"} for i in range(prompt.count("Drug name"))]
        return label.Answer(json.dumps(items), 10, 5)

    return call


def _others():
    """Models as local functions, as workers can't import this module."""

    def silent(system, prompt):
        return None

    def refuses(system, prompt):
        raise RuntimeError("no request should be sent")

    return silent, refuses


silent, refuses = _others()


def test_a_task_that_dies_loses_no_answer(spark, tmp_path):
    calls, book = tmp_path / "calls", Journal(str(tmp_path / "journal"))
    calls.mkdir()
    rows, task = candidates(spark, 400), label.classification()
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        label.tiered(rows, task, model(str(calls), dies_at=40), refuses, size=8, book=book)
    sent = len(os.listdir(calls))
    assert 40 <= sent <= 44 and book.answers(spark).count() == sent  # each call that was made is on disk
    got = label.tiered(rows, task, model(str(calls)), refuses, size=8, book=book)
    assert len(os.listdir(calls)) == 50  # 400 candidates in requests of 8: each was sent once
    assert got.labels.where("modality = 'peptide'").count() == 400
    spent = label.ledger(got.entries).first()
    assert (spent.asked, spent.cache_hits, spent.input_tokens) == ((50 - sent) * 8, sent * 8, (50 - sent) * 10)
    prompts = {(calls / x).read_text() for x in os.listdir(calls)}
    assert len(prompts) == 50
    # sealed, the answers are the same and nothing is sent
    want = sorted(map(str, book.answers(spark).collect()))
    book.seal(spark)
    assert not (tmp_path / "journal" / "open").exists() and sorted(map(str, book.answers(spark).collect())) == want
    again = label.tiered(rows, task, refuses, refuses, size=8, book=book)
    assert sorted(map(str, again.labels.collect())) == sorted(map(str, got.labels.collect()))
    assert label.ledger(again.entries).first().cost == 0.0


def test_a_task_that_runs_again_asks_only_what_is_missing(spark, tmp_path):
    """What Spark does when an executor is lost: the same task, with the plan of the first attempt."""
    calls, book = tmp_path / "calls", Journal(f"file://{tmp_path}/journal")
    calls.mkdir()
    sent = label.requests(candidates(spark, 60), label.classification(), "candidate_id", 10).withColumn("request", F.sha2("prompt", 256))
    asked = label.ask(shared.kept(sent), model(str(calls)), "system", book)
    assert asked.count() == asked.count() == 6 and len(os.listdir(calls)) == 6


def test_failed_calls_are_sent_again(spark, tmp_path):
    calls, book = tmp_path / "calls", Journal(str(tmp_path / "journal"))
    calls.mkdir()
    rows, task = candidates(spark, 20), label.classification()
    assert label.tiered(rows, task, silent, refuses, book=book).labels.where("modality = 'unknown'").count() == 20
    assert book.answers(spark).count() == 0
    assert label.tiered(rows, task, silent, model(str(calls)), book=book).labels.where("modality = 'peptide'").count() == 20
    assert len(os.listdir(calls)) == 1 and book.answers(spark).count() == 1  # tiers are told apart: the first one's answer is still open


def test_journal_without_a_folder(spark, tmp_path):
    book = Journal(str(tmp_path / "none"))
    assert book.answers(spark).collect() == [] and book.answers(spark).schema == spark.createDataFrame([], SCHEMA).schema
    book.seal(spark)
    assert book.get("ab" * 32) is None
    book.put("ab" * 32, label.Answer("é [\n]", 1)._asdict())
    book.seal(spark)
    book.put("ab" * 32, label.Answer("é [\n]", 1)._asdict())  # a run that did not know of the first
    assert [r.reply for r in book.answers(spark).collect()] == ["é [\n]"]


def test_a_task_keeps_one_file_of_its_answers(spark, tmp_path):
    """Files are as many as tasks, not as requests; a line that was cut off is no answer."""
    calls, path = tmp_path / "calls", tmp_path / "journal"
    calls.mkdir()
    sent = shared.kept(label.requests(candidates(spark, 300), label.classification(), "candidate_id", 10).withColumn("request", F.sha2("prompt", 256)).coalesce(1))
    book = Journal(str(path))
    assert label.ask(sent, model(str(calls)), "system", book).count() == len(os.listdir(calls)) == 30
    (file,) = [x for x in path.rglob("*.json") if x.stat().st_size]
    whole = file.read_bytes()
    file.write_bytes(whole[: whole.rindex(b"reply") + 12])  # the last answer goes, within its text
    assert book.answers(spark).count() == 29
    assert label.ask(sent, model(str(calls)), "system", book).count() == 30 and book.answers(spark).count() == 30
    book.seal(spark)
    assert book.answers(spark).count() == 30 and not list(path.rglob("*.json"))

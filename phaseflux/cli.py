"""Command line: a run of the pipeline, validation, scoring of replies, sampling of pairs, prompts."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import evaluate, label, numbering
from .pipeline import Config, run
from .reporting import console
from .sources import database, readers, sinks

PAIRS = "drug_name string, indication string, highest_phase string, modality string, disease_area string, outcome string, weak_label string"


def _model(name: str) -> label.Model:
    """The callable module:name."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _run(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.source == "api":
        raise NotImplementedError("the REST source is not implemented")
    names = (*database.TABLES, "outcomes", "outcome_analyses")
    tables = {n: spark.read.parquet(f"{a.path}/{n}.parquet") for n in names} if a.source == "parquet" else {n: database.table(spark, n) for n in names}
    periods = [tuple(map(int, x.split("-"))) for x in a.periods] if a.periods else None
    config = Config(
        a.as_of, a.mesh_term, tuple(f"%{x}%" for x in a.keyword or ()), a.most if a.most > 0 else None, a.single_arm_only, method=a.method, drug_lookup=a.drug_lookup, drop_unmatched=not a.keep_unmatched, peptide_only=a.peptide_only,
        cache=a.cache, journal=a.journal, output=a.output, formats=tuple(a.formats), periods=periods,
    )
    got = run(spark, tables, _model(a.tier1), _model(a.tier2), config)
    return f"{got.report.text}\n\n{console.ledger(got.ledger)}"


def _validated(spark: SparkSession, benchmark_path: str, predicted: DataFrame) -> str:
    labels = readers.csv(spark, benchmark_path, readers.LABELS).withColumn("ord", F.monotonically_increasing_id()).cache()
    pairs = evaluate.matched(readers.benchmark(labels), predicted, ["drug", "indication"]).cache()
    whole = evaluate.evaluation(pairs)
    skipped = readers.skipped(labels).first()[0]
    found = evaluate.label_errors(readers.raw_labels(labels), predicted)
    return f"{console.evaluation(evaluate.metrics(pairs), whole, skipped)}\n\n{console.errors(found, whole.first()['matched'])}"


def _validate(spark: SparkSession, a: argparse.Namespace) -> str:
    return _validated(spark, a.benchmark, readers.predictions_csv(spark, a.predictions))


def _score(spark: SparkSession, a: argparse.Namespace) -> str:
    """Each file of replies by position against the pairs, up to the shorter of the two."""
    pairs = numbering.in_files(readers.csv(spark, a.pairs, PAIRS)).cache()
    files = sorted(map(str, Path(a.responses).glob("*.txt"))) if Path(a.responses).is_dir() else [a.responses]
    if not files:
        raise FileNotFoundError(f"no .txt files in {a.responses}")
    out = []
    for path in files:
        replies = readers.replies(spark, path).select((F.col("at") + 1).alias("at"), F.col("item")["outcome"].alias("outcome"))
        n, m = replies.count(), pairs.count()
        if n != m:
            out.append(f"{Path(path).name}: {n} replies, {m} pairs; the first {min(n, m)} are matched")
        rows = pairs.select("at", "drug_name", "indication").join(replies, "at").withColumnRenamed("at", "ord")
        out.append(f"{Path(path).name}\n{_validated(spark, a.benchmark, readers.predictions(rows))}")
    return "\n\n".join(out)


def _sample(spark: SparkSession, a: argparse.Namespace) -> str:
    """New pairs of each weak label, without the drugs that were sampled before, after those."""
    rows = readers.summary_csv(spark, a.summary).where("outcome IS NULL OR outcome != 'Ongoing'").withColumn("weak_label", evaluate.weak_label(F.col("outcome")))
    old = readers.csv(spark, a.pairs, PAIRS) if Path(a.pairs).exists() else spark.createDataFrame([], PAIRS)
    rows = evaluate.unseen(rows, old, "drug_name").withColumn("_id", F.concat_ws("|", "drug_name", "indication"))
    wanted = dict(x.split("=") for x in a.number)
    picked = [evaluate.sample(rows.where(F.col("weak_label") == name), "weak_label", "_id", int(n)) for name, n in wanted.items()]
    new = picked[0]
    for x in picked[1:]:
        new = new.unionByName(x)
    sinks.write_sample(old, evaluate.shuffled(new, "_id").drop("_id"), a.pairs)
    return f"wrote {a.pairs}"


def _prompts(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = numbering.in_files(readers.csv(spark, a.pairs, PAIRS)).withColumn("sponsors", F.lit(None).cast("string"))
    found = [r["prompt"] for r in evaluate.prompts(rows, "at").orderBy("at").collect()]
    return "\n\n".join([*found, f"Total: {len(found)} prompts"])


def _label(spark: SparkSession, a: argparse.Namespace) -> str:
    """The label file with a blank row for each new pair; evidence comes from a marketing table, if there is one."""
    names = [x.split()[0] for x in readers.LABELS.split(", ")]
    pairs = readers.csv(spark, a.pairs, PAIRS).select("drug_name", "indication")
    rows = evaluate.overlaid(pairs, readers.state(spark, a.state), ["drug_name", "indication"], names[2:])
    if a.marketing:
        found = evaluate.marketed(spark.read.parquet(a.marketing).withColumn("key", text.match_key(F.col("drug_name"))), "key").select("key", evaluate.evidence().alias("_evidence"), F.col("application_number").alias("_number"), F.col("overview_url").alias("_url"), F.col("sponsor").alias("_sponsor"))
        rows = rows.withColumn("key", text.match_key(F.col("drug_name"))).join(found, "key", "left")
        open_ = ~evaluate.is_resolved() & (F.col("commercialization_evidence") == "")
        fill = {"commercialization_evidence": F.coalesce("_evidence", F.lit("NDC: not found")), "application_number": F.coalesce("_number", F.lit("")), "drugsatfda_overview_url": F.coalesce("_url", F.lit("")), "sponsor": F.coalesce("_sponsor", F.lit(""))}
        rows = rows.withColumn("_open", open_).withColumns({k: F.when(F.col("_open"), v).otherwise(F.col(k)) for k, v in fill.items()})
    listed = sinks.collected(rows.select(*names).orderBy(F.lower("drug_name"), "indication"))
    sinks.write_state(listed, a.state)
    return console.progress(listed, sum(bool(r["commercialization_label"] and r["approval_label"]) for r in listed))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phaseflux")
    sub = top.add_subparsers(required=True)

    def command(name: str, act: object, **options: dict) -> None:
        own = sub.add_parser(name)
        own.set_defaults(act=act)
        for key, more in options.items():
            own.add_argument(f"--{key.replace('_', '-')}", **more)

    need = {"required": True}
    command(
        "run", _run, source={"choices": ["database", "parquet", "api"], "default": "database"}, path={}, as_of={"type": dt.date.fromisoformat, "default": dt.date.today()}, mesh_term={}, keyword={"action": "append"}, most={"type": int, "default": 5},
        single_arm_only={"action": "store_true"}, method={"choices": ["fuzzy", "embeddings", "hybrid"], "default": "hybrid"}, drug_lookup={}, keep_unmatched={"action": "store_true"}, peptide_only={"action": "store_true"}, cache={}, journal={}, output={},
        formats={"nargs": "*", "default": ["html"]}, periods={"nargs": "*"}, tier1=need, tier2=need,
    )
    command("validate", _validate, benchmark=need, predictions=need)
    command("score", _score, responses=need, pairs=need, benchmark=need)
    command("sample", _sample, summary=need, pairs=need, number={"nargs": "+", "default": ["Post-Clinical=20"]})
    command("prompts", _prompts, pairs=need)
    command("label", _label, pairs=need, state=need, marketing={})
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    return a.act(spark or SparkSession.builder.appName("phaseflux").getOrCreate(), a)


if __name__ == "__main__":
    print(main(sys.argv[1:]))

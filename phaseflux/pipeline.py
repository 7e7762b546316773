"""The whole way from the registry's tables to the report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stages
from .functions import text
from .operators import cluster, funnel, ingest, label, membership
from .reporting import Context, compose, write_report
from .reporting.components import Report
from .sources import cachefiles, readers
from .sources.journal import Journal
from .sources.shared import kept


@dataclass(frozen=True)
class Config:
    """What a run does. `most` caps the joined rows that are read; None reads all. `journal` is a folder for answered requests, which a run after a failed one does not send again."""

    as_of: dt.date
    mesh_term: str | None = None
    keywords: tuple[str, ...] = ()
    most: int | None = 50
    single_arm_only: bool = False
    rules: tuple[dict, ...] = ingest.RULES
    method: str = "hybrid"
    drug_lookup: str | None = None
    drop_unmatched: bool = True
    peptide_only: bool = False
    stopped_fail: bool = False
    cache: str | None = None
    journal: str | None = None
    output: str | None = None
    formats: tuple[str, ...] = ("html",)
    periods: list[tuple[int, int]] | None = field(default=None)


class Result(NamedTuple):
    trials: DataFrame
    candidates: DataFrame
    attributes: DataFrame
    outcomes: DataFrame
    funnel: DataFrame
    report: Report
    ledger: DataFrame
    spans: DataFrame


def ingested(tables: dict[str, DataFrame], config: Config) -> DataFrame:
    """Normalised trial rows: single arms are told before the rules drop rows, and so are the studies whose p-values count."""
    rows = ingest.flagged(ingest.scan(tables, config.mesh_term, config.keywords, config.most))
    if config.single_arm_only:
        rows = rows.where("is_single_arm")
    singles = rows.where("is_single_arm").select("nct_id").distinct()
    rows = ingest.normalised(ingest.filtered(rows, config.rules))
    if not {"outcomes", "outcome_analyses"} <= set(tables):
        return rows.withColumn("p_value", F.lit(None).cast("double"))
    got = ingest.with_p_values(rows, ingest.p_values(tables["outcomes"], tables["outcome_analyses"], singles))
    return got.withColumn("p_value", F.array_min(F.col("p_values.p_value")))


def clustered(spark: SparkSession, trials: DataFrame, config: Config) -> membership.Clustered:
    """Candidates and their members, merged by drug id where there is a lookup. Both are written to the shared folder."""
    found = membership.clustered(trials, cluster.STRATEGIES[config.method])
    if config.drug_lookup:
        _, by_norm = readers.drug_lookup(spark, config.drug_lookup)
        named = found.candidates.withColumn("norm", text.canonical_drug(F.coalesce(F.nullif("drug_name_raw", F.lit("")), "drug_name")))
        matched = cluster.two_level(named, by_norm.where("query_norm IS NOT NULL")).drop("norm", "match")
        found = membership.remerged(found._replace(candidates=kept(matched)), not config.drop_unmatched)
    return membership.Clustered(kept(found.candidates), kept(found.members))


def _labelled(spark: SparkSession, trials: DataFrame, cands: DataFrame, tier1: label.Model, tier2: label.Model, config: Config) -> tuple[label.Stage, label.Stage, DataFrame]:
    """Attributes and outcomes, and when both stages ran: side by side, but in a report on peptides only, where the second
    stage asks about what the first one has found to be peptides. Either's answers are written before it ends."""
    created = F.lit(config.as_of.isoformat())
    known = cachefiles.read(spark, config.cache)
    book = Journal(config.journal) if config.journal else None
    done: list[label.Stage] = []

    def classification() -> label.Stage:
        got = label.classify(cands, known.classification, tier1, tier2, created, book)
        done.append(got._replace(labels=kept(got.labels)))
        return done[0]

    def adjudication() -> label.Stage:
        asked = ingest.peptides(cands, done[0].labels) if config.peptide_only else cands
        failures = None
        if config.stopped_fail:
            failures = label.stopped_early(trials.withColumn("candidate_id", cluster.STRATEGIES[config.method]()), "candidate_id").join(asked.select("candidate_id"), "candidate_id", "left_semi")
        got = label.adjudicate(asked, known.adjudication, tier1, tier2, created, failures, book)
        return got._replace(labels=kept(got.labels))

    ran = stages.run(spark, {"Classification": classification, "Adjudication": adjudication}, together=not config.peptide_only)
    if book:
        book.seal(spark)
    return ran.results["Classification"], ran.results["Adjudication"], ran.spans


def run(spark: SparkSession, tables: dict[str, DataFrame], tier1: label.Model, tier2: label.Model, config: Config) -> Result:
    """All stages. Trials and candidates are written to the shared folder once, as everything after them reads them; labels go to
    the cache, if there is one, before they are used. In a report on peptides only they are adjudicated."""
    trials = kept(ingested(tables, config))
    found = clustered(spark, trials, config)
    cands = found.candidates
    classified, judged, spans = _labelled(spark, trials, cands, tier1, tier2, config)
    cachefiles.write(config.cache, classified.fresh, judged.fresh)
    attributes, outcomes = classified.labels, judged.labels
    rows = kept(funnel.joined(cands, attributes.select("candidate_id", "modality", "disease_area"), outcomes.select("candidate_id", "outcome", "approval_date", "market_date")))
    rates = kept(funnel.funnel(rows, trials, membership.labels(found, rows)))
    report = compose(Context(rows, rates, config.as_of, config.peptide_only, config.periods))
    if config.output:
        write_report(report, config.output, config.as_of, config.formats)
    return Result(trials, cands, attributes, outcomes, rates, report, label.ledger(classified.entries.unionByName(judged.entries)), spans)

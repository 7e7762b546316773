"""Labels of candidates: cache, tiered model calls, overrides, costs."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..sources import journal
from ..sources.journal import Journal
from ..sources.readers import cache_upsert, latest
from ..sources.shared import kept
from . import numbering

#: Rows of a request; prices in dollars a million tokens (input, output) by tier; cache write and read factors.
BATCH = 50
PRICES = {"tier1": (3.0, 15.0), "tier2": (5.0, 25.0)}
WRITE, READ = 1.25, 0.10
LOW = 0.25
#: Where a request's candidates go in a user prompt.
PLACE = "{{CANDIDATES_BLOCK}}"
log = logging.getLogger(__name__)


class Answer(NamedTuple):
    """A model's reply and the tokens it cost."""

    reply: str | None
    input_tokens: int = 0
    output_tokens: int = 0
    cache_write: int = 0
    cache_read: int = 0


#: Takes the system and the user prompt of one request; returns the reply, bare or as an Answer, or None for a failed call.
Model = Callable[[str, str], "Answer | str | None"]
_ASKED = f"batch long, members array<struct<candidate_index:int,id:string>>, {journal.ANSWER}"


@dataclass(frozen=True)
class Task:
    """What a model is asked: a reply's schema, the lines of a candidate, how an item becomes columns, what stands for no answer."""

    stage: str
    system: str
    user: str
    schema: str
    fields: dict[str, Callable[[], Column]]
    parse: Callable[[Column], dict[str, Column]]
    defaults: dict[str, Column]
    unsure: Callable[[Column], Column]


def _unsure(item: Column, *names: str) -> Column:
    """Low confidence; a missing one counts as none."""
    return vocab.lookup(F.coalesce(*(item[x] for x in names), F.lit("")), vocab.CONFIDENCE, 0.0) <= LOW


def field_of(column: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("Unknown"))


def classification() -> Task:
    return Task(
        "Classification", "Name the modality and the disease area of each candidate. Reply with a JSON array only, one object for each candidate_index.", f"Candidates:\n\n{PLACE}", text.REPLY,
        {"Drug name": field_of("drug_name_raw"), "Indication": field_of("indication")},
        lambda item: {
            "modality": text.modality(F.coalesce(item["drug_modality"], F.lit("unknown"))), "disease_area": text.disease_area(F.coalesce(item["disease_area"], F.lit("unknown"))),
            "modality_confidence": text.confidence(item["modality_confidence"]), "disease_confidence": text.confidence(item["disease_confidence"]), "reasoning": F.coalesce(item["reasoning"], F.lit("")),
        },
        {"modality": F.lit("unknown"), "disease_area": F.lit("unknown"), "modality_confidence": F.lit(0.0), "disease_confidence": F.lit(0.0), "reasoning": F.lit("")},
        lambda item: _unsure(item, "modality_confidence") | (text.modality(F.coalesce(item["drug_modality"], F.lit("unknown"))) == "unknown"),
    )


def adjudication() -> Task:
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("Unknown")
    return Task(
        "Adjudication", "Decide the development outcome of each candidate from its trials. Reply with a JSON array only, one object for each candidate_index.", f"Candidates:\n\n{PLACE}", text.OUTCOME_REPLY,
        {
            "Drug name": field_of("drug_name_raw"), "Indication": field_of("indication"), "Highest phase reached": field_of("highest_phase"), "Number of trials": lambda: F.col("n_trials").cast("string"),
            "Sponsors": lambda: listed("sponsors"), "Earliest trial start": field_of("earliest_start"), "Latest trial completion": field_of("latest_completion"),
        },
        lambda item: {
            "outcome": vocab.lookup(F.coalesce(item["outcome"], F.lit("UNKNOWN")), vocab.OUTCOMES, "Unknown"), "confidence": text.confidence(item["confidence"]), "reasoning": F.coalesce(item["reasoning"], F.lit("")),
            "evidence_sources": F.coalesce(item["evidence_sources"], F.array().cast("array<string>")), "approval_date": text.iso_date(item["approval_date"]), "market_date": text.iso_date(item["commercialization_date"]),
        },
        {"outcome": F.lit("Unknown"), "confidence": F.lit(0.0), "reasoning": F.lit(""), "evidence_sources": F.array().cast("array<string>"), "approval_date": F.lit(None).cast("date"), "market_date": F.lit(None).cast("date")},
        lambda item: _unsure(item, "confidence") | (F.coalesce(item["outcome"], F.lit("UNKNOWN")) == "UNKNOWN"),
    )


def block(fields: dict[str, Callable[[], Column]], statuses: str | None = None) -> Column:
    """A candidate's lines for a prompt, null as Unknown; its trials' statuses where there are any."""
    lines = [F.concat(F.lit(f"{label}: "), value()) for label, value in fields.items()]
    if statuses:
        lines.append(F.when(F.col(statuses) != "", F.concat(F.lit("Trial statuses: "), F.col(statuses))))
    return F.concat_ws("\n", F.format_string("[%d]", F.col("candidate_index")), *lines)


def batched(rows: DataFrame, id_col: str, size: int = BATCH) -> DataFrame:
    """`batch` and `candidate_index` (from 1): slices of `size` rows in the order of the ids, with no task that sees all rows."""
    rows = numbering.ordered(rows, id_col, name="_number", start=0)
    return rows.withColumns({"batch": F.floor(F.col("_number") / size).cast("long"), "candidate_index": (F.col("_number") % size + 1).cast("int")}).drop("_number")


def _counted(cands: DataFrame) -> DataFrame:
    """Candidates with the number of their trials, also where they have these as lists."""
    listed = "trial_ids" in cands.columns and "n_trials" not in cands.columns
    return cands.withColumn("n_trials", F.size("trial_ids").cast("long")) if listed else cands


def _large(side: DataFrame) -> DataFrame:
    """A join's side of a row for each candidate or request: never a broadcast by the size of its files, which hold a tenth or less of
    what its rows take in the driver's memory. Both sides meet by shuffles at every size."""
    return side.hint("merge")


def requests(rows: DataFrame, task: Task, id_col: str, size: int = BATCH) -> DataFrame:
    """(batch, members, prompt): one row for each request."""
    lines = batched(_counted(rows), id_col, size).select("batch", F.struct("candidate_index", F.col(id_col).alias("id"), block(task.fields, "statuses" if "statuses" in rows.columns else None).alias("block")).alias("one"))
    listed = lines.groupBy("batch").agg(F.sort_array(F.collect_list("one")).alias("all"))  # `size` rows at most
    members = F.transform("all", lambda x: F.struct(x["candidate_index"].alias("candidate_index"), x["id"].alias("id")))
    return listed.select("batch", members.alias("members"), F.replace(F.lit(task.user), F.lit(PLACE), F.array_join("all.block", "\n\n")).alias("prompt"))


def ask(asked: DataFrame, model: Model, system: str, book: Journal | None = None) -> DataFrame:
    """(batch, members, reply, tokens) of each request; the model is called on the executors, once for each request that is read.

    With a journal (and the requests' names in `request`) each answer is on disk before the next request is sent, and a task
    that runs again sends only what has no answer yet. Failed calls are not written: they are sent again.
    """

    def one(prompt: str, name: str | None, get: Callable, put: Callable) -> Answer:
        if name and (found := get(name)):
            return Answer(*(found[x] for x in Answer._fields))
        try:
            got = model(system, prompt)
        except Exception:  # whatever a model's client raises: its rows go to the next tier
            log.warning("a request failed; its candidates go on without an answer", exc_info=True)
            return Answer(None)
        got = got if isinstance(got, Answer) else Answer(got)
        if name and got.reply is not None:
            put(name, got._asdict())
        return got

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with book.of_task() if book else contextlib.nullcontext((None, None)) as (get, put):
            for part in parts:
                out = [one(p, n, get, put) for p, n in zip(part["prompt"], part["request"] if book else [None] * len(part), strict=True)]
                yield pd.concat([part[["batch", "members"]].reset_index(drop=True), pd.DataFrame(out, columns=Answer._fields)], axis=1)

    return asked.mapInPandas(run, _ASKED)


def answered(rows: DataFrame, task: Task, model: Model, tier: str, id_col: str, size: int = BATCH, book: Journal | None = None) -> DataFrame:
    """The answers of a tier with `resumed`, whether an earlier run had paid for them; written to the shared folder before
    anything is made of them, so that no request is sent twice.

    Requests are the same in every run over the same candidates, as slices follow the order of ids; a request's name is made of
    stage, tier and both prompts. Those that the journal has are not sent: their answers join by name.
    """
    sent = requests(rows, task, id_col, size)
    if book is None:
        return kept(ask(sent, model, task.system).withColumn("resumed", F.lit(False)))
    sent = sent.withColumn("request", journal.request(F.lit(task.stage), F.lit(tier), F.lit(task.system), F.col("prompt")))
    known = kept(book.answers(rows.sparkSession))
    old = sent.join(_large(known), "request").drop("request", "prompt").withColumn("resumed", F.lit(True))
    new = ask(sent.join(_large(known.select("request")), "request", "left_anti"), model, task.system, book).withColumn("resumed", F.lit(False))
    return kept(new.unionByName(old))


def parsed(answers: DataFrame, task: Task, id_col: str) -> DataFrame:
    """Each candidate's own item of its reply, the last of repeated indexes, as labels and whether they are unsure.

    A reply is read once, before its members become rows: a request's rows carry their own items, never the whole reply.
    """
    read = answers.select("members", text.reply(F.col("reply"), schema=task.schema).alias("items"))
    own = lambda m: F.get(F.reverse(F.filter("items", lambda x: x["candidate_index"] == m["candidate_index"])), F.lit(0))
    each = read.select(F.explode(F.transform("members", lambda m: F.struct(m["id"].alias("id"), own(m).alias("item")))).alias("m"))
    item = F.col("m.item")
    labels = [c.alias(k) for k, c in task.parse(item).items()]
    return each.where("m.item IS NOT NULL").select(F.col("m.id").alias(id_col), *labels, F.coalesce(task.unsure(item), F.lit(True)).alias("unsure"))


def escalates() -> Column:
    """Whether a label is too unsure: low confidence (missing counts as 0) or an unknown modality."""
    return (F.coalesce("modality_confidence", F.lit(0.0)) <= LOW) | (F.coalesce("modality", F.lit("unknown")) == "unknown")


def merged(first: DataFrame, second: DataFrame, id_col: str) -> DataFrame:
    """First-tier answers, overridden where the second tier has one."""
    names = [c for c in first.columns if c != id_col]
    two = second.select(F.col(id_col), *(F.col(c).alias(f"{c}_2") for c in names), F.lit(True).alias("_new"))
    return first.join(_large(two), id_col, "left").select(id_col, *(F.when(F.col("_new"), F.col(f"{c}_2")).otherwise(F.col(c)).alias(c) for c in names))


class Run(NamedTuple):
    """Labels of all candidates, and the ledger's entries."""

    labels: DataFrame
    entries: DataFrame


def _entries(answers: DataFrame, stage: str, model: str) -> DataFrame:
    tokens = ("input_tokens", "output_tokens", "cache_write", "cache_read")
    paid = [F.when(F.col("resumed"), 0).otherwise(F.col(c)).cast("long").alias(c) for c in tokens]
    return answers.where("reply IS NOT NULL").select(F.lit(stage).alias("stage"), F.lit(model).alias("model"), *paid, F.size("members").cast("long").alias("n_candidates"), F.col("resumed").alias("cache_hit"))


def hits(rows: DataFrame, stage: str) -> DataFrame:
    """The ledger's entry for candidates that cost nothing."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")]
    return rows.agg(F.count("*").alias("n_candidates")).where("n_candidates > 0").select(F.lit(stage).alias("stage"), F.lit(None).cast("string").alias("model"), *zero, "n_candidates", F.lit(True).alias("cache_hit"))


def tiered(cands: DataFrame, task: Task, tier1: Model, tier2: Model, id_col: str = "candidate_id", size: int = BATCH, book: Journal | None = None) -> Run:
    """Labels by tier 1, by tier 2 for unsure and missing ones, else the defaults. An empty second answer leaves the first one.

    Answers that a journal has from an earlier run cost nothing, and count as cache hits in the ledger.
    """
    first = answered(cands, task, tier1, "tier1", id_col, size, book)
    labels = parsed(first, task, id_col)
    one = cands.select(id_col).join(_large(labels), id_col, "left")
    again = cands.join(_large(one.where(F.coalesce("unsure", F.lit(True))).select(id_col)), id_col, "left_semi")
    second = answered(again, task, tier2, "tier2", id_col, size, book)
    both = merged(one, parsed(second, task, id_col), id_col)
    some = F.col("unsure").isNotNull()
    out = both.select(id_col, *(F.when(some, F.col(k)).otherwise(c).alias(k) for k, c in task.defaults.items()))
    return Run(out, _entries(first, task.stage, "tier1").unionByName(_entries(second, task.stage, "tier2")))


def split_cache(cands: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with a cached label, and the others."""
    return cands.join(_large(cache), "cache_key"), cands.join(_large(cache.select("cache_key")), "cache_key", "left_anti")


def overridden(attributes: DataFrame) -> DataFrame:
    """Areas by vote of the condition's tree numbers where that decides, with full confidence; after caching."""
    vote = text.area_vote(F.col("trees"))
    return attributes.withColumn("vote", vote).withColumns({"disease_area": F.coalesce("vote", "disease_area"), "disease_confidence": F.when(F.col("vote").isNotNull(), 1.0).otherwise(F.col("disease_confidence"))}).drop("vote")


class Stage(NamedTuple):
    """A stage's labels, the cache with its new entries, the ledger's entries, and the new entries alone."""

    labels: DataFrame
    cache: DataFrame
    entries: DataFrame
    fresh: DataFrame


def _stage(cands: DataFrame, cache: DataFrame, task: Task, key: Column, tier1: Model, tier2: Model, created_at: Column, book: Journal | None) -> Stage:
    rows = cands.withColumn("cache_key", key)
    names = list(task.defaults)
    known, missing = split_cache(rows, cache.select("cache_key", *names))
    run = tiered(missing, task, tier1, tier2, book=book)
    fresh = kept(run.labels.join(_large(rows.select("candidate_id", "cache_key")), "candidate_id"))
    new = latest(fresh.select("cache_key", *names, created_at.alias("created_at"), "candidate_id"), ["cache_key"], ["candidate_id"])
    new = new.select(*cache.columns)
    labels = known.select("candidate_id", *names).unionByName(fresh.select("candidate_id", *names))
    return Stage(labels, cache_upsert(cache, new), run.entries.unionByName(hits(known, task.stage)), new)


def classify(cands: DataFrame, cache: DataFrame, tier1: Model, tier2: Model, created_at: Column, book: Journal | None = None) -> Stage:
    """Attributes of candidates: cached ones with their area normalised, else asked and cached as answered; then the vote of
    the tree numbers overrides the area. Cached defaults of failed calls count as answers, as in the results reproduced."""
    plain = cands.select("candidate_id", "drug_name", "drug_name_raw", "indication")
    got = _stage(plain, cache, classification(), text.cache_key(F.col("drug_name"), F.col("indication")), tier1, tier2, created_at, book)
    labels = got.labels.withColumn("disease_area", text.disease_area(F.col("disease_area"))).join(_large(cands.select("candidate_id", "trees")), "candidate_id")
    return got._replace(labels=overridden(labels).drop("trees"))


def adjudicate(cands: DataFrame, cache: DataFrame, tier1: Model, tier2: Model, created_at: Column, failures: DataFrame | None = None, book: Journal | None = None) -> Stage:
    """Outcomes of candidates: `failures` (of stopped_early(), off by default) cost nothing, then the cache, then the models.

    A cache with the date columns keeps them.
    """
    cands = _counted(cands)
    names = ["candidate_id", "drug_name", "drug_name_raw", "indication", "highest_phase", "n_trials", "sponsors", "earliest_start", "latest_completion", *(["statuses"] if "statuses" in cands.columns else [])]
    rows, task = cands.select(*names), adjudication()
    if failures is not None:
        rows = rows.join(_large(failures.select("candidate_id")), "candidate_id", "left_anti")
    key = text.cache_key(F.col("drug_name"), F.col("indication"), F.col("highest_phase"))
    got = _stage(rows, cache, task, key, tier1, tier2, created_at, book)
    if failures is not None:
        labels = got.labels.unionByName(failures.select("candidate_id", *(F.col(k) if k in failures.columns else c.alias(k) for k, c in task.defaults.items())))
        got = got._replace(labels=labels, entries=got.entries.unionByName(hits(failures, task.stage)))
    return got


def classify_one(spark: SparkSession, drug: str, indication: str, tier1: Model, tier2: Model) -> dict:
    """Attributes of one drug and indication."""
    row = spark.createDataFrame([(f"{drug}_{indication}", drug, indication)], "candidate_id string, drug_name_raw string, indication string")
    return tiered(row, classification(), tier1, tier2).labels.first().asDict()


def stopped_early(trials: DataFrame, key: str) -> DataFrame:
    """Candidates of which every trial was terminated or withdrawn and the top phase is 1 to 3: failed there."""
    rank = vocab.lookup(F.col("phase"), vocab.PHASE_RANK)
    sums = trials.groupBy(key).agg(F.bool_and(F.col("status").isin("Terminated", "Withdrawn")).alias("all"), F.max(rank).alias("rank"))
    return sums.where(F.col("all") & F.col("rank").between(2, 4)).select(key, F.concat(F.lit("Failed Phase "), (F.col("rank") - 1).cast("string")).alias("outcome"), F.lit(1.0).alias("confidence"))


def statuses(trials: DataFrame, key: str) -> DataFrame:
    """'n Status' of a candidate's trials, sorted by status."""
    counts = trials.groupBy(key, "status").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["status"])), ", ").alias("statuses"))


def cost() -> Column:
    """Dollars of a ledger row."""
    price = lambda i: vocab.lookup(F.col("model"), {k: p[i] for k, p in PRICES.items()}, 0.0)
    return (F.col("input_tokens") * price(0) + F.col("cache_write") * price(0) * WRITE + F.col("cache_read") * price(0) * READ + F.col("output_tokens") * price(1)) / F.lit(1e6)


def ledger(entries: DataFrame) -> DataFrame:
    """Per stage tokens (input with what the cache wrote and read), cost by tier, candidates asked and free, cost a candidate of each kind (null without any)."""
    free = F.coalesce("cache_hit", F.lit(False)) if "cache_hit" in entries.columns else F.lit(False)
    rows = entries.withColumns({"cost": F.when(free, 0.0).otherwise(cost()), "asked": F.when(free, 0).otherwise(F.col("n_candidates")), "free": F.when(free, F.col("n_candidates")).otherwise(0)})
    of = lambda c, t: F.coalesce(F.sum(F.when(F.col("model") == t, F.col(c))), F.lit(0))
    sums = rows.groupBy("stage").agg(
        F.sum(F.expr("input_tokens + cache_write + cache_read")).alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), of("cost", "tier1").alias("tier1_cost"), of("cost", "tier2").alias("tier2_cost"),
        F.sum("asked").alias("asked"), F.sum("free").alias("cache_hits"), F.sum("n_candidates").alias("n_candidates"), of("asked", "tier1").alias("tier1_asked"), of("asked", "tier2").alias("tier2_asked"),
    )
    each = {"cost_each": ("cost", "n_candidates"), "cost_asked": ("cost", "asked"), "tier1_each": ("tier1_cost", "tier1_asked"), "tier2_each": ("tier2_cost", "tier2_asked")}
    return sums.withColumns({k: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for k, (a, b) in each.items()})

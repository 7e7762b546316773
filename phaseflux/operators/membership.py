"""Which trials a candidate has, in long form: a row for each (candidate, trial row), never a list.

A candidate may hold a third of all trials. Its rows stay rows: what is known of a candidate comes from aggregates that combine
within tasks first, and joins have one row for each candidate on the other side, so that Spark's adaptive skew join splits
the hot one. Lists are made only of distinct values (sponsors, tree numbers), or where a result shows them (listed()).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..sources.shared import kept
from . import cluster

#: What is kept of a trial row.
COLUMNS = ("nct_id", "ord", "phase")


class Clustered(NamedTuple):
    """Candidates, a row each, and their members (candidate_id, nct_id, ord, phase)."""

    candidates: DataFrame
    members: DataFrame


def keyed(trials: DataFrame, key: cluster.Strategy = cluster.string_key) -> DataFrame:
    """Trial rows with the id and the phase's rank of their candidate."""
    return trials.withColumns({"candidate_id": key(), "rank": cluster.rank("phase")} | (cluster.approvals() if "outcome" in trials.columns else {}))


def _values(rows: DataFrame) -> DataFrame:
    """Of each candidate: distinct sponsors in the order first seen, sorted distinct tree numbers, the most frequent MeSH term of
    drugs and of conditions (the first seen of equals).

    Rows that are equal in all four are counted with their first place before anything is gathered, one row for a trial at most
    (a row for each value would be five). A candidate's distinct rows are its sponsors' by far; they meet in its own list.
    """
    sides = ("mesh_drug_terms", "mesh_condition_terms")
    counts = rows.groupBy("candidate_id", "sponsor", "trees", *sides).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    found = counts.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("ord", "sponsor", "trees", *sides, "n"))).alias("all"))
    return found.select(
        "candidate_id", F.array_distinct(F.filter("all.sponsor", lambda s: F.coalesce(s, F.lit("")) != "")).alias("sponsors"),
        F.sort_array(F.array_distinct(F.filter(F.flatten(F.array_distinct(F.filter("all.trees", lambda x: x.isNotNull()))), lambda x: x.isNotNull()))).alias("trees"),
        *(_modal(side).alias(name) for side, name in zip(sides, ("mesh_drug", "mesh_indication"), strict=True)),
    )


def _modal(side: str) -> Column:
    """The most frequent lower-case term of a candidate's counted rows, the first seen of equals; null for none."""
    plain = F.transform("all", lambda x: F.struct(F.transform(F.filter(x[side], lambda t: t.isNotNull()), lambda t: text.strip(F.lower(t))).alias("terms"), x["n"].alias("n")))

    def count(all_: Column, term: Column) -> Column:
        times = lambda terms: F.size(terms) - F.size(F.array_remove(terms, term))
        return F.aggregate(all_, F.lit(0).cast("long"), lambda total, x: total + F.when(x["terms"].isNotNull(), times(x["terms"]) * x["n"]).otherwise(0))

    def most(all_: Column) -> Column:
        seen = F.array_distinct(F.flatten(F.filter(F.transform(all_, lambda x: x["terms"]), lambda x: x.isNotNull())))
        return F.when(F.size(seen) < 2, F.get(seen, F.lit(0))).otherwise(F.array_min(F.transform(seen, lambda t, at: F.struct((-count(all_, t)).alias("less"), at.alias("at"), t.alias("term"))))["term"])

    return text.bound(plain, most)


def clustered(trials: DataFrame, key: cluster.Strategy = cluster.string_key, values: bool = True) -> Clustered:
    """cluster.candidates() without lists of trials, but with their number `n_trials`, and the members beside it.

    The p-values are the least of the candidate's single-arm rows by phase, from the members as well. Without `values` candidates have
    no sponsors, trees and MeSH terms, whose shuffles are then left out.
    """
    rows = keyed(trials, key)
    labels = [x for x in cluster.LABELS if x in rows.columns]
    single = F.col("is_single_arm") if "is_single_arm" in rows.columns else F.lit(True)
    p = lambda i: F.min(F.when(single & (F.col("phase") == f"Phase {i}"), F.col("p_value")))
    sums = rows.groupBy("candidate_id").agg(
        F.min_by(F.struct("intervention", "indication", *labels), "ord").alias("first"), F.count("*").alias("n_trials"), F.max("rank").alias("rank"), F.min("start_date").alias("earliest_start"),
        F.max("completion_date").alias("latest_completion"), F.min("ord").alias("ord"), *(p(i).alias(f"p_{i}") for i in (1, 2, 3)), F.max(single & F.col("p_value").isNotNull() & F.col("phase").isNotNull()).alias("has_p"),
    )
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    terms = [empty("sponsors"), empty("trees"), F.col("mesh_drug"), F.col("mesh_indication")] if values else []
    found = (sums.join(_values(rows), "candidate_id", "left") if values else sums).select(
        "candidate_id", text.cluster_key(F.col("first.intervention")).alias("drug_name"), text.cluster_key(F.col("first.indication")).alias("indication"), F.col("first.intervention").alias("drug_name_raw"),
        "n_trials", _phase(F.col("rank")).alias("highest_phase"), *terms[:1], "earliest_start", "latest_completion", *terms[1:2], "ord", *terms[2:], *(F.col(f"first.{x}") for x in labels), "p_1", "p_2", "p_3", "has_p",
    )
    return Clustered(found, rows.select("candidate_id", *COLUMNS))


def _phase(rank: Column) -> Column:
    return vocab.lookup(rank, {r: name for name, r in vocab.PHASE_RANK.items()})


def remerged(found: Clustered, keep_unmatched: bool = True) -> Clustered:
    """cluster.remerged() in long form: candidates of one drug id (else MeSH drug) and indication are one, and their members get its id.

    A merged candidate has the first one's names and labels, each study once, and no p-values. Members of a study that several
    of the merged candidates have stay once, the first of the first candidate; members of a candidate that is alone all stay.
    """
    cands = found.candidates
    known = F.coalesce("drug_id", "mesh_drug")
    rows = (cands if keep_unmatched else cands.where(known.isNotNull())).withColumns({"g_drug": F.coalesce(known, "candidate_id"), "g_area": F.when(known.isNotNull(), F.coalesce("mesh_indication", "indication"))})
    rows, group = rows.withColumn("alone", known.isNull()), ["g_drug", "g_area", "alone"]
    ps = [c for c in ("p_1", "p_2", "p_3", "has_p") if c in cands.columns]
    firsts = [c for c in cands.columns if c not in ("n_trials", "sponsors", "trees", "highest_phase", "earliest_start", "latest_completion", "ord", *ps)]
    gathered = {"sponsors": F.sort_array(F.collect_list(F.struct("ord", "sponsors"))), "trees": F.sort_array(F.array_distinct(F.flatten(F.collect_list("trees"))))} if "sponsors" in cands.columns else {}
    sums = rows.groupBy(*group).agg(
        F.min_by(F.struct(*firsts, *ps), "ord").alias("first"), F.count("*").alias("merged"), F.max(cluster.rank("highest_phase")).alias("rank"), F.min("earliest_start").alias("earliest_start"),
        F.max("latest_completion").alias("latest_completion"), F.min("ord").alias("ord"), *(c.alias(name) for name, c in gathered.items()),
    )
    same = F.col("r.g_area").eqNullSafe(F.col("s.g_area")) & (F.col("r.g_drug") == F.col("s.g_drug")) & (F.col("r.alone") == F.col("s.alone"))
    ids = rows.alias("r").join(sums.select(*group, F.col("first.candidate_id").alias("to"), "merged").alias("s"), same).select("r.candidate_id", "to", "merged", F.col("r.ord").alias("cord"))
    moved = found.members.join(ids, "candidate_id")  # one row for each candidate: a hot one is split
    alone = moved.where("merged = 1").select(F.col("to").alias("candidate_id"), *COLUMNS)
    once = moved.where("merged > 1").groupBy("to", "nct_id").agg(F.min_by(F.struct("ord", "phase"), F.struct("cord", "ord")).alias("one"), F.min(F.struct("cord", "ord")).alias("at"))
    members = alone.withColumn("cord", F.lit(None).cast(cands.schema["ord"].dataType)).unionByName(once.select(F.col("to").alias("candidate_id"), "nct_id", "one.ord", "one.phase", "at.cord"))
    counts = members.groupBy("candidate_id").agg(F.count("*").alias("n_trials"))
    one = F.col("merged") == 1
    out = sums.select(
        *(F.col(f"first.{c}") for c in firsts), "merged", *((F.array_distinct(F.flatten("sponsors.sponsors")).alias("sponsors"), F.col("trees")) if gathered else ()), _phase(F.col("rank")).alias("highest_phase"), "earliest_start", "latest_completion", "ord",
        *(F.when(one, F.col(f"first.{c}")).alias(c) for c in ps),
    )
    return Clustered(out.join(counts, "candidate_id"), members)


def named(trials: DataFrame, key: cluster.Strategy = cluster.string_key) -> Clustered:
    """clustered() with names alone: of candidates drug_name, indication, n_trials and ord, of members (candidate_id, nct_id).

    A trial row is sent with its names and its order, where clustered() sends all that is known of it.
    """
    rows = trials.withColumn("candidate_id", key())
    sums = rows.groupBy("candidate_id").agg(F.min(F.struct("ord", "intervention", "indication")).alias("first"), F.count("*").alias("n_trials"))
    names = [text.cluster_key(F.col(f"first.{c}")).alias(name) for c, name in (("intervention", "drug_name"), ("indication", "indication"))]
    return Clustered(sums.select("candidate_id", *names, "n_trials", F.col("first.ord").alias("ord")), rows.select("candidate_id", "nct_id"))


def studies(found: Clustered, keep_unmatched: bool = True) -> DataFrame:
    """(candidate_id, nct_id, n, n_trials): the members of remerged() counted by study, and all of their candidate; named()'s will do.

    Candidates without an id stay what they are, and go through no group. Members are sent three times: to their candidate's new id,
    by that and their study, and those of merged candidates to the sums. What the second has made is kept, as the sums and the rows both
    read it. No side is broadcast by the size of its files.
    """
    known = F.coalesce("drug_id", "mesh_drug")
    rows = found.candidates.select("candidate_id", "ord", "n_trials", known.alias("g_drug"), F.coalesce("mesh_indication", "indication").alias("g_area"))
    some = rows.where("g_drug IS NOT NULL")
    groups = some.groupBy("g_drug", "g_area").agg(F.min_by("candidate_id", "ord").alias("to"), F.count("*").alias("merged"))
    same = (F.col("r.g_drug") == F.col("s.g_drug")) & F.col("r.g_area").eqNullSafe(F.col("s.g_area"))
    ids = some.alias("r").join(groups.hint("merge").alias("s"), same).select("candidate_id", "to", "merged", "n_trials")
    if keep_unmatched:
        ids = ids.unionByName(rows.where("g_drug IS NULL").select("candidate_id", F.col("candidate_id").alias("to"), F.lit(1).cast("long").alias("merged"), "n_trials"))
    moved = found.members.join(ids.hint("merge"), "candidate_id")  # one row for each candidate: a hot one is split
    own = F.max(F.when(F.col("merged") == 1, F.col("n_trials")))  # of a candidate that is alone
    each = kept(moved.groupBy(F.col("to").alias("candidate_id"), "nct_id").agg(F.count("*").alias("n"), own.alias("n_trials")))
    alone, once = each.where("n_trials IS NOT NULL"), each.where("n_trials IS NULL").select("candidate_id", "nct_id", F.lit(1).cast("long").alias("n"))
    sums = once.groupBy("candidate_id").agg(F.count("*").alias("n_trials"))
    return alone.unionByName(once.join(sums.hint("merge"), "candidate_id"))


def labels(found: Clustered, rows: DataFrame) -> DataFrame:
    """(nct_id, labels): each study's distinct (modality, disease_area) among its candidates, whose labels are in `rows`.

    Pairs are made distinct before they are gathered, so a study that many candidates name is a row for each pair of labels.
    """
    pairs = found.members.join(rows.select("candidate_id", "modality", "disease_area"), "candidate_id").select("nct_id", "modality", "disease_area").distinct()
    return pairs.groupBy("nct_id").agg(F.collect_list(F.struct("modality", "disease_area")).alias("labels"))


def listed(found: Clustered) -> DataFrame:
    """The candidates with `trial_ids`, for a result that shows them: in order, repeats and all."""
    order = ["cord", "ord"] if "cord" in found.members.columns else ["ord"]
    ids = found.members.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct(*order, "nct_id"))).alias("all")).select("candidate_id", F.col("all.nct_id").alias("trial_ids"))
    return found.candidates.join(ids, "candidate_id")

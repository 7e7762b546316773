"""From trials to drug-indication candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab

Strategy = Callable[[], Column]


def string_key() -> Column:
    """Normal forms of drug and indication; equal keys cluster, there is no edit distance."""
    return F.concat_ws("__", text.cluster_key(F.col("intervention")), text.cluster_key(F.col("indication")))


def hybrid_key() -> Column:
    """MeSH terms of a side where it has any, else its normal form; both sides alike."""

    def side(terms: str, plain: str) -> Column:
        known = F.array_sort(F.transform(F.col(terms), lambda t: text.strip(F.lower(t))))
        return F.when(F.size(terms) > 0, F.array_join(known, "|")).otherwise(text.cluster_key(F.col(plain)))

    return F.concat_ws("__", side("mesh_drug_terms", "intervention"), side("mesh_condition_terms", "indication"))


#: Ways to cluster by name; there is no strategy by embeddings, its name stands for the plain keys.
STRATEGIES: dict[str, Strategy] = {"fuzzy": string_key, "embeddings": string_key, "hybrid": hybrid_key}
LABELS = ("modality", "disease_area", "outcome", "approval_date", "market_date")
#: Stands before a text key in groups and windows: rows are then sorted by a number, where long names with common starts are slow to compare.
_HASH = "_hash"
_PHASES = {rank: name for name, rank in vocab.PHASE_RANK.items()}


def rank(phase: str) -> Column:
    return vocab.lookup(F.col(phase), vocab.PHASE_RANK)


def approvals() -> dict[str, Column]:
    """Approval and market dates of a trial row, as the view derives them from its completion."""
    approved = F.when(F.col("outcome").isin("Approved", "Commercialized"), F.date_add("completion_date", F.col("quantity") * 10))
    return {"approval_date": approved, "market_date": F.when(F.col("outcome") == "Commercialized", F.date_add(approved, F.col("quantity") * 20 - 300))}


def modal(terms: Column) -> Column:
    """The most frequent lower-case term of a list, the first of equals; null for none."""
    plain = F.transform(terms, lambda t: text.strip(F.lower(t)))

    def ranked(all_: Column) -> Column:
        each = F.transform(F.array_distinct(all_), lambda t: F.struct((F.size(F.array_remove(all_, t)) - F.size(all_)).alias("less"), F.array_position(all_, t).alias("at"), t.alias("term")))
        return F.array_min(each)["term"]

    return text.bound(plain, ranked)


def candidates(trials: DataFrame, key: Strategy = string_key, ids: bool = True, statuses: bool = False) -> DataFrame:
    """One row per key: the first trial's names and labels, trial ids in order with repeats, distinct sponsors first seen, top
    phase, dates, trees, modal MeSH terms, and the least p-value of its single-arm trials (`is_single_arm`, if there) by phase.

    Lists that keep the order (`ord`) are as long as a candidate has trials; what a query does not use is not gathered. Rows are dealt by
    candidate before anything is gathered: a task that reads rows as they lie has about one of each candidate, and lists of one, with
    their orders beside them, would be made, sorted and shuffled in the place of plain rows. Each name and label is gathered by itself, so
    that a query shuffles those it uses. Without `ids` there are no `trial_ids`; `statuses` adds label.statuses()'s text.
    """
    rows = trials.withColumns({"candidate_id": key(), "rank": rank("phase")} | (approvals() if "outcome" in trials.columns else {}))
    rows = rows.repartition("candidate_id")
    labels = [x for x in LABELS if x in rows.columns]  # trials that nobody has labelled have none
    firsts = [F.min_by(x, "ord").alias(f"first_{x}") for x in ("intervention", "indication", *labels)]
    seen, terms = (F.sort_array(F.collect_list(F.struct("ord", *c))) for c in (("nct_id", "sponsor") if ids else ("sponsor",), ("mesh_drug_terms", "mesh_condition_terms")))
    single = F.col("is_single_arm") if "is_single_arm" in rows.columns else F.lit(True)
    p = lambda i: F.min(F.when(single & (F.col("phase") == f"Phase {i}"), F.col("p_value")))
    out = rows.groupBy(F.xxhash64("candidate_id").alias(_HASH), "candidate_id").agg(
        *firsts, F.count("*").alias("n_trials"), seen.alias("seen"), terms.alias("terms"), F.max("rank").alias("rank"), F.min("start_date").alias("earliest_start"), F.max("completion_date").alias("latest_completion"),
        F.collect_set("trees").alias("trees"), F.min("ord").alias("ord"), *(p(i).alias(f"p_{i}") for i in (1, 2, 3)), F.max(single & F.col("p_value").isNotNull() & F.col("phase").isNotNull()).alias("has_p"),
        *([F.sort_array(F.collect_list("status")).alias("all_status")] if statuses else []),
    )
    sponsors = F.array_distinct(F.filter(F.col("seen.sponsor"), lambda s: F.coalesce(s, F.lit("")) != ""))
    return out.select(
        "candidate_id", text.cluster_key(F.col("first_intervention")).alias("drug_name"), text.cluster_key(F.col("first_indication")).alias("indication"), F.col("first_intervention").alias("drug_name_raw"),
        *([F.col("seen.nct_id").alias("trial_ids")] if ids else []), "n_trials", vocab.lookup(F.col("rank"), _PHASES).alias("highest_phase"), sponsors.alias("sponsors"), "earliest_start", "latest_completion",
        F.sort_array(F.array_distinct(F.flatten("trees"))).alias("trees"), "ord", modal(F.flatten("terms.mesh_drug_terms")).alias("mesh_drug"), modal(F.flatten("terms.mesh_condition_terms")).alias("mesh_indication"),
        *(F.col(f"first_{x}").alias(x) for x in labels), "p_1", "p_2", "p_3", "has_p", *([counted("all_status").alias("statuses")] if statuses else []),
    )


def counted(values: str) -> Column:
    """'n Value' of each value of a sorted list, joined by commas; nulls count with no name."""
    size = lambda v: F.size(F.filter(values, lambda x: x.eqNullSafe(v))).cast("string")
    return F.array_join(F.transform(F.array_distinct(values), lambda v: F.concat_ws(" ", size(v), v)), ", ")


def labelled(trials: DataFrame, key: Strategy = string_key) -> DataFrame:
    """Trial rows with their candidate's id, labels, top rank and whether the row is the candidate's first, in one shuffle."""
    rows = trials.withColumns({"candidate_id": key(), "rank": rank("phase")} | approvals())
    whole = Window.partitionBy(F.xxhash64("candidate_id"), "candidate_id")
    first = F.min_by(F.struct("ord", *LABELS), "ord").over(whole)
    rows = rows.withColumns({"first": first, "top": F.max("rank").over(whole)}).withColumns({x: F.col(f"first.{x}") for x in LABELS})
    return rows.withColumn("is_first", F.col("first.ord") == F.col("ord")).withColumn("highest_phase", vocab.lookup(F.col("top"), _PHASES)).drop("first", "top", "rank")


def modal_terms(trials: DataFrame, key: str, terms: str) -> DataFrame:
    """Per key the most frequent lower-case term, the first seen of equals."""
    each = trials.select(key, "ord", F.posexplode(terms).alias("at", "raw")).withColumn("term", text.strip(F.lower("raw")))
    counts = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min(F.struct("ord", "at")).alias("seen"))
    return counts.groupBy(key).agg(F.min_by("term", F.struct(-F.col("n"), "seen")).alias("term"))


def two_level(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """Each canonical name with its lookup row: by the whole name, else by its first word. An empty name has none.

    The lookup is joined as it is; whether it is broadcast is left to Spark's check of its size.
    """
    exact = lookup.select(F.col("query_norm").alias("e_norm"), F.col("drug_id").alias("e_id"))
    word = lookup.select(F.col("query_norm").alias("w_norm"), F.col("drug_id").alias("w_id"))
    rows = names.withColumn("word", F.when(F.col("norm") != "", F.split("norm", " ")[0]))
    rows = rows.join(exact, (F.col("norm") == F.col("e_norm")) & (F.col("norm") != ""), "left").join(word, F.col("word") == F.col("w_norm"), "left")
    kind = F.when(F.col("e_id").isNotNull(), "exact").when(F.col("w_id").isNotNull(), "first_word").otherwise("none")
    return rows.select(*names.columns, F.coalesce("e_id", "w_id").alias("drug_id"), kind.alias("match"))


def remerged(cands: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Candidates of one drug id (else MeSH drug) and indication (MeSH, else its name) as one; the others pass through.

    A merged candidate has the first one's names and labels, distinct ids and sponsors in order, all trees, the top phase and the outer
    dates, and loses its p-values, as the result it reproduces does. Candidates without either key group by themselves, so
    that one aggregation makes all rows.
    """
    known = F.coalesce("drug_id", "mesh_drug")
    rows = (cands if keep_unmatched else cands.where(known.isNotNull())).withColumns({
        "g_drug": F.coalesce(known, "candidate_id"), "g_area": F.when(known.isNotNull(), F.coalesce("mesh_indication", "indication")), "rank": rank("highest_phase"),
    })
    trees = ["trees"] if "trees" in cands.columns else []
    n, listed = F.count("*"), F.sort_array(F.collect_list(F.struct("ord", "trial_ids", "sponsors", *trees)))
    firsts = [c for c in cands.columns if c not in ("trial_ids", "n_trials", "sponsors", "trees", "highest_phase", "earliest_start", "latest_completion", "ord", "p_1", "p_2", "p_3", "has_p")]
    sums = rows.groupBy(F.xxhash64("g_drug", "g_area").alias(_HASH), "g_drug", "g_area", known.isNull().alias("alone")).agg(
        F.min_by(F.struct(*firsts, *(c for c in ("p_1", "p_2", "p_3", "has_p") if c in cands.columns)), "ord").alias("first"), n.alias("merged"), listed.alias("parts"),
        F.max("rank").alias("rank"), F.min("earliest_start").alias("earliest_start"), F.max("latest_completion").alias("latest_completion"), F.min("ord").alias("ord"),
    )
    one, ids = F.col("merged") == 1, F.flatten("parts.trial_ids")
    ids = F.when(one, ids).otherwise(F.array_distinct(ids))
    kept = [F.when(one, F.col(f"first.{c}")).alias(c) for c in ("p_1", "p_2", "p_3", "has_p") if c in cands.columns]
    return sums.select(
        *(F.col(f"first.{c}") for c in firsts), "merged", ids.alias("trial_ids"), F.size(ids).cast("long").alias("n_trials"), F.array_distinct(F.flatten("parts.sponsors")).alias("sponsors"),
        *(F.sort_array(F.array_distinct(F.flatten(f"parts.{x}"))).alias(x) for x in trees),
        vocab.lookup(F.col("rank"), _PHASES).alias("highest_phase"), "earliest_start", "latest_completion", "ord", *kept,
    )


def coverage(cands: DataFrame) -> DataFrame:
    """Candidates and trial rows by kind of match."""
    return cands.groupBy("match").agg(F.count("*").alias("n_candidates"), F.sum("n_trials").alias("n_trial_rows"))

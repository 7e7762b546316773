"""From source rows to trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: A row goes if the field contains the value; `case` makes the test sensitive to case.
RULES = ({"field": "indication", "op": "contains", "value": "healthy", "case": False},)
KEYWORDS = ("%peptide%", "%peptides%")


def normalised(rows: DataFrame) -> DataFrame:
    """Missing text as '', phases and statuses in the fixed vocabulary."""
    names = [c for c in ("intervention", "indication", "sponsor") if c in rows.columns]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in names} | {"phase": text.phase(F.col("phase_text")), "status": text.status(F.col("status_text"))})


def rule(one: dict) -> Column:
    """Whether a row matches a rule; an unknown operation and a null field match nothing."""
    if one["op"] != "contains":
        return F.lit(False)
    field, value = F.col(one["field"]), one["value"]
    hit = F.contains(field, F.lit(value)) if one.get("case") else F.contains(F.lower(field), F.lit(value.lower()))
    return F.coalesce(hit, F.lit(False))


def filtered(rows: DataFrame, rules: tuple[dict, ...] = RULES) -> DataFrame:
    return rows.where(~reduce(lambda a, b: a | b, map(rule, rules), F.lit(False)))


def capped(rows: DataFrame, most: int | None) -> DataFrame:
    """The first joined rows in source order; the cap precedes single-arm classification."""
    return rows.orderBy("ord").limit(most) if most else rows


def arms(rows: DataFrame) -> DataFrame:
    """Per study the number of distinct drugs and conditions; null counts as a value, studies without an id don't."""
    some = rows.where(F.coalesce(F.col("nct_id"), F.lit("")) != "")
    count = lambda c: F.count_distinct(F.struct(c))
    out = some.groupBy("nct_id").agg(count("intervention").alias("drugs"), count("indication").alias("conditions"), F.count("*").alias("n_rows"))
    return out.withColumn("is_single_arm", (F.col("drugs") == 1) & (F.col("conditions") == 1))


def arm_stats(rows: DataFrame) -> DataFrame:
    """Studies by design, and the rows that a single-arm filter drops."""
    a, n = arms(rows), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    d, c, s = F.col("drugs") == 1, F.col("conditions") == 1, F.col("is_single_arm")
    return a.agg(F.count("*").alias("total"), n(s).alias("single"), n(d & ~c).alias("basket"), n(~d & c).alias("umbrella"), n(~d & ~c).alias("multi"), n(F.when(~s, F.col("n_rows"))).alias("rows_dropped"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with `is_single_arm` by arms()'s rule, in one shuffle: a study's least and greatest value are the same."""
    study = Window.partitionBy("nct_id")
    value = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("value"))
    one = [F.min(value(c)).over(study) == F.max(value(c)).over(study) for c in ("intervention", "indication")]
    return rows.withColumn("is_single_arm", (F.coalesce("nct_id", F.lit("")) != "") & one[0] & one[1])


def single_arm(rows: DataFrame) -> DataFrame:
    return rows.join(arms(rows).where("is_single_arm").select("nct_id"), "nct_id", "left_semi")


def lead(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the value of the first row in order: a correlated subquery with ORDER BY and LIMIT 1."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def term_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the sorted distinct terms, an ARRAY(SELECT DISTINCT) subquery."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("terms"))


def with_terms(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    return rows.join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def tree_numbers(conditions: DataFrame, terms: DataFrame) -> DataFrame:
    """Per study the sorted distinct tree numbers, of branches C and F, of its conditions' MeSH terms."""
    branch = F.col("tree_number").startswith("C") | F.col("tree_number").startswith("F")
    return term_sets(conditions.join(terms.where(branch), "downcase_mesh_term").select("nct_id", "tree_number"), "nct_id", "tree_number")


def sides(t: dict[str, DataFrame]) -> DataFrame:
    """What hangs on a study, one row each: lead sponsor (the least id's), sorted distinct MeSH terms of drugs and conditions, and
    the conditions' tree numbers in branches C and F; null or empty where there is none.

    The side tables are one union of rows that hold a value of one kind each, aggregated once by study: one shuffle by nct_id,
    and every table is read once. Only the vocabulary of terms meets the conditions before, one row for each term.
    """
    branch = F.col("tree_number").startswith("C") | F.col("tree_number").startswith("F")
    numbers = t["mesh_terms"].where(branch).groupBy("downcase_mesh_term").agg(F.collect_set("tree_number").alias("numbers"))
    rows = t["sponsors"].where("lead_or_collaborator = 'lead' AND id IS NOT NULL").select("nct_id", F.struct("id", "name").alias("lead"))
    for more in (
        t["browse_interventions"].where("mesh_term IS NOT NULL").select("nct_id", F.col("mesh_term").alias("drug")),
        t["browse_conditions"].join(numbers, "downcase_mesh_term", "left").select("nct_id", F.col("mesh_term").alias("condition"), "numbers"),
    ):
        rows = rows.unionByName(more, allowMissingColumns=True)
    sums = rows.groupBy("nct_id").agg(F.min("lead").alias("lead"), *(F.collect_set(x).alias(x) for x in ("drug", "condition", "numbers")))
    return sums.select(
        "nct_id", F.col("lead.name").alias("sponsor"), F.array_sort("drug").alias("mesh_drug_terms"), F.array_sort("condition").alias("mesh_condition_terms"), F.array_sort(F.array_distinct(F.flatten("numbers"))).alias("trees"),
    )


def scan(tables: dict[str, DataFrame], mesh_term: str | None = None, keywords: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """A trial row for each (study, drug, condition) of the registry's tables, in source form.

    Interventional studies, drugs only; the lead sponsor with the least id; MeSH terms and tree numbers as sorted sets, empty
    where there are none. `mesh_term` keeps studies with that very intervention term, `keywords` those with a pattern in a title
    or summary; `most` caps the joined rows in source order, before anything else is done with them. `ord` has the names too, so that
    rows whose ids are repeated have an order of their own.
    """
    t = tables
    studies = t["studies"].where(F.upper("study_type") == "INTERVENTIONAL")
    if mesh_term:
        studies = studies.join(t["browse_interventions"].where(F.col("mesh_term") == mesh_term).select("nct_id").distinct(), "nct_id", "left_semi")
    if keywords:
        studies = matching(studies, ["brief_title", "official_title"], t["brief_summaries"], "nct_id", keywords)
    drugs = t["interventions"].where(F.upper("intervention_type") == "DRUG").select("nct_id", F.col("id").alias("i_id"), F.col("name").alias("intervention"))
    rows = studies.join(drugs, "nct_id").join(t["conditions"].select("nct_id", F.col("id").alias("c_id"), F.col("name").alias("indication")), "nct_id")
    rows = rows.withColumn("ord", F.struct("nct_id", "i_id", "c_id", "intervention", "indication"))
    rows = rows.orderBy("ord").limit(most) if most else rows
    sets = ("mesh_drug_terms", "mesh_condition_terms", "trees")
    rows = rows.join(sides(t), "nct_id", "left").withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in sets})
    return rows.select("nct_id", "ord", "brief_title", F.col("phase").alias("phase_text"), F.col("overall_status").alias("status_text"), "start_date", "completion_date", "intervention", "indication", "sponsor", *sets)


def with_p_values(trials: DataFrame, values: DataFrame) -> DataFrame:
    """Trials with their study's p-values: an empty array, and no single arm, where it has none."""
    got = values.select("nct_id", "p_values")
    rows = trials.join(got, "nct_id", "left")
    return rows.withColumns({"p_values": F.coalesce("p_values", F.expr("slice(array(named_struct('outcome_id', '', 'p_value', 0D, 'significant', false)), 1, 0)")), "has_p_values": F.col("p_values").isNotNull()})


def peptides(cands: DataFrame, attributes: DataFrame) -> DataFrame:
    """Candidates whose modality has "peptide" in it, whatever else it says."""
    return cands.join(attributes.where(F.contains(F.lower("modality"), F.lit("peptide"))).select("candidate_id"), "candidate_id", "left_semi")


def matching(rows: DataFrame, titles: list[str], summaries: DataFrame, key: str, patterns: tuple[str, ...] = KEYWORDS, told: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with a keyword in a title, or in a summary of the same key (`told`, if those differ): the summaries' keys join as a flag."""
    like = lambda c, words=patterns: reduce(lambda a, b: a | b, (F.ilike(c, F.lit(p)) for p in words))
    named = summaries.where(like(F.col("description"), told or patterns)).select(F.col(key).alias("_key")).distinct()
    hit = reduce(lambda a, b: a | b, (F.coalesce(like(F.col(t)), F.lit(False)) for t in titles), F.col("_key").isNotNull())
    return rows.join(named, F.col(key) == F.col("_key"), "left").where(hit).drop("_key")


def p_values(outcomes: DataFrame, analyses: DataFrame, singles: DataFrame) -> DataFrame:
    """Primary outcomes' p-values of single-arm studies, as an array per study in the analyses' order."""
    primary = outcomes.where("outcome_type = 'PRIMARY'")
    rows = analyses.where("p_value IS NOT NULL").join(primary, ["outcome_id", "nct_id"]).join(singles, "nct_id", "left_semi")
    each = F.struct("outcome_id", F.col("p_value").cast("double").alias("p_value"), (F.col("p_value") <= 0.05).alias("significant"))
    return rows.groupBy("nct_id").agg(F.array_sort(F.collect_list(each)).alias("p_values"))

"""Predictions against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text

CLASSES = ("investigational", "approved", "commercialized")


def positive(bucket: Column, kind: str) -> Column:
    """A launch implies an approval."""
    return bucket.isin("approved", "commercialized") if kind == "approved" else bucket == kind


def matched(benchmark: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The benchmark with its predictions; unmatched rows stay, with a null."""
    return benchmark.join(predictions, keys, "left")


def metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of each class against the rest, over matched rows, from one aggregation."""
    some = pairs.where("predicted IS NOT NULL")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = []
    for k in CLASSES:
        t, p = positive(F.col("truth"), k), positive(F.col("predicted"), k)
        sums.append(F.struct(F.lit(k).alias("class"), count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn")))
    rows = some.agg(F.array(*sums).alias("all")).select(F.inline("all"))
    precision, recall = stats.ratio(F.col("tp"), F.expr("tp + fp")), stats.ratio(F.col("tp"), F.expr("tp + fn"))
    out = rows.withColumns({"precision": precision, "recall": recall, "accuracy": stats.ratio(F.expr("tp + tn"), F.expr("tp + fp + fn + tn")), "support": F.expr("tp + fn")})
    return out.withColumn("f1", stats.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluation(pairs: DataFrame) -> DataFrame:
    """Matched, unmatched, exact accuracy, and the means of the classes' metrics."""
    hit = F.col("predicted").isNotNull()
    whole = pairs.agg(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("matched"), F.coalesce(F.sum((~hit).cast("long")), F.lit(0)).alias("unmatched"), stats.ratio(F.sum((F.col("truth") == F.col("predicted")).cast("long")), F.sum(hit.cast("long"))).alias("accuracy"))
    means = metrics(pairs).agg(*((F.sum(c) / len(CLASSES)).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "accuracy")))
    return whole.join(means, F.lit(True))  # one row each


def label_errors(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows whose prediction is wrong about approval or commercialization, with the task and the kind of error.

    `labels` as by readers.raw_labels(); a launch counts as an approval.
    """
    pairs = labels.join(predictions.withColumnRenamed("indication", "match"), ["drug", "match"])
    parts = []
    for task, kind in (("approval", "approved"), ("commercialization", "commercialized")):
        says, is_ = positive(F.col("predicted"), kind), F.col(f"{task}_label")
        error = F.when(says & (is_ == "negative"), "FP").when(~says & (is_ == "positive"), "FN")
        parts.append(F.when(error.isNotNull(), F.struct(F.lit(task).alias("task"), error.alias("error"))))
    return pairs.select("drug_name", "indication", "predicted", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("drug_name", "indication", "predicted", "e.task", "e.error")


def is_resolved() -> Column:
    """Whether both labels of a row are set."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return some("commercialization_label") & some("approval_label")


def review_order(rows: DataFrame) -> DataFrame:
    """Unresolved rows by drug, whatever its case; equals by indication."""
    return rows.where(~is_resolved()).orderBy(F.lower("drug_name"), "drug_name", "indication")


def evidence() -> Column:
    """A marketing rollup in words."""
    found = F.col("ongoing") | F.col("first_marketed").isNotNull()
    day = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    words = F.concat(F.lit("NDC: "), F.when(F.col("ongoing"), "active").otherwise("inactive"), F.lit("  |  start: "), day("first_marketed", "unknown"), F.lit("  |  end: "), day("last_marketed", "ongoing"))
    return F.when(F.coalesce(found, F.lit(False)), words).otherwise("NDC: not found")


def marketed(records: DataFrame, key: str) -> DataFrame:
    """Marketing of each drug from its product records (start, end, application_number, nested_numbers, labeler, ord).

    Ongoing if a record has no end; the first start, the last end unless ongoing, the first application number (its own, else
    the first nested one) with its address, the first labeler. A drug without records has no row here.
    """
    open_ = F.bool_or(F.col("end").isNull())
    own = text.application_number(F.col("application_number"), F.get("nested_numbers", F.lit(0)))
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("ord")))
    sums = records.groupBy(key).agg(open_.alias("ongoing"), F.min("start").alias("first_marketed"), F.when(~open_, F.max("end")).alias("last_marketed"), first(own).alias("application_number"), first(F.col("labeler")).alias("sponsor"))
    return sums.withColumn("overview_url", text.application_url(F.col("application_number")))


def approval_texts(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Each distinct drug name with its labels' indications joined by ' | ', by the name itself, else whatever its case; '' for none."""
    exact = labels.select(F.col("query").alias("name"), F.array_join("indications", " | ").alias("exact"))
    loose = labels.groupBy(F.lower("query").alias("low")).agg(F.array_join(F.min_by("indications", "query"), " | ").alias("loose"))
    rows = names.select("name").distinct().join(exact, "name", "left").withColumn("low", F.lower("name")).join(loose, "low", "left")
    return rows.select("name", F.coalesce("exact", "loose", F.lit("")).alias("indications"))


def prompts(rows: DataFrame, order: str) -> DataFrame:
    """A numbered prompt for each pair, blanks as Unknown; the number is `order`."""
    plain = lambda c: F.coalesce(F.nullif(text.strip(F.col(c)), F.lit("")), F.lit("Unknown"))
    drug, area = plain("drug_name"), plain("indication")
    lines = [
        F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), drug, F.lit(" / "), area), F.concat(F.lit("Drug name: "), drug), F.concat(F.lit("Indication: "), area), F.concat(F.lit("Highest phase reached: "), plain("highest_phase")),
        F.lit("Number of trials: (see trial record)"), F.concat(F.lit("Sponsors: "), plain("sponsors")), F.lit("Earliest trial start: Unknown"), F.lit("Latest trial completion: Unknown"),
    ]
    return rows.select(order, F.concat_ws("\n", *lines).alias("prompt"))


def errors(pairs: DataFrame) -> DataFrame:
    """Rows that are false for a class, with the kind of error."""
    some = pairs.where("predicted IS NOT NULL")
    parts = []
    for k in CLASSES:
        t, p = positive(F.col("truth"), k), positive(F.col("predicted"), k)
        parts.append(F.when(t != p, F.struct(F.lit(k).alias("class"), F.when(p, "FP").otherwise("FN").alias("error"))))
    return some.select("*", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("e")).select(*pairs.columns, "e.class", "e.error")


def positional(one: DataFrame, two: DataFrame, order_one: str, order_two: str, within: list[str]) -> DataFrame:
    """Rows of two frames by their place within a group, up to the shorter."""
    number = lambda f, o: f.withColumn("at", F.row_number().over(Window.partitionBy(*within).orderBy(o)))
    return number(one, order_one).join(number(two, order_two), [*within, "at"])


def overlaid(rows: DataFrame, state: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A saved row wins as a whole; without one the fields are blank."""
    return rows.join(state, keys, "left").select(*rows.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in fields))


def synonyms(names: DataFrame) -> DataFrame:
    """Every other name of the same drug id."""
    a, b = names.alias("a"), names.alias("b")
    return a.join(b, (F.col("a.drug_id") == F.col("b.drug_id")) & (F.lower("a.name") != F.lower("b.name"))).select("a.name", F.col("b.name").alias("synonym")).distinct()


def unseen(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows whose name, lower case and stripped, is not among the known ones."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    return rows.join(known.select(key(name).alias("_k")).distinct(), key(name) == F.col("_k"), "left_anti")


def turn(id_col: str, seed: int) -> Column:
    """A row's place in an order that depends on id and seed only: a digest that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample(rows: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, those with the least digests of seed and id.

    Spark limits every task's rows to n of each group before they are shuffled, so that a group of any size is n rows a task.
    """
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(turn(id_col, seed), id_col))).where(F.col("rn") <= n).drop("rn")


def shuffled(rows: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on id and seed only."""
    return rows.orderBy(turn(id_col, seed), id_col)


def weak_label(outcome: Column) -> Column:
    return F.when(F.startswith(outcome, F.lit("Failed")), "Clinical").when(outcome.isin("Approved", "Commercialized"), "Post-Clinical").otherwise("Other")

"""Files and the label cache."""

from __future__ import annotations

import glob
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vocab

# Columns of the label file, in its order, and of the drug lookup.
LABELS = "drug_name string, indication string, commercialization_label string, approval_label string, commercialization_evidence string, approval_evidence string, application_number string, drugsatfda_overview_url string, sponsor string, notes string"
LOOKUP = "drug_id string, query_name string, query_norm string, modality string"
PREDICTIONS = "drug_name string, indication string, outcome string"


def source(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A trial table by JDBC (see database.py for one with a configuration) or from Parquet; the REST source is not there yet."""
    if kind == "jdbc":
        return spark.read.format("jdbc").options(sessionInitStatement=f"SET search_path TO {options.pop('schema', 'ctgov')}", **options).load()
    if kind == "parquet":
        return spark.read.parquet(options["path"])
    if kind == "api":
        raise NotImplementedError("the REST source is not implemented")
    raise ValueError(f"unknown source {kind!r}")


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header; an empty field is null. Quoted fields may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def replies(spark: SparkSession, path: str) -> DataFrame:
    """Text files, each a JSON array or an object per line, as rows of objects; a line that is no object fails."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), text.strip(F.col("value")).alias("body"))
    array = F.when(F.startswith("body", F.lit("[")), F.from_json("body", "array<map<string,string>>"))
    lines = F.transform(F.filter(F.split("body", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "map<string,string>", {"mode": "FAILFAST"}))
    return whole.select("file", F.posexplode(F.coalesce(array, lines)).alias("at", "item"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order: upsert and last-write-wins."""
    keep = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(keep).select("r.*")


def drug_lookup(spark: SparkSession, path: str, schema: str = LOOKUP) -> tuple[DataFrame, DataFrame]:
    """The drug lookup's fullest row for each name and for each normal form, from its CSV file; of equals the first in the file.

    Rows are told apart by their place among the file's rows as Spark reads them in order.
    """
    rows = csv(spark, path, schema).withColumn("pos", F.monotonically_increasing_id())
    return tuple(best_rows(rows, key, "pos").drop("pos") for key in ("query_name", "query_norm"))


def synonym_names(spark: SparkSession, path: str) -> DataFrame:
    """(drug_id, query_norm, name) of the lookup file, which is read once."""
    return csv(spark, path, LOOKUP).select("drug_id", "query_norm", F.col("query_name").alias("name")).cache()


def prompt(path: str) -> str:
    """A prompt's text, without outer white space."""
    return Path(path).read_text(encoding="utf-8").strip()


def state(spark: SparkSession, path: str) -> DataFrame:
    """The label file that a review left; no rows where there is none yet."""
    if not glob.glob(path):
        return spark.createDataFrame([], LABELS)
    return csv(spark, path, LABELS)


def summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """A candidate summary as it was written, with types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(drug, indication, predicted) of a predictions file; of repeated pairs the last."""
    return predictions(csv(spark, path, PREDICTIONS).withColumn("ord", F.monotonically_increasing_id()))


def predictions(rows: DataFrame) -> DataFrame:
    """(drug, indication, predicted) by match keys, the bucket of the outcome; of repeated pairs the last by `ord`."""
    keyed = rows.select(text.match_key(F.col("drug_name")).alias("drug"), text.match_key(F.col("indication")).alias("indication"), bucket_of(F.trim(F.coalesce("outcome", F.lit("")))).alias("predicted"), "ord")
    return latest(keyed, ["drug", "indication"], ["ord"]).drop("ord")


def predictions_of(cands: DataFrame, outcomes: DataFrame) -> DataFrame:
    """predictions() of the candidates that have an outcome."""
    return predictions(outcomes.select("candidate_id", "outcome").join(cands.select("candidate_id", "drug_name", "indication", F.col("candidate_id").alias("ord")), "candidate_id"))


def cache_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of the same key."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["cache_key"], ["turn", "created_at"]).drop("turn")


def cache_migrate(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache with areas in their normal form, and the number of changed rows by the old area."""
    new = text.disease_area(F.col("disease_area"))
    changed = cache.where(new != F.col("disease_area")).groupBy(F.col("disease_area").alias("old_area")).agg(F.count("*").alias("n"))
    return cache.withColumn("disease_area", new), changed


def best_rows(lookup: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the row with most filled columns, the first of equals; null is a key."""
    filled = sum(F.col(c).isNotNull().cast("int") for c in lookup.columns if c != order)
    return lookup.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(filled.desc(), order))).where("rn = 1").drop("rn")


def _usable() -> Column:
    """Whether both labels of a row are known."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~(plain("approval_label").isin("unknown", "ambiguous") | plain("commercialization_label").isin("unknown", "ambiguous"))


def skipped(labels: DataFrame) -> DataFrame:
    """How many benchmark rows have a label that is not known."""
    return labels.agg(F.coalesce(F.sum((~_usable()).cast("long")), F.lit(0)).alias("skipped"))


def raw_labels(labels: DataFrame) -> DataFrame:
    """Usable benchmark rows with their two labels and match keys; of repeated pairs the last by `ord`."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    rows = labels.where(_usable()).select(text.match_key(F.col("drug_name")).alias("drug"), text.match_key(F.col("indication")).alias("match"), "drug_name", "indication", plain("approval_label"), plain("commercialization_label"), "ord")
    return latest(rows, ["drug", "match"], ["ord"]).drop("ord")


def benchmark(labels: DataFrame) -> DataFrame:
    """Usable benchmark rows: match keys and bucket; of repeated pairs the last by `ord`."""
    usable = labels.where(_usable())
    says = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))) == "positive"
    bucket = F.when(says("commercialization_label"), "commercialized").when(says("approval_label"), "approved").otherwise("investigational")
    rows = usable.select(text.match_key(F.col("drug_name")).alias("drug"), text.match_key(F.col("indication")).alias("indication"), bucket.alias("truth"), "ord")
    return latest(rows, ["drug", "indication"], ["ord"])


def bucket_of(c: Column) -> Column:
    """Evaluation bucket of an outcome's value or name."""
    value = F.coalesce(vocab.lookup(c, vocab.OUTCOMES), c)
    return vocab.lookup(value, vocab.BUCKETS, "investigational")

"""From raw documents to packed sequences: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it to the shared folder and reads it
again as the next stage's docs. All but the last return the columns of documents, whatever further ones there are. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflux.llm import exact_dedup, minhash_dedup, packing, quality, substring_dedup
from phaseflux.llm.queries import vocabulary
from phaseflux.llm.scratch import Scratch

#: The stage of each running pipeline that has made tables last, and these.
_open: dict[tuple[str, str, int], tuple[int, Scratch]] = {}


def _scratch(spark: SparkSession, sf_dir: str, stage: int) -> Scratch:
    """A stage's own tables. Those of the stage before, in the same session, folder and thread, are deleted: its result is
    written by now. Other pipelines' tables stay; the last ones go when the interpreter ends."""
    key = (spark.sparkContext.applicationId, sf_dir, get_ident())
    before, tables = _open.get(key, (stage, None))
    if tables and before < stage:
        tables.close()
    _open[key] = (stage, Scratch(spark))
    return _open[key][1]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null, empty and blank texts are rejected; a null id is judged like others; of repeated rows all stay or none."""
    return quality.keep_quality(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the smallest id; null texts count as empty; a null id stays only if no other row has the text; of repeated rows one stays."""
    return exact_dedup.keep_exact(docs, _scratch(spark, sf_dir, 1))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, similarity 0.8 or more. Texts without words, and rows without an id, stay."""
    return minhash_dedup.keep_near(docs, _scratch(spark, sf_dir, 2))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; a document without words left goes, one without any from the start stays. A null id counts as the greatest. `n_chars`, if there, follows the text."""
    out = substring_dedup.cut_spans(docs, _scratch(spark, sf_dir, 3))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences. Null and empty texts are one closing id; null ids are packed like others."""
    return packing.pack(docs, _scratch(spark, sf_dir, 4), vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier and the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder."""
    tables = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), before)
        before = docs
    return docs

"""Row numbers of whole tables, with no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.shared import kept

_WITHIN = (1 << 33) - 1


def ordered(rows: DataFrame, *order: str, name: str = "at", start: int = 1) -> DataFrame:
    """Rows with their number in the order of some columns (rows that are equal in all of them get numbers in any order).

    Rows are dealt by ranges and numbered within each; one count for each range gives its first number. The dealt rows are written
    to the shared folder, as the ranges' bounds would be drawn anew if they were dealt again.
    """
    within = F.monotonically_increasing_id().bitwiseAND(_WITHIN)
    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": within}))
    starts, total = {}, start
    for r in sorted(dealt.groupBy("_part").count().collect()):  # a row for each range
        starts[r["_part"]], total = total, total + r["count"]
    number = F.col("_at") + (vocab.lookup(F.col("_part"), starts) if starts else F.lit(start))
    return dealt.withColumn(name, number.cast("long")).drop("_part", "_at")


def in_files(rows: DataFrame, name: str = "at", start: int = 1) -> DataFrame:
    """Rows of files with their number in the order of (file's path, place in the file).

    Spark deals blocks of files to tasks by size, so that the order of its row ids is not that of the files. Within a
    block ids are consecutive; the blocks' counts, in order of path and offset, give each block's first number.
    """
    block = ["_file", "_block"]
    read = kept(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    blocks = read.groupBy(*block).agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block of a file
    firsts = blocks.select(*block, (before + start - F.col("_least")).alias("_first"))
    return read.join(firsts, block).withColumn(name, F.col("_id") + F.col("_first")).drop(*block, "_id", "_first")

"""Incremental upkeep of the label cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.cachefiles import Cache
from ..sources.readers import cache_upsert


def keep_cache(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of labels into the versions of a cache table, one folder for each micro-batch.

    A batch that runs again writes the same folder again, so each label counts once. The newest version is complete. For tables
    that are large against a batch see keep_parts().
    """
    spark = labels.sparkSession

    def upsert(rows: DataFrame, batch: int) -> None:
        old = spark.read.schema(rows.schema).parquet(f"{path}/v{batch - 1}") if batch else rows.limit(0)
        cache_upsert(old, rows).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/v{batch}")

    return labels.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_parts(labels: DataFrame, cache: Cache, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of labels into a bucketed cache: a micro-batch rewrites the parts that its keys are in.

    A batch that runs again finds its own labels and leaves them as they are, so each counts once.
    """
    return labels.writeStream.foreachBatch(lambda rows, _: cache.upsert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

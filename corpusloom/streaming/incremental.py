"""Incremental runs over folders that grow, with the same rows as the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import caches
from ..sources.read import exists


def prepare_stream(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Applies a row-wise transform to the files that have come since the last run, then stops.

    The checkpoint makes each file count once, also after a restart.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (
        transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
        .outputMode("append").trigger(availableNow=True).start())


def generate_stream(spark: SparkSession, source: str, schema, cache_path: str, fingerprint: str, generate, checkpoint: str) -> StreamingQuery:
    """Fills a result cache from a growing folder of (id, in, text): each batch computes only what the cache lacks.

    So a batch that is run again after a failure adds nothing; the first run finds no cache and starts one.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        schema_ = "id string, fp string, `in` string, prediction string, seq bigint"
        known = spark_.read.schema(schema_).json(cache_path) if exists(spark_, cache_path) else spark_.createDataFrame([], schema_)
        new = caches.run_with_cache(batch, known, fingerprint, generate).withColumn("seq", F.lit(batch_id).cast("bigint"))
        new.write.mode("append").json(cache_path)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop(query: StreamingQuery) -> None:
    """Cancels a run; its next start goes on from the last finished batch."""
    query.stop()

"""An append-only store of keyed rows that a stream fills: each key is written once, however often and wherever a run resumes.

The same functions serve files that keep arriving and one pass over what is there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incoming(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(store: str, schema: str, key: str = "key", order: str | None = None):
    """A batch writer that appends rows whose key the store does not have; of equal keys in a batch, the first by order.

    A batch that is tried again finds its rows in the store and adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*") if order else batch.dropDuplicates([key])
        rows.join(stored(spark, store, schema).select(key), key, "left_anti").select(*batch.columns).write.mode("append").parquet(store)

    return write


def keep_store(stream: DataFrame, store: str, checkpoint: str, schema: str, key: str = "key", order: str | None = None, once: bool = True) -> StreamingQuery:
    """Starts to fill the store; with once, it ends after all that is there now."""
    writer = stream.writeStream.foreachBatch(append_new(store, schema, key, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def first_seen(stream: DataFrame, key: str = "key", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key in a stream. With an event time, state is kept for so long only; without, for ever."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_status(stream: DataFrame, by: str = "agent_id") -> DataFrame:
    """Counts and cost so far, by agent: for complete or update output."""
    return stream.groupBy(by).agg(F.count("*").alias("done"), F.count_if("passed").alias("passed"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))

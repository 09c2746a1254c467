"""Predictions as a stream: files arrive, repeated answers are dropped, the table grows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources.readers import exists


def prediction_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines files of a folder as they arrive, one row a line; lines that aren't objects of the
    schema are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("v"))
    return parsed.where(F.col("v").isNotNull()).select("r.*")


def first_answers(stream: DataFrame, event_time: str = "arrived", lateness: str = "1 hour") -> DataFrame:
    """The first answer of each (run_id, model_alias, doc_id); the state is bounded by the watermark."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["run_id", "model_alias", "doc_id"])


def append_new(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("run_id", "model_alias", "doc_id")) -> StreamingQuery:
    """Each batch appended to a Parquet table without the rows whose keys it has already: a run that
    is resumed, or a batch that is repeated after a failure, adds nothing twice.

    The table is partitioned by the first key, and only the partitions of a batch's own values are held
    against it, so a batch costs what its runs have and not what the table has.
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        if exists(batch.sparkSession, table):
            have = batch.sparkSession.read.parquet(table).select(*keys)
            values = batch.select(keys[0]).distinct()
            near = have.join(F.broadcast(values), keys[0], "left_semi")  # prunes partitions at run time
            same = [fresh[k].eqNullSafe(near[k]) for k in keys]
            fresh = fresh.join(near, functools.reduce(operator.and_, same), "left_anti")
        fresh.write.mode("append").partitionBy(keys[0]).parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """A complete aggregate kept as a Parquet table, written anew with every batch."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(table)
    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str = "ts", width: str = "1 hour", lateness: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows and mean value per key and tumbling window, late rows admitted up to ``lateness``."""
    w = F.window(event_time, width)
    return stream.withWatermark(event_time, lateness).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))

"""Incremental ingestion by file, and event-time windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def keep_latest(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by `order`; of rows that are equal there, the one of the smallest hash."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*batch.columns))
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingest_partitions(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Takes in new files of a folder once, row by row into the researches they hold; runs again from its checkpoint.

    A batch is merged with the stored rows of its researches, and only their partitions are written, so a file with some
    of a research's documents keeps the others, and a batch that runs twice changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch
        try:
            stored = spark.read.schema(schema).parquet(target)
            touched = batch.select(F.col("research_id").alias("_research")).distinct()
            rows = batch.unionByName(stored.join(touched, F.col("research_id").eqNullSafe(F.col("_research")), "left_semi"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # nothing is stored before the first batch
                raise
        merged = cut(keep_latest(rows, ["research_id", "patent_id"], ["updated_at"]), "ingest")
        merged.write.partitionBy("research_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window; on a stream, rows later than `late` behind the watermark are dropped."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("_w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "events", "total")

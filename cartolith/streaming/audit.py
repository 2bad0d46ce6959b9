"""An audit log that takes each idempotency key once, from files that come in at any time and more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materials import appended_audit
from ..sources.committed import CommittedTable

ROW = "at timestamp, action string, idempotency_key string, detail string"


def audit_log(spark: SparkSession, folder: str) -> CommittedTable:
    return CommittedTable(spark, folder, ROW)


def append_stream(spark: SparkSession, source: str, log: CommittedTable, checkpoint: str, horizon: str = "1 day"):
    """Takes new JSON-lines files of a folder into the log; ends when all are in, and goes on from its checkpoint.

    Keys are remembered as state for `horizon` after the file that brought them was written, so most repeats never reach the
    log; the watermark runs on the files' times and not on the rows' own, so a row of an old date is no reason to drop it.
    What state has forgotten, or a new checkpoint never knew, is held against the stored log. A batch is one commit under the
    stream's and its own number, so a batch that runs twice is taken once. Lines that are no JSON are left out; rows without
    a key are always taken, once for each time their file is read.
    """
    files = spark.readStream.schema(f"{ROW}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(source)
    rows = files.withColumn("_written", F.col("_metadata.file_modification_time")).where("_bad IS NULL").drop("_bad")
    keyed = rows.withColumn("_key", F.coalesce("idempotency_key", F.uuid()))
    fresh = keyed.withWatermark("_written", horizon).dropDuplicatesWithinWatermark(["_key"])

    def put(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{stream}.{number:09d}"
        if name not in log.commits():
            log.append(appended_audit(log.read().select(*log.columns), batch.select(*log.columns)), name)

    return fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(log: CommittedTable, last: int) -> DataFrame:
    """The newest rows, of 1 to 1000; rows of one time by action and key."""
    return log.read().select(*log.columns).orderBy(F.col("at").desc_nulls_last(), "action", "idempotency_key").limit(min(1000, max(1, last)))

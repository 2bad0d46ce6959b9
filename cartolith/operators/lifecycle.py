"""Upserts, retention, set differences and run counts, as keep-latest joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with new's rows in the place of equal keys; of equal keys in new the first by `order`, and then by a hash of the row, so that reruns agree."""
    fresh = latest(new, keys, [*(order or []), F.xxhash64(*new.columns)])
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def put_artifacts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts with new ones in the place of equal keys, the one updated last first."""
    return upsert(old, new, keys, [F.col("updated_at").desc_nulls_last()])


def upsert_existing(documents: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with the columns of matching results filled in and the state ready; results without a document are ignored."""
    fresh = latest(results, keys, [F.xxhash64(*results.columns)]).withColumn("_hit", F.lit(True))
    joined = documents.alias("d").join(fresh.alias("r"), keys, "left")
    columns = []
    for c in documents.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c == "analysis_state":
            columns.append(F.when(F.col("_hit"), "ready").otherwise(F.col("d.analysis_state")).alias(c))
        elif c in results.columns:
            columns.append(F.coalesce(F.col(f"r.{c}"), F.col(f"d.{c}")).alias(c))
        else:
            columns.append(F.col(f"d.{c}"))
    return joined.select(*columns)


def put_embeddings(old: DataFrame, new: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors of documents that exist; newer ones replace older ones."""
    return upsert(old, new.join(documents.select(*keys), keys, "left_semi"), keys)


def orphans(vectors: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    return vectors.join(documents.select(*keys), keys, "left_anti")


def newest_runs(runs: DataFrame, by: list[str], keep: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("run_id").desc())
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    return latest(artifacts, ["patent_id", "artifact_type"], [F.col("updated_at").desc(), F.col("run_id").desc()])


def having_all_artifacts(artifacts: DataFrame, types: list[str]) -> DataFrame:
    held = artifacts.where(F.col("artifact_type").isin(types)).groupBy("patent_id").agg(F.count_distinct("artifact_type").alias("types"))
    return held.where(F.col("types") == len(types)).select("patent_id")


def list_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, continued and removed keys between two lists."""
    a = old.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_old", F.lit(True))
    b = new.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("continued")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def pipeline_counts(documents: DataFrame, retry: DataFrame | None = None, key: str = "patent_id") -> DataFrame:
    """Run counts. Documents to be retried are moved before counting: ready ones are pending and failed, invalid
    ones pending, pending ones failed, skipped ones pending and failed."""
    again = F.lit(False)
    if retry is not None:
        documents = documents.join(retry.select(key).distinct().withColumn("_again", F.lit(True)), key, "left")
        again = F.coalesce("_again", F.lit(False))
    state = F.col("analysis_state")
    pending = F.when(again, state.isin("ready", "invalid", "skipped")).otherwise(state == "pending")
    failed = F.when(again, state.isin("ready", "pending", "skipped")).otherwise(state == "invalid")
    return documents.agg(
        F.count("*").alias("total"),
        F.count_if("pdf_available").alias("available"),
        F.count_if(~again & (state == "ready")).alias("finalized"),
        F.count_if(pending).alias("pending"),
        F.count_if(~again & (state == "skipped")).alias("skipped"),
        F.count_if(failed).alias("failed"),
    )


def ready_state(required: list[str], skip: Column | None = None) -> Column:
    """skipped if `skip`; ready with all required fields; invalid with some; pending with none."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0))
    state = F.when(filled == len(required), "ready").when(filled > 0, "invalid").otherwise("pending")
    return state if skip is None else F.when(skip, "skipped").otherwise(state)


def write_research(documents: DataFrame, path: str) -> None:
    """Replaces the partitions of the researches that `documents` holds, and no others."""
    documents.write.partitionBy("research_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def embedding_summary(vectors: DataFrame, column: str) -> DataFrame:
    size = F.size(column)
    return vectors.where(F.col(column).isNotNull()).agg(F.count("*").alias("count"), F.coalesce(F.max(size), F.lit(0)).alias("max_dimensions"), F.coalesce(F.min(size), F.lit(0)).alias("min_dimensions"))

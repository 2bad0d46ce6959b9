"""The document model over the driver's tables: orders are documents, suppliers of their lines the organizations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Tables

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    who = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    key, state = F.col("o_orderkey"), F.pmod(F.col("o_orderkey"), F.lit(10))
    ready = state >= 2
    rank = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("int")
    return rows.select(
        F.col("r_name").alias("research_id"),
        key.alias("patent_id"),
        key.alias("position"),
        F.col("c_name").alias("title"),
        F.col("o_orderpriority").alias("applicant"),
        F.col("c_mktsegment").alias("category"),
        F.when(key % 17 != 0, F.year("o_orderdate")).alias("year"),
        F.when(key % 11 == 0, "legacy").otherwise("application_date").alias("year_source"),
        F.col("o_orderstatus").alias("source_status"),
        F.when(F.col("o_orderstatus") == "F", "rights_acquired").when(F.col("o_orderstatus") == "O", "under_examination").otherwise("published").alias("legal_status_category"),
        F.when(state == 0, "pending").when(state == 1, "skipped").otherwise("ready").alias("analysis_state"),
        (key % 3 != 0).alias("pdf_available"),
        F.when(ready, F.substring("o_orderpriority", 1, 1).cast("int")).alias("similarity"),
        F.when(ready, rank).alias("concept_level"),
        F.when(ready, F.col("c_nationkey")).alias("tech_cluster_id"),
        F.when(ready, F.col("o_custkey") % 7).alias("problem_cluster_id"),
        F.when(ready, F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("tech_cluster"),
        F.when(ready, F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string"))).alias("problem_cluster"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    bridge = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patent_id"), F.col("l_suppkey").alias("organization_id")).distinct()
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("organization_id"), F.col("s_name").alias("name"))
    return Tables(documents(spark, sf_dir), bridge, names)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.groupBy((F.col("s_suppkey") % 10).alias("group_id")).agg(F.collect_list("s_suppkey").alias("member_ids"))


def artifacts(docs: DataFrame) -> DataFrame:
    """Made-up artifacts: one to three types a document, each in two runs."""
    kinds = F.array(*[F.lit(k) for k in ("score", "summaries", "embedding")])
    rows = docs.select("patent_id", F.explode(F.slice(kinds, F.lit(1), (F.col("patent_id") % 3 + 1).cast("int"))).alias("artifact_type"))
    return rows.select("*", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("run_id")).withColumn("updated_at", F.when((F.col("run_id") == "r1") & (F.col("patent_id") % 5 == 0), 3).otherwise(F.when(F.col("run_id") == "r1", 1).otherwise(2)))


#: The same binding for DuckDB.
SQL = """docs AS (SELECT r_name AS research_id, o_orderkey AS patent_id, o_orderkey AS position, c_name AS title, o_orderpriority AS applicant, c_mktsegment AS category,
  CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate)::INTEGER END AS year, CASE WHEN o_orderkey % 11 = 0 THEN 'legacy' ELSE 'application_date' END AS year_source,
  o_orderstatus AS source_status, CASE o_orderstatus WHEN 'F' THEN 'rights_acquired' WHEN 'O' THEN 'under_examination' ELSE 'published' END AS legal,
  CASE o_orderkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'skipped' ELSE 'ready' END AS state, o_orderkey % 3 <> 0 AS pdf_available,
  CASE WHEN o_orderkey % 10 >= 2 THEN substr(o_orderpriority, 1, 1)::INTEGER END AS similarity,
  CASE WHEN o_orderkey % 10 >= 2 THEN list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)::INTEGER END AS concept_level,
  CASE WHEN o_orderkey % 10 >= 2 THEN c_nationkey END AS tech, CASE WHEN o_orderkey % 10 >= 2 THEN o_custkey % 7 END AS problem
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bridge AS (SELECT DISTINCT l_orderkey AS patent_id, l_suppkey AS organization_id FROM lineitem)"""

"""A research's own files: its configuration and company text, its pool of documents, and what of them was read before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import materials

# How stored extractions may be used, and what is decided.
POLICIES = ("cache", "verify_original", "reextract")
REUSED, EXTRACT = "reused", "created"


def read_researches(spark: SparkSession, root: str) -> DataFrame:
    """(research_id, name, description, company_technology, config, problem) of every folder below root with a configuration or a company text.

    A folder's name and an empty description stand in for a missing research.json. company_tech.txt comes before the
    configuration's own company_technology. problem is config_not_json, company_text_empty or null: such rows are
    kept, so that the caller may refuse them. All files are read in one scan.
    """
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{research.json,company_tech.txt}").text(base, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = files.select("value", F.regexp_extract(path, r"([^/]+)/[^/]+/?$", 1).alias("research_id"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), F.regexp_extract(path, r"^(.*?)/[^/]+/[^/]+$", 1).alias("_parent"))
    own = named.where(F.endswith(F.col("_parent"), F.lit(base.split(":")[-1].rstrip("/").rsplit("/", 1)[-1])))
    wide = own.groupBy("research_id").agg(F.max(F.when(F.col("file") == "research.json", F.col("value"))).alias("config"), F.max(F.when(F.col("file") == "company_tech.txt", F.col("value"))).alias("_text"))
    get = lambda f: F.coalesce(F.get_json_object("config", f"$.{f}"), F.lit(""))
    text = F.regexp_replace("_text", r"(?U)^\s+|\s+$", "")
    problem = F.when(F.col("config").isNotNull() & F.try_parse_json("config").isNull(), "config_not_json").when(text == "", "company_text_empty")
    return wide.select(
        "research_id",
        F.when(F.col("config").isNull(), F.col("research_id")).otherwise(F.coalesce(F.get_json_object("config", "$.name"), F.col("research_id"))).alias("name"),
        get("description").alias("description"),
        F.coalesce(F.nullif(text, F.lit("")), F.regexp_replace(get("company_technology"), r"(?U)^\s+|\s+$", "")).alias("company_technology"),
        F.coalesce("config", F.to_json(F.struct(F.col("research_id").alias("name"), F.lit("").alias("description")))).alias("config"),
        problem.alias("problem"),
    )


def pool_names(files: DataFrame) -> DataFrame:
    """(key, pdfs): for each document number of a pool's files (pdf) their names in order; names without a number have none.

    A pool is a folder, so names are few for a number; numbers are as many as there are.
    """
    stem = F.regexp_replace("pdf", r"(?i)\.pdf$", "")
    keyed = files.where(F.lower("pdf").endswith(".pdf")).select(N.match_key(N.publication_number(stem)).alias("key"), "pdf").where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("pdf")).alias("pdfs"))


def pool_signature(files: DataFrame) -> DataFrame:
    """(files, signature): one row that changes when a file (pdf, modified, length) of the pool comes, goes or changes.

    Digests of the files are added up, so no order and no list of all names is needed.
    """
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\n", "pdf", F.col("modified").cast("string"), F.col("length").cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(digest), F.lit(0)).cast("string")), 256).alias("signature"))


def extraction_decisions(files: DataFrame, cache: DataFrame, policy: str) -> DataFrame:
    """files (path, sha256) with what is done about each: reused, or created by reading it anew.

    cache (sha256, pdf_sha256, has_text, has_pages) is the stored manifests by content. One is used if it is of the very
    content, both parts are there and the policy is not to extract again; an unknown policy is a ValueError. Of files
    with one content only the first path is created, the others wait for it and are reused.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown reading policy: {policy}")
    whole = F.col("pdf_sha256").eqNullSafe(F.col("sha256")) & F.coalesce(F.col("has_text") & F.col("has_pages"), F.lit(False))
    held = cache.groupBy("sha256").agg(F.bool_or(whole).alias("_held")).select(F.col("sha256").alias("_key"), "_held")
    first = files.groupBy("sha256").agg(F.min("path").alias("_first")).select(F.col("sha256").alias("_s"), "_first")
    joined = files.join(held, F.col("sha256") == F.col("_key"), "left").join(first, F.col("sha256").eqNullSafe(F.col("_s")))
    known = F.coalesce("_held", F.lit(False)) & F.lit(policy != "reextract")
    return joined.select(*files.columns, F.when(known | (F.col("path") != F.col("_first")), REUSED).otherwise(EXTRACT).alias("cache_decision"), F.lit(policy).alias("source_policy"))


def extraction_manifests(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, nonempty_pages, characters, text_sha256, text, skip_reason) of pages (doc_id, page, text) just read."""
    texts = materials.document_texts(pages)
    full = pages.groupBy(F.col("doc_id").alias("_d")).agg(F.count_if(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")).alias("nonempty_pages"))
    out = texts.join(full, F.col("doc_id") == F.col("_d"))
    return out.select("doc_id", "pages", "nonempty_pages", "characters", F.sha2("text", 256).alias("text_sha256"), "text", "skip_reason")

"""Document lists: CP932 CSV, JSON manifests, and the file pool they are matched with."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.vocabulary import CSV_COLUMNS

ROW = "path string, line int, " + ", ".join(f"c{i} string" for i in range(len(CSV_COLUMNS))) + ", error string"
NAMES = ("no", "ai_score", "application_number", "application_date", "publication_numbers", "publication_dates", "registration_number", "registration_date", "applicant", "title", "source_status")


def parse_list(raw: bytes) -> Iterator[tuple]:
    """(line, cells, error): strict CP932, the exact header, short rows filled up, blank lines passed over."""
    try:
        rows = csv.reader(io.StringIO(raw.decode("cp932"), newline=""))
        if tuple(next(rows, ())) != CSV_COLUMNS:
            yield 1, None, "header"
            return
    except UnicodeDecodeError:
        yield 0, None, "encoding"
        return
    for cells in rows:
        if cells:
            extra = len(cells) > len(CSV_COLUMNS)
            yield rows.line_num, None if extra else cells + [""] * (len(CSV_COLUMNS) - len(cells)), "extra_cells" if extra else None


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all list files under a path, with file, line and error. Files are read whole, as rows may span lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                out = [(name, line, *(cells or [None] * len(CSV_COLUMNS)), error) for line, cells, error in parse_list(bytes(raw))]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "content").mapInPandas(run, ROW)
    return rows.select("path", "line", *[F.col(f"c{i}").alias(n) for i, n in enumerate(NAMES)], "error")


def newest_list(files: DataFrame) -> DataFrame:
    """(path, newest) of patent_list_<14 digits>.csv files whose digits are a date and time: the newest one of each folder is the
    list that counts, the others are its history. Of equal times the greater name is newer; other files are left out."""
    stamp, folder = F.regexp_extract("path", r"(?:^|/)patent_list_(\d{14})\.csv$", 1), F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    rows = files.withColumn("_stamp", stamp).where(F.try_to_timestamp("_stamp", F.lit("yyyyMMddHHmmss")).isNotNull())
    newest = Window.partitionBy(folder).orderBy(F.col("_stamp").desc(), F.col("path").desc())  # a folder's few files
    return rows.withColumn("newest", F.row_number().over(newest) == 1).select("path", "newest")


def documents_from_list(rows: DataFrame, research_id: str) -> DataFrame:
    """Document rows of a parsed list; cells are cleaned of control characters and scores that are not numbers are null."""
    clean = rows.where("error is null").select("path", "line", *[N.clean_cell(F.col(c)).alias(c) for c in NAMES])
    number = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("registration_number", "publication_numbers", "application_number")])
    w = Window.partitionBy("path").orderBy("line")
    return clean.select(
        F.lit(research_id).alias("research_id"),
        F.row_number().over(w).alias("position"),
        "no",
        F.trim("ai_score").try_cast("double").alias("source_ai_score"),
        "application_number",
        F.replace(F.trim("application_date"), F.lit("."), F.lit("-")).alias("application_date"),
        N.publications(F.col("publication_numbers"), F.col("publication_dates")).alias("publications"),
        F.trim("registration_number").alias("registration_number"),
        "title",
        "applicant",
        N.organizations(F.col("applicant")).alias("applicant_organizations"),
        F.trim("source_status").alias("source_status"),
        N.document_year(F.col("application_date"), F.lit(None).cast("int"), N.publication_number(number)).alias("year"),
    )


def list_warnings(rows: DataFrame) -> DataFrame:
    """(path, line, warning): repeated numbers, control characters, dates that do not pair up, scores that are not numbers."""
    ok = rows.where("error is null")
    repeat = F.row_number().over(Window.partitionBy("path", "no").orderBy("line")) > 1
    size = lambda c: F.size(F.filter(F.split(c, ","), lambda v: F.trim(v) != ""))
    changed = F.lit(False)
    for c in NAMES:
        changed = changed | (N.clean_cell(F.col(c)) != F.col(c))
    tests = {
        "duplicate_no": repeat & (F.trim("no") != ""),
        "control_characters_removed": changed,
        "publication_date_count_mismatch": size(F.col("publication_numbers")) != size(F.col("publication_dates")),
        "invalid_ai_score": (F.trim("ai_score") != "") & F.trim("ai_score").try_cast("double").isNull(),
    }
    found = F.filter(F.array(*[F.when(t, name) for name, t in tests.items()]), lambda w: w.isNotNull())
    return ok.withColumn("_w", found).select("path", "line", F.explode("_w").alias("warning"))


def pool_index(files: DataFrame) -> DataFrame:
    """(key, pdf) of a pool's files (column pdf)."""
    stem = F.regexp_replace("pdf", r"(?i)\.pdf$", "")
    return files.select(N.match_key(N.publication_number(stem)).alias("key"), "pdf").where("key is not null")


def match_priority(wanted: DataFrame, pool: DataFrame, id_col: str) -> DataFrame:
    """(id, pdf, candidates): files by the numbers of a row (id, priority, key); the least priority, then name, is taken."""
    hits = wanted.join(pool, "key").select(id_col, F.struct("priority", "pdf").alias("hit")).distinct()
    best = hits.groupBy(id_col).agg(F.min("hit").alias("best"), F.count("*").alias("candidates"))
    return wanted.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.col("best.pdf").alias("pdf"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "patents array<struct<pdf:string,year:int,status:string,title:string,applicant:string,category:string,tags:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.posexplode("patents").alias("position", "p")).select("path", "position", "p.*")


def read_legacy_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All subresearches/*/patents.json; a missing category is the group's name."""
    rows = read_manifest(spark, f"{root}/subresearches/*/patents.json")
    group = F.regexp_extract("path", r"subresearches/([^/]+)/", 1)
    return rows.withColumn("subresearch", group).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.col("subresearch")))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """JSON files below a folder as artifact rows; the run is the folder after attempts/; malformed ones are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).withColumn("path", F.input_file_name())
    typed = files.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("artifact_type"), F.regexp_extract("path", r"attempts/([^/]+)/", 1).alias("run_id"), F.col("value").alias("payload"), F.col("path").alias("source_path")
    )
    return typed.where(F.try_parse_json("payload").isNotNull())


def audit_tail(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The newest lines of a JSONL audit log; bad lines are passed over."""
    rows = spark.read.schema("at string, action string, idempotency_key string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt").orderBy(F.col("at").desc()).limit(min(1000, max(1, last)))

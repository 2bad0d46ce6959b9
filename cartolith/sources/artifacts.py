"""A research's JSON files, read once and routed to what each of them is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder, shuffles_cleaned

# Where artifacts lie below a research, the name of the vectors' file, a safe id, the owner of what has none.
ROOTS = ("pipeline", "subresearches")
VECTORS = "embeddings"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
OF_RESEARCH = "_research"
VECTOR_FILE = "vectors struct<technology:array<float>,problem:array<float>>, dimensions int, input_sha256 array<string>, created_at string"
NOTE_FILE = "note string, source string"
SINKS = ("vectors", "artifacts", "interpretations", "malformed")
ROW = (
    "research_id string, patent_id string, artifact_type string, run_id string, source_path string, payload string, technology array<float>, problem array<float>, "
    "dimensions int, input_sha256 array<string>, created_at string, note string, source string, reason string"
)


def import_files(spark: SparkSession, root: str, research_id: str, interpretations: str | None = None) -> dict[str, DataFrame]:
    """{sink: rows} of all JSON files below a research's folder, and of interpretations if their folder is given.

    vectors (patent_id, technology, problem, dimensions, input_sha256, created_at) come from files embeddings.json, artifacts
    (patent_id, artifact_type, run_id, payload) from all others, interpretations (patent_id, note, source) from their own
    folder, and malformed (reason) is what can't be used: every file is in one of the four. The files are read and parsed
    once and written by sink, so reading a sink opens only its own rows. A folder that does not exist has no files.
    """
    base = root.rstrip("/")
    places = [f"{base}/{r}" for r in ROOTS] + ([interpretations.rstrip("/")] if interpretations else [])
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = [p for p in places if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
    if not there:
        return {s: _typed(spark.createDataFrame([], ROW), s) for s in SINKS}
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(there, wholetext=True)
    files = files.select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    name, folder = F.regexp_extract("path", r"([^/]+)\.json$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    noted = F.lit(False) if interpretations is None else F.contains(F.col("path"), F.lit(interpretations.rstrip("/").split(":")[-1].lstrip("/") + "/"))
    keyed = files.select("value", "path", name.alias("artifact_type"), folder.alias("_folder"), noted.alias("_note"), F.try_parse_json("value").isNotNull().alias("_json"))
    vector, note = F.from_json("value", VECTOR_FILE), F.from_json("value", NOTE_FILE)
    two = F.col("_v.vectors.technology").isNotNull() & F.col("_v.vectors.problem").isNotNull()
    whole = two & ~F.exists("_v.vectors.technology", lambda x: x.isNull()) & ~F.exists("_v.vectors.problem", lambda x: x.isNull())
    is_vector = ~F.col("_note") & (F.col("artifact_type") == VECTORS)
    rows = keyed.withColumn("_v", F.when(is_vector & F.col("_json"), vector)).withColumn("_n", F.when(F.col("_note") & F.col("_json"), note))
    reason = F.when(~F.col("_json"), "no JSON").when(is_vector & ~F.coalesce(whole, F.lit(False)), "no two vectors of numbers").when(F.col("_note") & ~F.col("artifact_type").rlike(SAFE_ID), "no id")
    sink = F.when(reason.isNotNull(), "malformed").when(F.col("_note"), "interpretations").when(is_vector, "vectors").otherwise("artifacts")
    owner = F.when(F.col("_note"), F.col("artifact_type")).when(is_vector | F.col("_folder").rlike(SAFE_ID), F.col("_folder")).otherwise(OF_RESEARCH)
    out = rows.select(
        F.lit(research_id).alias("research_id"),
        owner.alias("patent_id"),
        "artifact_type",
        F.regexp_extract("path", r"/attempts/([^/]+)/", 1).alias("run_id"),
        F.col("path").alias("source_path"),
        F.when(sink.isin("artifacts", "malformed"), F.col("value")).alias("payload"),
        F.col("_v.vectors.technology").alias("technology"),
        F.col("_v.vectors.problem").alias("problem"),
        F.when(F.col("_v").isNotNull(), F.coalesce(F.nullif("_v.dimensions", F.lit(0)), F.size("_v.vectors.technology"))).alias("dimensions"),
        F.col("_v.input_sha256").alias("input_sha256"),
        F.col("_v.created_at").alias("created_at"),
        F.coalesce("_n.note", F.when(F.col("_n").isNotNull(), "")).alias("note"),
        F.coalesce("_n.source", F.when(F.col("_n").isNotNull(), "human")).alias("source"),
        reason.alias("reason"),
        sink.alias("sink"),
    )
    place = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        out.write.partitionBy("sink").parquet(place)
    back = spark.read.schema(f"{ROW}, sink string").parquet(place)
    return {s: _typed(back.where(F.col("sink") == s), s) for s in SINKS}


def _typed(rows: DataFrame, sink: str) -> DataFrame:
    own = {
        "vectors": ("technology", "problem", "dimensions", "input_sha256", "created_at"),
        "artifacts": ("artifact_type", "run_id", "payload"),
        "interpretations": ("note", "source"),
        "malformed": ("artifact_type", "payload", "reason"),
    }[sink]
    return rows.select("research_id", "patent_id", *own, "source_path")


def sink_counts(sinks: dict[str, DataFrame]) -> DataFrame:
    """(sink, files): they add up to the files that were read."""
    out = None
    for name, rows in sinks.items():
        one = rows.agg(F.count("*").alias("files")).select(F.lit(name).alias("sink"), "files")
        out = one if out is None else out.unionByName(one)
    return out

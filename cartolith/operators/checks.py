"""What is looked at before anything runs or is stored: ids, stages, analyses, and a report of a research's readiness."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import materials
from .analysis import ANSWERS
from .assembly import REQUIRED

# Forms of ids and file names, stages in their order, lengths of an analysis' texts, models.
ID_FORMS = {
    "safe_id": r"^[A-Za-z0-9][A-Za-z0-9._-]*$",
    "patent_list": r"^patent_list_\d{14}\.csv$",
    "organization": r"^org_[0-9a-f]{16}$",
    "group": r"^group_[0-9a-f]{16}$",
}
STAGES = (
    "extract", "structure", "company_profile", "similarity", "concept_level", "problem_summary", "technology_summary", "embeddings", "company_embedding",
    "clustering", "cluster_names", "semantic_ordering", "finalize",
)
TEXT_LIMITS = {"tech_summary": 2000, "problem_summary": 2000, "reasoning": 4000, "tech_cluster": 120, "problem_cluster": 120}
LEVELS = ("similarity", "concept_level")
MODELS = ("gemma4:e4b", "qwen3-embedding:8b")
PROMPTED = (*ANSWERS, "cluster_name", "company_profile")
STRUCTURE_VERSION = 2


def is_id(value: Column, form: str) -> Column:
    """Whether a text has one of the forms of ID_FORMS; a null has none. A line feed at the end is part of the text."""
    return F.coalesce(value.rlike(ID_FORMS[form].replace("$", r"\z")), F.lit(False))


def checked_stages(stages: Iterable[str]) -> list[str]:
    """The stages as they are; a ValueError names those that are unknown."""
    given = list(stages)
    if unknown := sorted(set(given) - set(STAGES)):
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    return given


def unknown_stages(runs: DataFrame) -> DataFrame:
    """(run_id, unknown): runs (run_id, stages array<string>) with a stage that there is not, and which."""
    return runs.select("run_id", F.array_sort(F.array_except("stages", F.array(*[F.lit(s) for s in STAGES]))).alias("unknown")).where(F.size("unknown") > 0)


def registry_version(shared: str | None, local: str | None) -> Column:
    """The version of two registries of groups, from the digests of both (null: there is none)."""
    return F.substring(F.sha2(F.lit(f"{shared or 'none'}|{local or 'none'}"), 256), 1, 12)


def analysis_problem(payload: Column) -> Column:
    """Why the JSON text of a whole analysis can't be kept, null if it can: its keys, two levels of 1 to 5, five texts that are neither blank nor too long."""
    v = F.try_parse_json(payload)
    keys, wanted = F.json_object_keys(payload), F.array(*[F.lit(f) for f in REQUIRED])
    out = F.when(v.isNull(), "not_json").when(F.schema_of_variant(v).startswith("OBJECT<") == F.lit(False), "not_an_object")
    out = out.when((F.size(F.array_except(wanted, keys)) > 0) | (F.size(F.array_except(keys, wanted)) > 0), "keys")
    for field in LEVELS:
        number = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "BIGINT"
        out = out.when(~F.coalesce(number & F.try_variant_get(v, f"$.{field}", "long").between(1, 5), F.lit(False)), field)
    for field, most in TEXT_LIMITS.items():
        text = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
        out = out.when(~F.coalesce(text.rlike(r"(?U)\S") & (F.length(text) <= most), F.lit(False)), field)
    return out


def structure_states(documents: DataFrame, structures: DataFrame, key: str = "patent_id") -> DataFrame:
    """(key, state) of documents with a file: skipped, missing, valid or invalid. structures (key, schema_version, valid, claims) may repeat a key: one that is not valid makes it invalid."""
    good = (F.col("schema_version") >= STRUCTURE_VERSION) & F.col("valid") & (F.col("claims") > 0)
    held = structures.groupBy(F.col(key).alias("_k")).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"))
    joined = documents.where("pdf_available").join(held, F.col(key) == F.col("_k"), "left")
    state = F.when(F.col("analysis_state") == "skipped", "skipped").when(F.col("_good").isNull(), "missing").when(F.col("_good"), "valid").otherwise("invalid")
    return joined.select(key, state.alias("state"))


def preflight(
    documents: DataFrame, structures: DataFrame, prompts: dict[str, str], schemas: dict[str, dict], models: Iterable[str] | None, folders: tuple[str, str], key: str = "patent_id",
) -> DataFrame:
    """(check, ok, detail): six rows on whether a research (documents: key, pdf_available, analysis_state) can be run.

    prompts and schemas are by task, models what the model server has (None: it does not answer), folders the research's own
    and the other environment's. A prompt that is blank, and a schema without required fields, is none.
    """
    told = {t for t, p in prompts.items() if p.strip()} & set(PROMPTED)
    shaped = {t for t, s in schemas.items() if isinstance(s, dict) and s.get("type") == "object" and s.get("required")} & set(PROMPTED)
    missing = sorted(set(MODELS) - set(models or ()))
    fixed = [
        ("prompts", len(told) == len(PROMPTED) == len(shaped), f"prompts {len(told)}/{len(PROMPTED)}, schemas {len(shaped)}/{len(PROMPTED)}"),
        ("output-isolation", folders[0] != folders[1], folders[0]),
        ("model-server", models is not None, "no answer" if models is None else f"{len(set(models))} models"),
        ("models", models is not None and not missing, "all there" if not missing else "missing: " + ", ".join(missing)),
    ]
    tally = {s: F.count_if(F.col("state") == s).alias(s) for s in ("valid", "missing", "invalid", "skipped")}
    counts = structure_states(documents, structures, key).agg(*tally.values())
    total = F.col("valid") + F.col("missing") + F.col("invalid")
    part = F.concat(F.lit("valid "), "valid", F.lit("/"), total.cast("string"), *[x for s in ("missing", "invalid", "skipped") for x in (F.lit(f", {s} "), F.col(s).cast("string"))])
    structure = counts.select(F.lit("claim-structure").alias("check"), ((total > 0) & (F.col("valid") == total)).alias("ok"), part.alias("detail"))
    selected = documents.agg(F.count("*").alias("n")).select(F.lit("selection").alias("check"), (F.col("n") > 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" documents")).alias("detail"))
    given = documents.sparkSession.createDataFrame(fixed, "check string, ok boolean, detail string")
    return selected.unionByName(given).unionByName(structure)


def readiness(checks: DataFrame, documents: DataFrame) -> DataFrame:
    """(ready, selection_fingerprint): whether all checks hold, and the first 12 digits of the digest of the documents' files in order."""
    marked = materials.ordered_fingerprint(documents.withColumn("_all", F.lit("all")), "_all", ["position"], "pdf").select(F.substring("fingerprint", 1, 12).alias("selection_fingerprint"))
    return checks.agg(F.bool_and("ok").alias("ready")).join(marked, F.lit(True), "left")  # one row each

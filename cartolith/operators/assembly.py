"""Documents of a research, put together from its lists, results, skips and the file pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from . import facets, lifecycle, registry

# Which kind of input wins, what an analysis must hold, and names of what is not given.
PRECEDENCE = ("list", "manifest", "legacy")
REQUIRED = ("similarity", "concept_level", "tech_summary", "problem_summary", "reasoning", "tech_cluster", "problem_cluster")
CLUSTER_IDS = ("tech_cluster_id", "problem_cluster_id")
NO_APPLICANT, NO_CATEGORY = "未設定", "未分類"
GIVEN = "research_id string, pdf string, position long, subresearch string, publication_number string, title string, applicant string, category string, year int, year_source string, status string, source_status string, application_date string"


def chosen_source(files: DataFrame) -> DataFrame:
    """(research_id, kind): the one kind of input that counts of those a research has, whether or not it holds rows."""
    rank = F.array_position(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("kind"))
    known = files.where(F.col("kind").isin(*PRECEDENCE)).groupBy("research_id").agg(F.min(rank).alias("_r"))
    return known.select("research_id", F.element_at(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("_r").cast("int")).alias("kind"))


def rows_by_precedence(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (research_id, kind, ...) of the kind that counts in their research; files (research_id, kind) tells which there are."""
    return rows.join(chosen_source(files), ["research_id", "kind"], "left_semi")


def _looked_up(rows: DataFrame, found: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """rows with a struct `name` of found's fields: the research's own row, else the one of the row's old group; null if neither."""
    value = F.struct(*fields)
    newest = [F.col("modified").desc_nulls_last()] if "modified" in found.columns else []
    one = lifecycle.latest(found, ["research_id", "id", "subresearch"], [*newest, F.xxhash64(*found.columns)])
    own = one.where("subresearch is null").select("research_id", "id", value.alias("_own"))
    old = one.where("subresearch is not null").select("research_id", "id", "subresearch", value.alias("_old"))
    joined = rows.join(own, ["research_id", "id"], "left").join(old, ["research_id", "id", "subresearch"], "left")
    return joined.withColumn(name, F.coalesce("_own", "_old")).drop("_own", "_old")


def parsed_results(files: DataFrame) -> DataFrame:
    """Results of files (research_id, id, subresearch, payload, modified): each known field, `keys` (the fields that the file has,
    those of null too) and `malformed`. A file that is no JSON object has no keys."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT<"), F.lit(False))
    kinds = {"similarity": "int", "concept_level": "int"}
    value = lambda f: F.when(whole, F.get_json_object("payload", f"$.{f}")).cast(kinds.get(f, "string")).alias(f)
    keys = F.when(whole, F.json_object_keys("payload"))
    return files.select("research_id", "id", "subresearch", *[value(f) for f in (*REQUIRED, *CLUSTER_IDS)], F.coalesce(keys, F.array().cast("array<string>")).alias("keys"), (~whole).alias("malformed"), "modified")


def assembled_documents(rows: DataFrame, results: DataFrame, stored: DataFrame, skips: DataFrame, pool: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a listed document, with state, analysis and `problem`.

    rows as in GIVEN, results and stored (research_id, id, REQUIRED and CLUSTER_IDS; results with subresearch), skips
    (research_id, id, subresearch, reason, detail), pool (pdf). A result counts as a whole, its own file before the old
    group's, and only without one do stored values. With `keys` (see `parsed_results`) a result is ready if it has all required
    fields, of null too, and invalid if it has any others only; without, values that are not null count. Of repeated results the
    one `modified` last counts, where that is given. A file that is not in the pool is skipped for that reason, before any other. `problem` is why a reference is not valid, result_not_json, or duplicate for all rows of a research with one id, else null:
    rows are kept, so that the caller may refuse them together.
    """
    fields = [*REQUIRED, *CLUSTER_IDS]
    told = [c for c in ("keys", "malformed") if c in results.columns]
    stem = F.regexp_replace("pdf", r"(?i)\.pdf$", "")
    keyed = rows.withColumn("id", N.file_key(stem))
    found = _looked_up(_looked_up(keyed, results, "_result", [*fields, *told]), skips, "_skip", ["reason", "detail"])
    kept = lifecycle.latest(stored, ["research_id", "id"], [F.xxhash64(*stored.columns)]).select("research_id", "id", F.struct(*fields).alias("_stored"))
    here = pool.select("pdf").distinct().withColumn("_here", F.lit(True))
    joined = found.join(kept, ["research_id", "id"], "left").join(here, "pdf", "left")
    number = F.coalesce(F.nullif("publication_number", F.lit("")), stem)
    dated = N.application_year(F.col("application_date"))
    values = {f: F.when(F.col("_result").isNotNull(), F.col("_result")[f]).otherwise(F.col("_stored")[f]) for f in fields}
    held = sum((values[f].isNotNull().cast("int") for f in REQUIRED), F.lit(0))
    some = sum((v.isNotNull().cast("int") for v in values.values()), F.lit(0))
    gone = F.col("_here").isNull()
    whole, any_ = held == len(REQUIRED), some > 0
    if "keys" in told:
        keys = F.col("_result")["keys"]
        mine = F.col("_result").isNotNull()
        whole = F.when(mine, F.size(F.array_except(F.array(*[F.lit(f) for f in REQUIRED]), keys)) == 0).otherwise(whole)
        any_ = F.when(mine, F.size(keys) > 0).otherwise(any_)
    bad = F.when(F.col("_result")["malformed"], "result_not_json") if "malformed" in told else F.lit(None).cast("string")
    reason = F.when(gone, "pdf_not_found").otherwise(F.col("_skip")["reason"])
    skipped = gone | F.col("_skip").isNotNull()
    state = F.when(skipped, "skipped").when(whole, "ready").when(any_, "invalid").otherwise("pending")
    repeated = F.when(F.count("*").over(Window.partitionBy("research_id", "id")) > 1, "duplicate")
    return joined.select(
        "research_id",
        "id",
        "pdf",
        "position",
        number.alias("publication_number"),
        F.coalesce(F.nullif("title", F.lit("")), number).alias("title"),
        F.coalesce("applicant", F.lit(NO_APPLICANT)).alias("applicant"),
        F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
        F.coalesce(dated, F.nullif("year", F.lit(0)), N.infer_year(N.publication_number(number))).alias("year"),
        F.when(F.coalesce(dated, F.lit(0)) > 0, "application_date").otherwise(F.coalesce(F.nullif("year_source", F.lit("")), F.lit("legacy"))).alias("year_source"),
        F.coalesce(F.nullif("status", F.lit("")), N.infer_status(N.publication_number(number))).alias("status"),
        facets.classify_status(F.col("source_status"), rules or {}).alias("legal_status_category"),
        (~gone).alias("pdf_available"),
        state.alias("analysis_state"),
        reason.alias("skip_reason"),
        *[v.alias(f) for f, v in values.items()],
        F.coalesce(registry.reference_problem(F.col("pdf")), bad, repeated).alias("problem"),
    )


def with_state(documents: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """documents with the state, skip reason and detail of `states` (keys, analysis_state, skip_reason, skip_detail); states of no document change nothing."""
    told = ("analysis_state", "skip_reason", "skip_detail")
    new = lifecycle.latest(states, keys, [F.xxhash64(*states.columns)]).select(*keys, F.struct(*told).alias("_new"))
    joined = documents.join(new, keys, "left")
    put = {c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in told}
    return joined.withColumns(put).select(*documents.columns)


def match_audit(matched: DataFrame) -> DataFrame:
    """One row of what `match_priority` found: matched and missing files, and rows with several candidates."""
    return matched.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("pdf").isNotNull()).alias("matched_pdfs"),
        F.count_if(F.col("pdf").isNull()).alias("missing_pdfs"),
        F.count_if(F.col("candidates") > 1).alias("multiple_candidates"),
    )


def overview_counts(flags: DataFrame, errors: DataFrame, key: str = "patent_id") -> DataFrame:
    """Counts over `stage_flags` (document_structure, threat_score, summaries, analysis_complete) and the documents with an error."""
    rows = flags.join(errors.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    state = F.col("analysis_state")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("document_structure").alias("prepared"),
        F.count_if(F.col("threat_score") & F.col("summaries") & ~F.col("_bad")).alias("analyzed"),
        F.count_if(state == "ready").alias("finalized"),
        F.count_if(state == "pending").alias("pending"),
        F.count_if((state == "pending") & ~F.col("analysis_complete")).alias("llm_pending"),
        F.count_if(state == "skipped").alias("skipped"),
        F.count_if(F.col("_bad") & (state != "skipped")).alias("failed"),
    )

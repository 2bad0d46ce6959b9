"""Researches, organization groups, work selection and table checks: the small tables around the documents."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facets, lifecycle
from .model import DocumentFilter, Tables

LIFECYCLES = ("active", "archived", "all")
RULES_MOST, RULE_LENGTH, NOTE_LENGTH = 100, 200, 20_000


def list_researches(researches: DataFrame, documents: DataFrame, status: str = "active") -> DataFrame:
    """Researches (research_id, lifecycle_status, ...) of a status in the order of their ids, with their documents counted; 0 without any."""
    if status not in LIFECYCLES:
        raise ValueError(f"status must be one of {', '.join(LIFECYCLES)}")
    chosen = researches if status == "all" else researches.where(F.col("lifecycle_status") == status)
    return facets.documents_per_research(documents, chosen).orderBy("research_id")


def dashboard(tables: Tables, where: DocumentFilter) -> dict[str, DataFrame]:
    """The parts of a dashboard, each lazy: headline, both maps, years, statuses, organizations."""
    docs = where.apply(tables)
    return {
        "headline": facets.headline(docs),
        "threat": facets.threat_grid(docs),
        "technology": facets.technology_cells(docs),
        "years": facets.distinct_years(docs),
        "statuses": facets.source_status_counts(docs),
        "organizations": facets.organization_top(docs, tables),
    }


def set_archived(researches: DataFrame, research_id: str, archived: bool) -> DataFrame:
    """The researches with one of them archived or restored; an unknown id changes nothing."""
    state = F.when(F.col("research_id") == research_id, F.lit("archived" if archived else "active")).otherwise(F.col("lifecycle_status"))
    return researches.withColumn("lifecycle_status", state)


def checked_rules(rules: dict[str, Iterable[str]]) -> dict[str, list[str]]:
    """Status rules {category: values}, trimmed and each once; too many, too long or shared values are errors."""
    out: dict[str, list[str]] = {}
    owner: dict[str, str] = {}
    for category, values in rules.items():
        kept = list(dict.fromkeys(v for v in (str(v).strip() for v in values) if v))
        if len(kept) > RULES_MOST or any(len(v) > RULE_LENGTH for v in kept):
            raise ValueError(f"{category}: at most {RULES_MOST} values of {RULE_LENGTH} characters")
        for v in kept:
            if owner.setdefault(v, category) != category:
                raise ValueError(f"{v} is in two categories")
        out[category] = kept
    return out


def checked_note(text: str) -> str:
    note = text.strip()
    if not 1 <= len(note) <= NOTE_LENGTH:
        raise ValueError(f"a note has 1 to {NOTE_LENGTH} characters")
    return note


def organization_registry(organizations: DataFrame, groups: DataFrame) -> DataFrame:
    """(organization_id, name): organizations and the members of groups (members array of structs), in the order of the names whatever their case."""
    members = groups.select(F.explode("members").alias("m")).select("m.organization_id", "m.name")
    own = organizations.select("organization_id", "name", F.lit(0).alias("_from")).unionByName(members.withColumn("_from", F.lit(1)))
    return lifecycle.latest(own, ["organization_id"], [F.col("_from"), F.col("name")]).drop("_from").orderBy(F.lower("name"), "name", "organization_id")


def scoped_groups(shared: DataFrame, local: DataFrame) -> DataFrame:
    """Groups of all researches and of one, marked by scope."""
    return shared.withColumn("scope", F.lit("shared")).unionByName(local.withColumn("scope", F.lit("local")))


def group_problem(members: Column, known: Column) -> Column:
    """Why a group can't be saved (null if it can): it needs two different members, all of them known."""
    distinct = F.array_distinct(members)
    return F.when(F.size(F.array_except(distinct, known)) > 0, "unknown_member").when(F.size(distinct) < 2, "too_few_members")


def reference_problem(pdf: Column) -> Column:
    """Why a file reference is not valid (null if it is): it must be a plain name that ends in .pdf."""
    name = F.coalesce(pdf, F.lit(""))
    return F.when(~F.lower(name).endswith(".pdf"), "not_pdf").when(name.rlike(r"[/\\\\]") | name.startswith(".."), "not_a_plain_name")


def safe_id(value: str) -> bool:
    """Letters, digits, underscore and hyphen, at most 64."""
    return re.fullmatch(r"[A-Za-z0-9_-]{1,64}", value) is not None


def open_work(documents: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Documents still to be analyzed: not sent to manual review, without a current checkpoint and, unless `overwrite`, without a result."""
    todo = documents.where(~F.col("skip_reason").eqNullSafe("manual_review_required"))
    if not overwrite:
        todo = todo.where(F.col("analysis_state") != "ready")
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def work_order(rows: DataFrame) -> DataFrame:
    """Adds turn, from 1 in each task: short texts first, but long ones first for technology summaries."""
    size = F.when(F.col("task") == "technology_summary", -F.col("characters")).otherwise(F.col("characters"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("task").orderBy(size, "doc_id")))


def first_members(assignments: DataFrame, most: int = 20) -> DataFrame:
    """The first members by key of each cluster (cluster, key)."""
    w = Window.partitionBy("cluster").orderBy("key")
    return assignments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def embedding_integrity(vectors: DataFrame, documents: DataFrame, keys: list[str], vector: str = "embedding", dims: str = "dimensions") -> DataFrame:
    """One row: vectors, those missing, those of another length than stated, and those without a document."""
    known = documents.select(*keys).distinct().withColumn("_known", F.lit(True))
    v = F.col(vector)
    return vectors.join(known, keys, "left").agg(
        F.count("*").alias("vectors"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v.isNotNull() & ~(F.size(v).eqNullSafe(F.col(dims)))).alias("wrong_length"),
        F.count_if(F.col("_known").isNull()).alias("orphans"),
    )


def stage_flags(documents: DataFrame, artifacts: DataFrame, stages: list[str]) -> DataFrame:
    """(patent_id, analysis_state, one boolean a stage): which artifacts each document has."""
    seen = artifacts.groupBy("patent_id").agg(*[F.bool_or(F.col("artifact_type") == s).alias(s) for s in stages])
    flags = [F.coalesce(F.col(s), F.lit(False)).alias(s) for s in stages]
    return documents.join(seen, "patent_id", "left").select("patent_id", "analysis_state", *flags)


def structure_tallies(documents: DataFrame, structured: DataFrame) -> DataFrame:
    """One row of valid, missing, invalid and skipped documents; structured is (patent_id, valid)."""
    joined = documents.join(structured.groupBy("patent_id").agg(F.bool_and("valid").alias("_valid")), "patent_id", "left")
    skipped = F.col("analysis_state") == "skipped"
    return joined.agg(
        F.count_if(~skipped & F.col("_valid")).alias("valid"),
        F.count_if(~skipped & F.col("_valid").isNull()).alias("missing"),
        F.count_if(~skipped & ~F.col("_valid")).alias("invalid"),
        F.count_if(skipped).alias("skipped"),
    )


def named_clusters(names: DataFrame, proximity: DataFrame) -> DataFrame:
    """Cluster names with their proximity; null where it is not known."""
    return names.join(proximity, "cluster", "left")

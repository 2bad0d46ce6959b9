"""Requests that change the small tables: each is carried out or refused with a reason, many at a time.

Every function returns the table as it is then, and the refused requests with `problem`. Of requests that name one key the
last by `at` counts where the table keeps one row a key; requests without a time come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lifecycle
from .checks import is_id

# Lengths in code points, what a research begins as, what may be done with a group, who writes a note.
NAME_MOST, DESCRIPTION_MOST, COMPANY_MOST = 120, 2_000, 20_000
GROUP_NAME_MOST, GROUP_NOTE_MOST, LEAST_MEMBERS = 100, 2_000, 2
NOTE_MOST = 20_000
ACTIVE = "active"
ACTIONS = ("save", "delete")
SOURCES = ("human", "model")


def trimmed(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return lifecycle.latest(rows, keys, [F.col("at").desc_nulls_last(), F.xxhash64(*rows.columns)])


def created_researches(researches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """researches (research_id, name, description, company_technology, lifecycle_status, created_at, updated_at) with new ones.

    requests (research_id, name, description, company_technology, documents, at): ids of the safe form that are new, names,
    texts of their lengths, and a list with a document. Of requests for one id the first one that can be is carried out,
    the others are refused as exists.
    """
    rows = requests.withColumns({c: trimmed(c) for c in ("research_id", "name", "description", "company_technology")})
    held = researches.select(F.col("research_id").alias("_held")).distinct()
    rows = rows.join(held, F.col("research_id") == F.col("_held"), "left")
    problem = (
        F.when(~is_id(F.col("research_id"), "safe_id"), "id").when(~F.length("name").between(1, NAME_MOST), "name").when(F.length("description") > DESCRIPTION_MOST, "description")
        .when(~F.length("company_technology").between(1, COMPANY_MOST), "company_technology").when(F.coalesce("documents", F.lit(0)) < 1, "no_documents").when(F.col("_held").isNotNull(), "exists")
    )
    rows = rows.withColumn("problem", problem).drop("_held")
    good = lifecycle.latest(rows.where("problem IS NULL"), ["research_id"], [F.col("at").asc_nulls_first(), F.xxhash64(*rows.columns)]).withColumn("_taken", F.lit(True))
    later = rows.where("problem IS NULL").exceptAll(good.select(*rows.columns)).withColumn("problem", F.lit("exists"))
    new = good.select("research_id", "name", "description", "company_technology", F.lit(ACTIVE).alias("lifecycle_status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return researches.select(*new.columns).unionByName(new), rows.where("problem IS NOT NULL").unionByName(later)


def saved_groups(groups: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (id, name, member_ids, members, note, verified, created_at, updated_at) with groups saved or deleted.

    requests (action, id, name, note, member_ids, members array<struct<id,name>>, verified, at). A group has a name, and two
    different members of the organizations' form; members that come without a name are named by their id. What is saved again
    keeps its first time. A group that is deleted must be there.
    """
    rows = requests.withColumns({"name": trimmed("name"), "note": trimmed("note"), "member_ids": F.array_distinct(F.coalesce("member_ids", F.array().cast("array<string>")))})
    held = groups.select(F.col("id").alias("_held"), F.col("created_at").alias("_created"))
    rows = rows.join(held, F.col("id") == F.col("_held"), "left")
    saves, unsafe = F.col("action") == "save", F.exists("member_ids", lambda m: ~is_id(m, "organization"))
    problem = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action").when(~is_id(F.col("id"), "group"), "id").when((F.col("action") == "delete") & F.col("_held").isNull(), "not_found")
        .when(saves & ~F.length("name").between(1, GROUP_NAME_MOST), "name").when(saves & (F.length("note") > GROUP_NOTE_MOST), "note").when(saves & ((F.size("member_ids") < LEAST_MEMBERS) | unsafe), "members")
    )
    rows = rows.withColumn("problem", problem)
    good = _newest(rows.where("problem IS NULL"), ["id"])
    given = F.coalesce("members", F.array().cast("array<struct<id:string,name:string>>"))
    name_of = lambda m: F.coalesce(F.try_element_at(F.transform(F.filter(given, lambda g: g.id == m), lambda g: F.regexp_replace(F.coalesce(g["name"], F.lit("")), r"(?U)^\s+|\s+$", "")), F.lit(-1)), m)
    members = F.transform("member_ids", lambda m: F.struct(m.alias("id"), name_of(m).alias("name")))
    saved = good.where("action = 'save'").select("id", "name", "member_ids", members.alias("members"), "note", F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("_created", "at").alias("created_at"), F.col("at").alias("updated_at"))
    left = groups.join(good.select("id"), "id", "left_anti").select(*saved.columns)
    return left.unionByName(saved), rows.where("problem IS NOT NULL").drop("_held", "_created")


def saved_interpretations(old: DataFrame, requests: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old (research_id, patent_id, note, source, updated_at) with notes of documents that exist; requests (research_id, patent_id, note, source, at).

    A note has 1 to NOTE_MOST characters after trimming; a source that is not given is a person.
    """
    keys = ["research_id", "patent_id"]
    rows = requests.withColumn("note", trimmed("note")).withColumn("source", F.coalesce("source", F.lit(SOURCES[0])))
    rows = rows.join(documents.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    problem = F.when(F.col("_there").isNull(), "no_document").when(~F.length("note").between(1, NOTE_MOST), "note").when(~F.col("source").isin(*SOURCES), "source")
    rows = rows.withColumn("problem", problem).drop("_there")
    good = _newest(rows.where("problem IS NULL"), keys).select(*keys, "note", "source", F.col("at").alias("updated_at"))
    return lifecycle.upsert(old.select(*good.columns), good, keys), rows.where("problem IS NOT NULL")


def put_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (key, value) with new's values (key, value, at) in the place of equal keys; a null key is none."""
    return lifecycle.upsert(old.select("key", "value"), _newest(new.where("key IS NOT NULL"), ["key"]).select("key", "value"), ["key"])


def with_technology_maps(researches: DataFrame, maps: DataFrame) -> DataFrame:
    """researches with technology_map (JSON) and updated_at of maps (research_id, technology_map, at); maps of no research change nothing."""
    new = _newest(maps, ["research_id"]).select(F.col("research_id").alias("_r"), F.col("technology_map").alias("_map"), F.col("at").alias("_at"))
    joined = researches.join(new, F.col("research_id") == F.col("_r"), "left")
    hit = F.col("_r").isNotNull()
    put = {"technology_map": F.when(hit, F.col("_map")).otherwise(F.col("technology_map")), "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at"))}
    return joined.withColumns(put).select(*researches.columns)

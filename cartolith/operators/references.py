"""What a model cites, held against the exact input of its task, and one repair of an answer that does not hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .grounding import generate
from .structure import lead_claims

# The tasks that cite elements, and elements or paragraphs (the others cite paragraphs), the form of an id, reasons.
CITE_ELEMENTS = ("similarity", "concept_level")
CITE_BOTH = ("technology_summary",)
LABEL = r"\b(?:C\d+-E\d+|P\d{4}-N\d{4})\b"
NOT_A_LIST = "evidence_ids_not_string_array"
EMPTY = "evidence_ids_empty"
UNKNOWN = "evidence_id_not_in_task_input"
CLAIM_NOT_WHOLE = "claim_number_not_integer"
CLAIM_UNKNOWN = "claim_number_not_in_scoring_input"


def allowed_ids(packs: DataFrame) -> DataFrame:
    """(doc_id, task, allowed): the ids in each evidence pack (doc_id, task, sources) of the kinds that its task may cite."""
    of = lambda kind: F.filter("sources", lambda s: s["source_type"] == kind)
    elements = F.flatten(F.transform(of("claim"), lambda s: s["element_ids"]))
    paragraphs = F.transform(of("paragraph"), lambda s: s["id"])
    both = F.when(F.col("task").isin(*CITE_ELEMENTS), elements).when(F.col("task").isin(*CITE_BOTH), F.concat(elements, paragraphs))
    return packs.select("doc_id", "task", F.array_distinct(both.otherwise(paragraphs)).alias("allowed"))


def _plain(value: Column) -> Column:
    """Without white space around it, as one id where the text holds one."""
    label = F.regexp_extract(value, "(?U)" + LABEL, 0)
    return F.when(label != "", label).otherwise(value)


def checked(rows: DataFrame) -> DataFrame:
    """rows (task, cited array<string>, allowed array<string>, ...) with what their input holds of what they cite.

    Adds source_type (the kind of source that the task may cite), reported_values (trimmed, as given), reported (ids in cited
    order, labels around them taken off), verified_ids, rejected_ids, verified and reason. A null list, or one with a null in
    it, is no list of strings. An answer stands if it cites something and nothing unknown.
    """
    none = F.array().cast("array<string>")
    known = F.coalesce("allowed", none)
    strings = F.col("cited").isNotNull() & ~F.exists(F.coalesce("cited", none), lambda v: v.isNull())
    stripped = F.transform("cited", lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
    values = F.array_distinct(F.filter(stripped, lambda v: v != ""))
    kind = F.when(F.col("task").isin(*CITE_ELEMENTS), "element").when(F.col("task").isin(*CITE_BOTH), "element_or_paragraph").otherwise("paragraph")
    rows = rows.withColumn("source_type", kind).withColumn("reported_values", F.when(strings, values).otherwise(none))
    rows = rows.withColumn("reported", F.array_distinct(F.transform("reported_values", _plain)))
    rows = rows.withColumn("verified_ids", F.filter("reported", lambda v: F.array_contains(known, v))).withColumn("rejected_ids", F.array_except("reported", known))
    reason = F.when(~strings, NOT_A_LIST).when(F.size("reported") == 0, EMPTY).when(F.size("rejected_ids") > 0, UNKNOWN)
    return rows.withColumn("reason", reason).withColumn("verified", F.col("reason").isNull())


def checked_references(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """cited (doc_id, task, cited array<string>, ...) as in `checked`, against its input (doc_id, task, allowed)."""
    return checked(cited.join(allowed.select("doc_id", "task", "allowed"), ["doc_id", "task"], "left")).drop("allowed")


def source_rows(paragraphs: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, id, source_type, ...): what can be cited, claims' elements and paragraphs, each with its own columns."""
    elements = claims.select("doc_id", F.col("number").alias("claim_number"), F.explode("elements").alias("e"))
    elements = elements.select("doc_id", F.col("e.element_id").alias("id"), F.lit("element").alias("source_type"), "claim_number", "e.type", "e.limitations", "e.sha256")
    texts = paragraphs.select("doc_id", F.col("paragraph_id").alias("id"), F.lit("paragraph").alias("source_type"), "page", "paragraph_number", "section", "roles", "sha256")
    return elements.unionByName(texts, allowMissingColumns=True)


def verified_sources(checked: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, task, nth, ...): one row for each verified id in cited order, with its source's columns."""
    ids = checked.select("doc_id", "task", F.posexplode("verified_ids").alias("nth", "id"))
    return ids.join(sources, ["doc_id", "id"])


def checked_claims(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """rows (doc_id, reported, ...) bound to a leading claim; reported is the JSON text of the claim number.

    Only an integer counts: no truth value, no string, no fraction. The quotation comes from the claim, never from the model.
    """
    number = F.when(F.col("reported").rlike(r"^-?[0-9]+$"), F.col("reported").try_cast("int"))
    lead = lead_claims(claims).select("doc_id", F.col("number").alias("_n"), F.col("type").alias("claim_type"), F.trim("text").alias("claim_text"))
    joined = rows.withColumn("claim_number", number).join(lead.withColumnRenamed("doc_id", "_of"), (F.col("doc_id") == F.col("_of")) & (F.col("claim_number") == F.col("_n")), "left")
    reason = F.when(F.col("claim_number").isNull(), CLAIM_NOT_WHOLE).when(F.col("_n").isNull(), CLAIM_UNKNOWN)
    reason = reason.when(F.coalesce("claim_text", F.lit("")) == "", "claim_text_missing")
    return joined.withColumn("claim_sha256", F.sha2("claim_text", 256)).withColumn("reason", reason).withColumn("verified", F.col("reason").isNull()).drop("_of", "_n")


def grounded(inputs: DataFrame, allowed: DataFrame, call: Callable[[str, str], dict], schema: dict, path: str = "$.evidence_ids") -> DataFrame:
    """(doc_id, task, response, error, verified_ids, rejected_ids, reason, verified, attempts) of inputs (doc_id, task, prompt).

    An answer that cites nothing, or what its input does not hold, is asked for once more, with the ids that are allowed,
    those it gave and the reason. What does not hold then either stays a row that is not verified. Each round of answers
    is written, so that the model is not called again when the result is read twice.
    """

    def ask(prompts: DataFrame, attempt: int) -> DataFrame:
        got = cut(generate(prompts, call, schema), "answers").drop("attempts")
        listed = got.withColumn("cited", F.from_json(F.get_json_object("response", path), "array<string>"))
        return cut(checked_references(listed, allowed).drop("cited").withColumn("attempts", F.lit(attempt)), "grounded")

    first = ask(inputs, 1)
    good, bad = first.where("verified"), first.where("not verified")
    told = F.to_json(F.struct(F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed_ids"), F.col("reported").alias("previous_ids"), F.col("reason").alias("validation")))
    again = inputs.select("doc_id", "task", "prompt").join(bad.select("doc_id", "task", "reported", "reason"), ["doc_id", "task"]).join(allowed.select("doc_id", "task", "allowed"), ["doc_id", "task"], "left")
    second = ask(again.select("doc_id", "task", F.concat("prompt", F.lit("\n"), told).alias("prompt")), 2)
    return good.unionByName(second).drop("reported")

"""Analysis tasks from prepared input to committed answer.

A task's answer is looked up by the digest of all that decides it, and only what is not found reaches the model. An answer is
held against the ids and claims of its own input, asked for once more with the reason if it does not hold, and committed.
What fails is a row. A checkpoint for each document and task carries the digest of its input, so a run that was ended
goes on with what is missing or stale, and calls the model for nothing else.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..sources.committed import CommittedTable
from ..sources.shared import cut
from . import lifecycle, references
from .grounding import schema_error
from .structure import lead_claims


@dataclass(frozen=True)
class Answer:
    """The fields of a task's answer: a level of 1 to 5 with its reason, or a text; and the ids it cites."""

    value: str
    level: bool
    ids: str
    most_ids: int


# Answers by task, what is shared among researches, lengths, context sizes, output tokens by attempt.
ANSWERS = {
    "similarity": Answer("similarity", True, "evidence_element_ids", 5),
    "concept_level": Answer("concept_level", True, "evidence_element_ids", 5),
    "problem_summary": Answer("problem_summary", False, "source_paragraph_ids", 4),
    "technology_summary": Answer("tech_summary", False, "source_ids", 4),
}
SHARED = ("concept_level", "problem_summary", "technology_summary")
TEXT_MOST, ID_MOST = 800, 80
CONTEXTS, TOKENS_A_CHARACTER, FRAME_TOKENS = (4096, 8192, 16384), 0.8, 512
OUTPUT_TOKENS = (384, 512, 768)
PACK_VERSION = 2
#: Raised whenever an answer could come out otherwise; older answers and checkpoints are then passed over.
PIPELINE_VERSION, CACHE_VERSION = "analysis-1", "answers-1"

MATERIAL = ("pdf_sha256", "preprocessing_version", "structured_document_sha256", "claim_structure_sha256", "reading_policy")
PREPARED = "research_id string, doc_id long, task string, company string, text string, allowed array<string>, claims array<int>, " + ", ".join(f"{m} string" for m in MATERIAL)
ANSWER_ROW = "fingerprint string, cache_version string, task string, key_material string, response string, created_at timestamp"
ATTEMPT = "attempt:int,response:string,error:string,reported:array<string>,verified_ids:array<string>,rejected_ids:array<string>,reason:string,claim_number:int,claim_reason:string,verified:boolean"
CHECKPOINT = (
    "research_id string, doc_id long, task string, pipeline_version string, checkpoint string, fingerprint string, state string, response string, "
    f"verified boolean, attempts array<struct<{ATTEMPT}>>, error string, committed_at timestamp"
)


class Unfinished(Exception):
    """The model stopped before its answer was complete."""


class TooLong(Exception):
    """A prompt that no context holds."""


@dataclass(frozen=True)
class Model:
    """complete(prompt, schema, context tokens, output tokens) returns the answer's text; identity says what makes its answers."""

    complete: Callable[[str, dict, int, int], str]
    identity: dict
    templates: dict[str, str]
    output_tokens: tuple[int, ...] = OUTPUT_TOKENS

    def identity_of(self, task: str) -> dict:
        return self.identity | {"template_sha256": canonical.digest(self.templates[task]), "schema_sha256": canonical.digest(response_schema(task)), "output_tokens": list(self.output_tokens)}


def response_schema(task: str, allowed: list[str] | None = None, claims: list[int] | None = None) -> dict:
    """A task's schema, narrowed to the ids and claim numbers of one input; a ValueError if that input has none."""
    a = ANSWERS[task]
    ids: dict = {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": ID_MOST}, "minItems": 1, "maxItems": a.most_ids, "uniqueItems": True}
    text = {"type": "string", "minLength": 1, "maxLength": TEXT_MOST}
    fields: dict = {a.value: {"type": "integer", "minimum": 1, "maximum": 5}, "reason": text, "claim_number": {"type": "integer", "minimum": 1}} if a.level else {a.value: text}
    if allowed is not None:
        kept = list(dict.fromkeys(i for i in allowed if i))
        if not kept:
            raise ValueError(f"{task} has no ids to cite")
        ids["items"]["enum"], ids["maxItems"] = kept, min(a.most_ids, len(kept))
    if claims is not None and a.level:
        if not claims:
            raise ValueError(f"{task} has no claims to name")
        fields["claim_number"]["enum"] = list(dict.fromkeys(claims))
    fields[a.ids] = ids
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}


def context_window(prompt: str, output_tokens: int) -> int:
    """The smallest context for a prompt and its answer; TooLong beyond the largest."""
    need = math.ceil(len(prompt) * TOKENS_A_CHARACTER) + output_tokens + FRAME_TOKENS
    for size in CONTEXTS:
        if need <= size:
            return size
    raise TooLong(f"{len(prompt)} characters need about {need} tokens of {CONTEXTS[-1]}")


def prompt_of(template: str, task: str, schema: dict, company: str | None, text: str | None, constraints: dict, repair: dict | None = None, again: bool = False) -> str:
    """The template, the narrowed schema, the input, the values that may be used, and what was wrong before, if anything was."""
    parts = [template, "## Output JSON schema\n" + json.dumps(schema, ensure_ascii=False)]
    if task == "similarity":
        parts.append("## Own technology\n" + (company or ""))
    parts += ["## Document\n" + (text or ""), "## Allowed values\nUse these ids and claim numbers only, and return nothing but the JSON object.\n" + json.dumps(constraints, ensure_ascii=False)]
    if repair:
        parts.append("## Rejected evidence\nThe ids of the last answer did not hold. Choose the most direct ones of the allowed values.\n" + json.dumps(repair, ensure_ascii=False))
    if again:
        parts.append("The last answer was cut off or no valid JSON. Keep the reason short and close the object.")
    return "\n\n".join(parts)


def _one(model: Model, task: str, company: str | None, text: str | None, allowed: list[str], claims: list[int], repair: dict | None) -> tuple[str | None, str | None]:
    """(answer, error): up to one call for each limit of output tokens, until an answer is whole and fits its schema."""
    try:
        # a first answer may cite wrongly, which grounding finds; so only the prompt and the decoder see the narrow schema
        narrow, wide = response_schema(task, allowed, claims), response_schema(task)
    except (ValueError, KeyError) as e:
        return None, f"{type(e).__name__}: {e}"
    constraints = {"allowed_evidence_ids": allowed} | ({"allowed_claim_numbers": claims} if ANSWERS[task].level else {})
    error = "no attempt"
    for n, most in enumerate(model.output_tokens):
        prompt = prompt_of(model.templates[task], task, narrow, company, text, constraints, repair, n > 0)
        try:
            raw = model.complete(prompt, narrow, context_window(prompt, most), most)
        except Unfinished as e:
            error = f"cut off at {most} tokens: {e}"
            continue
        except Exception as e:  # noqa: BLE001  whatever the client raises belongs to this row
            return None, f"{type(e).__name__}: {e}"
        try:
            value = json.loads(raw or "")
        except ValueError as e:
            error = f"no JSON: {e}"
            continue
        if (problem := schema_error(value, wide)) is None:
            return canonical.text(value), None
        error = problem
    return None, f"failed after {len(model.output_tokens)} attempts: {error}"


def ask(asked: DataFrame, texts: DataFrame, model: Model, parallel: int) -> DataFrame:
    """(question, response, error) of asked (question, task, allowed, claims, repair as JSON), one row a question, dealt over `parallel` tasks.

    texts (question, company, text) may hold more questions, and one in several rows, which are alike. They are dealt out once
    and meet the keys where the prompt is made. It is written at once, so that no answer is asked for again when it is read again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                allowed, claims = list(r.allowed if r.allowed is not None else []), [int(n) for n in (r.claims if r.claims is not None else [])]
                out.append((r.question, *_one(model, r.task, r.company, r.text, allowed, claims, json.loads(r.repair) if r.repair else None)))
            yield pd.DataFrame(out, columns=["question", "response", "error"])

    texts = texts.select("question", "company", "text")
    if 2 * asked.count() < texts.count():  # few of the texts: those are picked first, and only they are dealt out
        texts = texts.join(asked.select("question"), "question", "left_semi")
    once = texts.repartition(parallel, "question").dropDuplicates(["question"])
    dealt = once.join(asked.select("question", "task", "allowed", "claims", "repair").hint("merge"), "question")
    return cut(dealt.mapInPandas(run, "question string, response string, error string"), "answers")


def _field(by: Callable[[Answer], str]) -> Column:
    """The JSON path of a field that depends on the task."""
    out = F.lit(None).cast("string")
    for task, a in ANSWERS.items():
        out = F.when(F.col("task") == task, F.get_json_object("response", f"$.{by(a)}")).otherwise(out)
    return out


def judged(rows: DataFrame) -> DataFrame:
    """rows (task, allowed, claims, response, ...) with what of the answer's ids and claim their input holds, and `verified`."""
    listed = rows.withColumn("cited", F.from_json(_field(lambda a: a.ids), "array<string>"))
    checked = references.checked(listed).drop("cited").withColumnRenamed("verified", "_ids_hold")
    number = F.try_variant_get(F.try_parse_json("response"), "$.claim_number", "variant")
    claim = F.when(F.schema_of_variant(number) == "BIGINT", F.try_variant_get(F.try_parse_json("response"), "$.claim_number", "int"))
    reason = F.when(F.col("claim_number").isNull(), references.CLAIM_NOT_WHOLE).when(~F.array_contains(F.coalesce("claims", F.array().cast("array<int>")), F.col("claim_number")), references.CLAIM_UNKNOWN)
    scored = F.col("task").isin(*[t for t, a in ANSWERS.items() if a.level])
    out = checked.withColumn("claim_number", F.when(scored, claim)).withColumn("claim_reason", F.when(scored, reason))
    holds = F.col("response").isNotNull() & F.col("_ids_hold") & F.col("claim_reason").isNull()
    return out.withColumn("verified", F.coalesce(holds, F.lit(False))).drop("_ids_hold")


def shaped(task: Column, response: Column) -> Column:
    """Whether a stored answer still has its task's fields: the schema holds and no text is blank."""

    def one(name: str | None, value: str | None) -> bool:
        try:
            got = json.loads(value or "")
            return name in ANSWERS and schema_error(got, response_schema(name)) is None and all(v.strip() for v in got.values() if isinstance(v, str))
        except ValueError:
            return False

    return F.udf(one, "boolean", useArrow=True)(task, response)


def prepared_tasks(packs: DataFrame, claims: DataFrame, manifests: DataFrame, research_id: str, company: str) -> DataFrame:
    """PREPARED rows of evidence packs (doc_id, task, rendered_text, sources), claims and manifests (doc_id, MATERIAL)."""
    may = references.allowed_ids(packs).select("doc_id", "task", F.array_sort("allowed").alias("allowed"))
    lead = lead_claims(claims).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("claims"))
    rows = packs.select("doc_id", "task", F.col("rendered_text").alias("text")).join(may, ["doc_id", "task"]).join(lead, "doc_id", "left").join(manifests.select("doc_id", *MATERIAL), "doc_id", "left")
    return rows.select(F.lit(research_id).alias("research_id"), "doc_id", "task", F.lit(company).alias("company"), "text", "allowed", F.coalesce("claims", F.array().cast("array<int>")).alias("claims"), *MATERIAL)


def keyed(prepared: DataFrame, model: Model, environment: str) -> DataFrame:
    """prepared with key_material and fingerprint of shared tasks, and checkpoint, the digest of any task's whole input."""
    schema = prepared.schema
    levels = [t for t, a in ANSWERS.items() if a.level]
    ids = canonical.of(F.coalesce("allowed", F.array().cast("array<string>")), schema["allowed"].dataType)
    numbers = canonical.of(F.coalesce("claims", F.array().cast("array<int>")), schema["claims"].dataType)
    constraints = F.when(F.col("task").isin(*levels), F.concat(F.lit('{"allowed_claim_numbers":'), numbers, F.lit(',"allowed_evidence_ids":'))).otherwise(F.lit('{"allowed_evidence_ids":'))
    # sorted keys: allowed_claim_numbers comes before allowed_evidence_ids
    constraints = F.concat(constraints, ids, F.lit("}"))
    generator = F.lit(canonical.NULL)
    for task in ANSWERS:
        generator = F.when(F.col("task") == task, F.lit(canonical.text(model.identity_of(task)))).otherwise(generator)
    named = {
        "cache_version": F.lit(canonical.text(CACHE_VERSION)),
        "environment": F.lit(canonical.text(environment)),
        "evidence_pack_version": F.lit(canonical.text(PACK_VERSION)),
        "generator": generator,
        "grounding_constraints": constraints,
        "input_sha256": canonical.of(F.sha2(F.coalesce("text", F.lit("")), 256), schema["text"].dataType),
        "task": canonical.of(F.col("task"), schema["task"].dataType),
    } | {m: canonical.of(F.col(m), schema[m].dataType) for m in MATERIAL}
    material = canonical.joined(named)
    whole = F.concat(F.lit(PIPELINE_VERSION + "\n"), "key_material", F.lit("\n"), F.when(F.col("task") == "similarity", F.sha2(F.coalesce("company", F.lit("")), 256)).otherwise(F.lit("")))
    out = prepared.withColumn("key_material", material).withColumn("checkpoint", F.sha2(whole, 256))
    return out.withColumn("fingerprint", F.when(F.col("task").isin(*SHARED), F.sha2("key_material", 256)))


KEYS = ["research_id", "doc_id", "task"]


def _attempt(n: int) -> Column:
    names = [p.split(":")[0] for p in ATTEMPT.split(",")]
    return F.struct(F.lit(n).alias("attempt"), *[F.col(c) for c in names[1:]])


def analyse(rows: DataFrame, model: Model, answers: DataFrame | None = None, parallel: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(KEYS, checkpoint, fingerprint, key_material, state, response, verified, attempts, error) of `keyed` rows.

    answers are ANSWER_ROWs: one found by its fingerprint counts if it still has its shape and its citations hold against
    this input. Inputs of one fingerprint are asked for once. state is cached, generated, repaired or failed; only a verified
    answer is a response, and attempts keep the others. Rows with a null task fail, and null keys are keys like others. rows
    are read several times: give a written table. texts are `keyed` rows too, which hold those of rows and maybe others: where
    rows come from a join, it is then a join of keys, and no text goes through it.
    """
    spark = rows.sparkSession
    parallel = parallel or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    question = F.coalesce("fingerprint", F.sha2(F.concat_ws("\n", "checkpoint", F.coalesce("research_id", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    texts = (rows if texts is None else texts).withColumn("question", question)
    rows = rows.drop("text", "company").withColumn("question", question)
    kept = ("research_id", "doc_id", "task", "checkpoint", "fingerprint", "key_material")
    hits = None
    if answers is not None:
        known = lifecycle.latest(answers.where(F.col("cache_version") == CACHE_VERSION), ["fingerprint"], [F.col("created_at"), F.col("response")])
        found = judged(rows.join(known.select("fingerprint", "response"), "fingerprint")).where("verified")
        hits = cut(found.where(shaped(F.col("task"), F.col("response"))).select("question", *kept, "response"), "hits")
    missing = rows if hits is None else rows.join(hits.select("question").distinct(), "question", "left_anti")
    asked = lifecycle.latest(missing, ["question"], [F.col("research_id"), F.col("doc_id")])
    small = cut(asked.select("question", "task", "allowed", "claims"), "asked")  # texts are written once, by the caller, and read where a prompt is made
    first = cut(judged(small.join(ask(small.withColumn("repair", F.lit(None).cast("string")), texts, model, parallel), "question")), "judged")
    wrong = first.where(F.col("error").isNull() & ~F.col("verified"))
    told = F.to_json(F.struct(F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed_ids"), F.col("reported").alias("previous_ids"), F.coalesce("reason", "claim_reason").alias("validation")))
    if wrong.isEmpty():
        again = first.select("question", "response", "error").limit(0)
    else:
        again = ask(wrong.select("question", "task", "allowed", "claims", told.alias("repair")), texts, model, parallel)
    second = judged(wrong.select("question", "task", "allowed", "claims").join(again, "question")).select("question", _attempt(2).alias("_second"))
    both = first.select("question", _attempt(1).alias("_first")).join(second, "question", "left")
    last = F.coalesce("_second", "_first")
    settled = both.select(
        "question",
        F.when(last.verified, F.when(F.col("_second").isNull(), "generated").otherwise("repaired")).otherwise("failed").alias("state"),
        F.when(last.verified, last.response).alias("response"),
        last.verified.alias("verified"),
        F.filter(F.array("_first", "_second"), lambda a: a.isNotNull()).alias("attempts"),
        F.coalesce(last.error, F.when(~last.verified, F.concat(F.lit("evidence does not hold: "), F.coalesce(last.reason, last.claim_reason)))).alias("error"),
    )
    out = missing.select("question", *kept).join(settled, "question").drop("question")
    if hits is not None:
        none = F.array().cast(out.schema["attempts"].dataType)
        out = out.unionByName(hits.select(*kept, F.lit("cached").alias("state"), "response", F.lit(True).alias("verified"), none.alias("attempts"), F.lit(None).cast("string").alias("error")))
    return out


class Store:
    """Answers shared by all researches, and a checkpoint for each task that was run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.answers = CommittedTable(spark, f"{folder.rstrip('/')}/answers", ANSWER_ROW)
        self.checkpoints = CommittedTable(spark, f"{folder.rstrip('/')}/checkpoints", CHECKPOINT)

    def commit(self, results: DataFrame, run: str) -> None:
        """Answers first: if the run ends before its checkpoints are committed, the next one finds its answers."""
        name = f"{run}-{uuid.uuid4().hex[:12]}"
        fresh = results.where(F.col("verified") & F.col("fingerprint").isNotNull() & (F.col("state") != "cached"))
        fresh = lifecycle.latest(fresh, ["fingerprint"], [F.col("response")])
        self.answers.append(fresh.select("fingerprint", F.lit(CACHE_VERSION).alias("cache_version"), "task", "key_material", "response", F.current_timestamp().alias("created_at")), name)
        self.checkpoints.append(results.withColumn("pipeline_version", F.lit(PIPELINE_VERSION)).withColumn("committed_at", F.current_timestamp()), name)

    def current(self) -> DataFrame:
        """The last checkpoint of each document's task."""
        return lifecycle.latest(self.checkpoints.read(), KEYS, [F.col("committed_at").desc(), F.col("verified").desc(), F.col("checkpoint")])

    def open_tasks(self, rows: DataFrame) -> DataFrame:
        """The `keyed` rows without a verified checkpoint of just this input, and not given up for it either."""
        settled = self.current().where((F.col("pipeline_version") == PIPELINE_VERSION) & (F.col("verified") | (F.col("state") == "manual_review_required")))
        settled = settled.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("checkpoint").alias("_checkpoint"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS] + [F.col("checkpoint") == F.col("_checkpoint")]
        return rows.join(settled, same, "left_anti")


def run_tasks(prepared: DataFrame, model: Model, store: Store, run: str, environment: str = "normal", rescue: Model | None = None, tasks: tuple[str, ...] = tuple(ANSWERS), parts: int = 1, parallel: int | None = None) -> DataFrame:
    """Runs what is open of each task, task by task and in `parts` parts of its documents, and commits after each; returns the checkpoints.

    A rescue model takes what the first one could not answer; what it can't either is manual_review_required and is not
    asked for again until its input changes. parts is how much is lost when a run is ended, not how many tasks Spark runs.
    """
    rows = cut(keyed(prepared, model, environment), "prepared")
    for task in tasks:
        for part in range(parts):
            own = rows.where((F.col("task") == task) & (F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part))
            names = [*KEYS, "checkpoint"]
            wanted = cut(store.open_tasks(own).select(*[F.col(c).alias(f"_{c}") for c in names]).distinct(), "open")
            if wanted.isEmpty():
                continue
            todo = own.join(wanted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left_semi")
            done = cut(analyse(todo, model, store.answers.read(), parallel, own), "done")
            if rescue is not None and not (failed := done.where("not verified")).isEmpty():
                inputs = todo.join(failed.select(F.col("checkpoint").alias("_c"), F.col("doc_id").alias("_d"), F.col("research_id").alias("_r")), F.col("checkpoint").eqNullSafe(F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("research_id").eqNullSafe(F.col("_r")), "left_semi")
                # the rescue's answers are its own, but they settle the checkpoint of the first model's input
                saves = keyed(inputs.withColumnRenamed("checkpoint", "_first"), rescue, environment).drop("checkpoint").withColumnRenamed("_first", "checkpoint")
                saved = cut(analyse(saves, rescue, store.answers.read(), parallel), "rescued")
                state = F.when(F.col("verified"), "rescued").otherwise("manual_review_required")
                done = done.where("verified").unionByName(saved.withColumn("state", state))
            store.commit(done, f"{run}-{task}")
    return store.current()


def assembled(checkpoints: DataFrame) -> DataFrame:
    """(research_id, doc_id, threat_score, summaries) of documents all of whose tasks are verified: two JSON artifacts.

    The score keeps where its levels come from: claim numbers and cited ids of the answer that holds.
    """
    by = {t: F.max(F.when((F.col("task") == t) & F.col("verified"), F.col("response"))).alias(t) for t in ANSWERS}
    wide = checkpoints.groupBy("research_id", "doc_id").agg(*by.values()).dropna(subset=list(ANSWERS))
    get = lambda task, field: F.get_json_object(task, f"$.{field}")
    ids = lambda task: F.from_json(get(task, ANSWERS[task].ids), "array<string>").alias(task)
    levels = [t for t, a in ANSWERS.items() if a.level]
    score = F.struct(
        *[get(t, ANSWERS[t].value).cast("int").alias(t) for t in levels],
        *[F.trim(get(t, "reason")).alias(f"{t}_reason") for t in levels],
        F.struct(*[get(t, "claim_number").cast("int").alias(t) for t in levels]).alias("claim_traceability"),
        F.struct(*[ids(t) for t in ANSWERS]).alias("evidence_traceability"),
    )
    summaries = F.struct(F.trim(get("technology_summary", "tech_summary")).alias("tech_summary"), F.trim(get("problem_summary", "problem_summary")).alias("problem_summary"))
    return wide.select("research_id", "doc_id", F.to_json(score).alias("threat_score"), F.to_json(summaries).alias("summaries"))

"""Queries over what the library stores: answers and checkpoints, a replaced research with its postings, list histories."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from ..operators import analysis, assembly, checks, list_history, replacement
from ..operators.model import SEARCHED
from ..sources import patent_list
from ..sources.shared import cut, shared_folder
from . import binding
from .binding import read
from .catalogue import IN_SELECTED, LOWER, SELECTED, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH e AS (SELECT event_id, '{"event_type":"' || event_type || '","props":{"k":' || (props->>'k') || '},"tags":["' || event_type || '","é\\\\n' || user_id || '"],"user_id":' || user_id || '}' AS event_json, '{"k":' || (props->>'k') || '}' AS props_json FROM events)
SELECT event_id, event_json, props_json, sha256(event_json) AS event_sha256 FROM e""",
    bound=False,
)
def canonical_events(spark, d):
    """Each event as canonical JSON, with its digest; props come as JSON text."""
    rows = read(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    tags = F.array("event_type", F.concat(F.lit("é\\n"), F.col("user_id").cast("string")))
    rows = rows.withColumn("v", F.struct("user_id", tags.alias("tags"), F.col("p").alias("props"), "event_type"))
    whole = canonical.of(F.col("v"), rows.schema["v"].dataType)
    return rows.select("event_id", whole.alias("event_json"), canonical.of_text(F.col("props")).alias("props_json"), F.sha2(whole, 256).alias("event_sha256"))


@query("SELECT event_id, '{\"k\":' || (props->>'k') || '}' AS variant_json, '{' || '\"' || event_type || '\":[' || user_id || ',null]}' AS map_json FROM events", bound=False)
def canonical_variants(spark, d):
    """Values whose type says little: variants, and maps with the key in the data."""
    rows = read(spark, d, "events").select("event_id", F.parse_json("props").alias("v"), F.create_map("event_type", F.array("user_id", F.lit(None).cast("long"))).alias("m"))
    return rows.select("event_id", canonical.of(F.col("v"), T.VariantType()).alias("variant_json"), canonical.of(F.col("m"), rows.schema["m"].dataType).alias("map_json"))


TASK, ONLY, WRONG = "problem_summary", "P0001-N0001", "P0009-N0009"
MARK = ("## Document\n", "\n\n## Allowed values")


def stand_in(prompt: str, schema: dict, context: int, tokens: int) -> str:
    """In a model's place: texts whose length 5 divides are always cited wrongly, those with a rest of 1 at first."""
    size = len(prompt.split(MARK[0], 1)[1].rsplit(MARK[1], 1)[0])
    wrong = size % 5 == 0 or size % 5 == 1 and "## Rejected evidence" not in prompt
    return json.dumps({TASK: f"{size} characters", "source_paragraph_ids": [WRONG if wrong else ONLY]})


STAND_IN = analysis.Model(stand_in, {"model": "stand-in"}, dict.fromkeys(analysis.ANSWERS, "Name the problem that the document solves."))


def _prompt_sizes() -> tuple[int, int]:
    """Characters of a first and a second prompt without the text."""
    schema, allowed = analysis.response_schema(TASK, [ONLY], []), {"allowed_evidence_ids": [ONLY]}
    told = {"allowed_ids": [ONLY], "previous_ids": [WRONG], "validation": "evidence_id_not_in_task_input"}
    return tuple(len(analysis.prompt_of(STAND_IN.templates[TASK], TASK, schema, "", "", allowed, r)) for r in (None, told))


def _fits(size: int) -> str:
    return f"ceil((n + {size}) * {analysis.TOKENS_A_CHARACTER}) + {analysis.OUTPUT_TOKENS[0]} + {analysis.FRAME_TOKENS} <= {analysis.CONTEXTS[-1]}"


@query(
    f"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN NOT {_fits(_prompt_sizes()[0])} OR n % 5 = 0 THEN 'failed' WHEN n % 5 <> 1 THEN 'generated' WHEN {_fits(_prompt_sizes()[1])} THEN 'repaired' ELSE 'failed' END AS state, {_fits(_prompt_sizes()[0])} AS fits FROM t)
SELECT doc_id, state, CASE WHEN state = 'failed' THEN 'failed' ELSE 'cached' END AS other_research, fits AS was_asked, state <> 'failed' AS checkpoint_verified FROM s""",
    bound=False,
)
def analysis_outcomes(spark, d):
    """What comes of a task for every document, and of the same task in another research that shares the answers."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = F.array(F.lit(ONLY))
    rows = docs.select(
        F.lit("first").alias("research_id"), "doc_id", F.lit(TASK).alias("task"), F.lit("").alias("company"), "text", ids.alias("allowed"), F.array().cast("array<int>").alias("claims"),
        F.sha2("text", 256).alias("pdf_sha256"), *[F.lit(m).alias(m) for m in analysis.MATERIAL[1:]],
    )
    store = analysis.Store(spark, _folder(spark, "analysis"))
    first = analysis.run_tasks(rows, STAND_IN, store, "first", tasks=(TASK,))
    other = analysis.run_tasks(rows.withColumn("research_id", F.lit("other")), STAND_IN, store, "other", tasks=(TASK,))
    a = first.where("research_id = 'first'").select("doc_id", "state", (F.col("attempts")[0]["error"].isNull()).alias("was_asked"), F.col("verified").alias("checkpoint_verified"))
    return a.join(other.where("research_id = 'other'").select("doc_id", F.col("state").alias("other_research")), "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, doc_id % 3 = 0 AS edited FROM documents), s AS (SELECT *, {_fits(_prompt_sizes()[0])} AND n % 5 > 1 AS good, {_fits(_prompt_sizes()[0])} AND n % 5 <> 0 AND (n % 5 > 1 OR {_fits(_prompt_sizes()[1])}) AS held FROM t)
SELECT count(*) AS tasks, count(*) FILTER (NOT held) AS open_after_first, count(*) FILTER (edited OR NOT held) AS open_after_edit FROM s""",
    bound=False,
)
def open_after_edits(spark, d):
    """Tasks that are open after a run, and after every third document has changed: checkpoints of other inputs are stale."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select(
        F.lit("r").alias("research_id"), "doc_id", F.lit(TASK).alias("task"), F.lit("").alias("company"), "text", F.array(F.lit(ONLY)).alias("allowed"), F.array().cast("array<int>").alias("claims"),
        F.sha2("text", 256).alias("pdf_sha256"), *[F.lit(m).alias(m) for m in analysis.MATERIAL[1:]],
    )
    store = analysis.Store(spark, _folder(spark, "resume"))
    analysis.run_tasks(rows, STAND_IN, store, "run", tasks=(TASK,))
    edited = rows.withColumn("reading_policy", F.when(F.col("doc_id") % 3 == 0, "edited").otherwise(F.col("reading_policy")))
    still = [store.open_tasks(analysis.keyed(r, STAND_IN, "normal")).agg(F.count("*").alias("n")) for r in (rows, edited)]
    # one row each
    return rows.agg(F.count("*").alias("tasks")).crossJoin(still[0].withColumnRenamed("n", "open_after_first")).crossJoin(still[1].withColumnRenamed("n", "open_after_edit"))


COLUMNS = "patent_id long, position long, title string, applicant string, category string, year int, legal_status_category string, organization_ids array<string>"


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = binding.tables(spark, d)
    held = t.document_organizations.groupBy("patent_id").agg(F.array_sort(F.collect_set(F.col("organization_id").cast("string"))).alias("organization_ids"))
    docs = t.documents.join(held, "patent_id", "left").select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])
    return cut(docs, "listed"), t.organizations.select(F.col("organization_id").cast("string").alias("organization_id"), "name")


def _replaced(spark: SparkSession, d: str) -> tuple[replacement.Research, DataFrame]:
    """A research whose first list lacks every seventh order and has other titles for every fifth, and then the whole list."""
    docs, names = _listed(spark, d)
    research = replacement.Research(spark, _folder(spark, "research"), "all", COLUMNS)
    older = docs.where("patent_id % 7 <> 0").withColumn("title", F.when(F.col("patent_id") % 5 == 0, "an older title").otherwise(F.col("title")))
    older = older.withColumn("organization_ids", F.when(F.col("patent_id") % 5 == 0, F.array(F.lit("1"))).otherwise(F.col("organization_ids"))).unionByName(docs.limit(1).withColumn("patent_id", F.lit(-1).cast("long")))
    research.replace(older, names.where("organization_id <> '2'"))
    return research, research.replace(docs, names)


@query("SELECT s_suppkey::VARCHAR AS organization_id, s_name AS name, count(patent_id) AS document_count FROM supplier LEFT JOIN (SELECT patent_id, organization_id FROM bridge JOIN docs USING (patent_id)) b ON s_suppkey = organization_id GROUP BY 1, 2")
def replaced_organizations(spark, d):
    """Organization counts that have moved by the difference of two lists."""
    return _replaced(spark, d)[0].organizations()


@query("SELECT CASE WHEN patent_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change, count(*) AS documents FROM docs WHERE patent_id % 7 = 0 OR patent_id % 5 = 0 GROUP BY 1 UNION ALL SELECT 'removed', 1")
def replaced_changes(spark, d):
    """What a second list adds, changes and removes."""
    return _replaced(spark, d)[1].groupBy("change").agg(F.count("*").alias("documents"))


@query(f"""SELECT patent_id, title, applicant, category, year FROM docs WHERE ({" OR ".join(LOWER.format(c) + " LIKE '%mach_nery%'" for c in ("title", "applicant", "category"))}) AND {IN_SELECTED}""")
def document_search_postings(spark, d):
    """document_search, all pages of it, through the stored postings."""
    docs, names = _listed(spark, d)
    research = replacement.Research(spark, _folder(spark, "postings"), "all", COLUMNS)
    research.replace(docs, names)
    return research.find("Mach_nery").where(SELECTED.condition([c for c in research.columns if c not in SEARCHED])).select("patent_id", "title", "applicant", "category", "year")


LISTS = "range(4) l(n)"


@query(
    f"""WITH lists AS (SELECT n, (DATE '2024-01-01' + n::INTEGER)::VARCHAR AS listed FROM {LISTS}),
rows AS (SELECT o_custkey % 5 AS research_id, n, o_orderkey AS patent_id, CASE WHEN n >= 2 AND o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders, {LISTS} WHERE (o_orderkey + n) % 6 <> 0),
marked AS (SELECT *, coalesce(lag(n) OVER w <> n - 1 OR lag(status) OVER w <> status, true)::INTEGER AS b FROM rows WINDOW w AS (PARTITION BY research_id, patent_id ORDER BY n)),
islands AS (SELECT *, sum(b) OVER (PARTITION BY research_id, patent_id ORDER BY n) AS i FROM marked)
SELECT research_id, patent_id, status, 'list' || min(islands.n) AS list_id, (DATE '2024-01-01' + min(islands.n)::INTEGER)::VARCHAR AS valid_from, (SELECT listed FROM lists WHERE lists.n = max(islands.n) + 1) AS valid_to FROM islands GROUP BY research_id, patent_id, status, i""",
    bound=False,
)
def list_spans(spark, d):
    """From which list to which each document's row held, over four lists of all orders."""
    return _spans(spark, d).select("research_id", "patent_id", "status", "list_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def _spans(spark, d):
    n = F.col("n")
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 5).alias("research_id"), F.col("o_orderkey").alias("patent_id"), "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).where((F.col("patent_id") + n) % 6 != 0)
    status = F.when((n >= 2) & (F.col("patent_id") % 5 == 0), "new").otherwise(F.col("o_orderstatus"))
    rows = rows.select("research_id", "patent_id", status.alias("status"), F.concat(F.lit("list"), n.cast("string")).alias("list_id"), F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp").alias("listed_at"))
    return list_history.history(rows, ["status"])


@query(
    """WITH s AS (SELECT o_custkey % 5 AS research_id, o_orderkey % 6 AS r, o_orderkey % 5 = 0 AS renewed FROM orders)
SELECT research_id, count(*) AS results, count(*) FILTER (WHERE r = 3 OR r = 5 OR renewed OR r = 4) AS stale_results, count(*) FILTER (WHERE r = 3 OR r = 5 OR renewed OR r = 4) > 0 AS analysis_stale FROM s GROUP BY 1""",
    bound=False,
)
def stale_researches(spark, d):
    """Results of the day of the second list, of all orders, that a later list has overtaken."""
    results = read(spark, d, "orders").select((F.col("o_custkey") % 5).alias("research_id"), F.col("o_orderkey").alias("patent_id"), F.lit("2024-01-02").cast("timestamp").alias("analysed_at"))
    return list_history.stale_researches(list_history.stale_results(results, _spans(spark, d)))




@query(
    """WITH p AS (SELECT doc_id, doc_id % 7 AS a, n_chars % 6 AS b, length(trim(coalesce(text, ''))) AS n, length(coalesce(text, '')) AS whole, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'keys' WHEN NOT a BETWEEN 1 AND 5 THEN 'similarity' WHEN b IS NULL OR NOT b BETWEEN 1 AND 5 THEN 'concept_level' WHEN n = 0 OR whole > 2000 THEN 'tech_summary' END AS problem FROM p""",
    bound=False,
)
def analysis_validation(spark, d):
    """Whether an analysis can be kept whose summary is a document's whole text; every eleventh lacks a key."""
    docs = read(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    fields = [(F.col("doc_id") % 7).alias("similarity"), (F.col("n_chars") % 6).alias("concept_level"), text.alias("tech_summary"), F.lit("p").alias("problem_summary"), F.lit("r").alias("reasoning"), F.lit("t").alias("tech_cluster")]
    body = F.to_json(F.struct(*fields, F.when(F.col("doc_id") % 11 != 0, F.lit("c")).alias("problem_cluster")))
    return docs.select("doc_id", checks.analysis_problem(body).alias("problem"))


@query(
    """, s AS (SELECT CASE WHEN state = 'skipped' THEN 'skipped' WHEN patent_id % 8 = 0 THEN 'missing' WHEN o.o_totalprice > 50000 THEN 'valid' ELSE 'invalid' END AS t FROM docs JOIN orders o ON patent_id = o_orderkey WHERE pdf_available),
c AS (SELECT count(*) FILTER (t = 'valid') AS v, count(*) FILTER (t = 'missing') AS m, count(*) FILTER (t = 'invalid') AS i, count(*) FILTER (t = 'skipped') AS k FROM s)
SELECT 'selection' AS "check", count(*) > 0 AS ok, count(*) || ' documents' AS detail FROM docs UNION ALL SELECT 'prompts', false, 'prompts 6/6, schemas 5/6' UNION ALL SELECT 'output-isolation', true, 'normal'
UNION ALL SELECT 'model-server', true, '1 models' UNION ALL SELECT 'models', false, 'missing: qwen3-embedding:8b' UNION ALL SELECT 'claim-structure', v = v + m + i AND v > 0, 'valid ' || v || '/' || (v + m + i) || ', missing ' || m || ', invalid ' || i || ', skipped ' || k FROM c"""
)
def preflight_checks(spark, d):
    """Six checks over all documents; those of an eighth have no structure, and cheap orders a structure that is not valid."""
    docs = binding.documents(spark, d)
    structures = read(spark, d, "orders").where("o_orderkey % 8 <> 0").select(F.col("o_orderkey").alias("patent_id"), F.lit(2).alias("schema_version"), (F.col("o_totalprice") > 50000).alias("valid"), F.lit(3).alias("claims"))
    shape = {"type": "object", "required": ["x"]}
    return checks.preflight(docs, structures, dict.fromkeys(checks.PROMPTED, "text"), dict.fromkeys(checks.PROMPTED[1:], shape) | {checks.PROMPTED[0]: {"type": "object"}}, ["gemma4:e4b"], ("normal", "debug"))


@query(
    """, s AS (SELECT patent_id, research_id, CASE WHEN patent_id % 13 = 0 OR patent_id % 10 = 1 THEN 'skipped' WHEN patent_id % 7 = 0 THEN 'pending' WHEN patent_id % 7 <= 2 THEN 'invalid' ELSE 'ready' END AS analysis_state,
  CASE WHEN patent_id % 13 = 0 THEN 'pdf_not_found' WHEN patent_id % 10 = 1 THEN 'by hand' END AS skip_reason FROM docs)
SELECT research_id, patent_id || '.pdf' AS pdf, analysis_state, skip_reason, year(o_orderdate)::INTEGER AS year, CASE WHEN patent_id % 7 >= 3 THEN o_orderpriority END AS reasoning FROM s JOIN orders ON o_orderkey = patent_id"""
)
def assembled_states(spark, d):
    """Listed documents with their result files, skips and pool; files lack fields, hold null ones, or none at all."""
    docs = binding.documents(spark, d).select("research_id", "patent_id")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("patent_id"), "o_orderdate", "o_orderpriority")
    rows = docs.join(o, "patent_id").withColumn("id", F.col("patent_id").cast("string")).withColumn("pdf", F.concat("id", F.lit(".pdf")))
    given = {"research_id": F.col("research_id"), "pdf": F.col("pdf"), "position": F.col("patent_id"), "application_date": F.date_format("o_orderdate", "yyyy-MM-dd")}
    listed = rows.select(*[given.get(c.split(" ")[0], F.lit(None)).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in assembly.GIVEN.split(", ")])
    rest = F.col("patent_id") % 7
    whole = F.to_json(F.struct(F.lit(3).alias("similarity"), F.lit(4).alias("concept_level"), F.lit("t").alias("tech_summary"), F.lit(None).cast("string").alias("problem_summary"), F.col("o_orderpriority").alias("reasoning"), F.lit("T").alias("tech_cluster"), F.lit("P").alias("problem_cluster")), {"ignoreNullFields": "false"})
    payload = F.when(rest == 0, "{}").when(rest == 1, '{"note":1}').when(rest == 2, '{"similarity":1}').otherwise(whole)
    none = F.lit(None).cast("string").alias("subresearch")
    results = assembly.parsed_results(rows.select("research_id", "id", none, payload.alias("payload"), F.lit(1).alias("modified")))
    stored = rows.where("false").select("research_id", "id", *[F.lit(None).cast("int" if f in ("similarity", "concept_level") else "string").alias(f) for f in (*assembly.REQUIRED, *assembly.CLUSTER_IDS)])
    skips = rows.where("patent_id % 10 = 1").select("research_id", "id", none, F.lit("by hand").alias("reason"), F.lit("").alias("detail"))
    out = assembly.assembled_documents(listed, results, stored, skips, rows.where("patent_id % 13 <> 0").select("pdf"))
    return out.select("research_id", "pdf", "analysis_state", "skip_reason", "year", "reasoning")


@query(
    """WITH f AS (SELECT o_custkey AS c, strftime(o_orderdate::DATE, '%Y%m%d') || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || '0000' AS stamp, 'researches/' || o_custkey || '/patent_list_' || strftime(o_orderdate::DATE, '%Y%m%d') || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || '0000.csv' AS path, o_orderkey % 30 < 24 AS dated FROM orders)
SELECT path, row_number() OVER (PARTITION BY c ORDER BY stamp DESC, path DESC) = 1 AS newest FROM f WHERE dated""",
    bound=False,
)
def newest_lists(spark, d):
    """The list that counts in each research's folder; a fifth of the files have an hour that there is not."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit("0000"))
    return patent_list.newest_list(read(spark, d, "orders").select(F.concat(F.lit("researches/"), F.col("o_custkey").cast("string"), F.lit("/patent_list_"), stamp, F.lit(".csv")).alias("path")))

"""Documents with claims, written from the tables by a rule that SQL knows too: a customer is a document, its orders are claims.

The first claim is an apparatus of two parts; of the others an order's rest by 3 tells whether it refers to the first one, to
all before it, or stands by itself. Spark builds the page and takes it apart again; SQL states what must come of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, references, structure
from ..sources.shared import cut
from .binding import read
from .catalogue import query

FIRST = "部品{k}と、部材{d}とを備える装置。"
OTHERS = ("請求項1に記載の装置。", "請求項1から{m}のいずれかに記載の方法。", "部品{k}を含む方法。")
FIELD = "本発明は{s}の市場における装置{d}に関する。"


def _filled(form: str, **values: Column) -> Column:
    """A text with columns in the place of its names."""
    parts, rest = [], form
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page, text): a page of claims, if there are any, and a description."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), nth.alias("n"))
    known = {"k": F.col("k"), "d": F.col("o_custkey"), "m": F.col("n") - 1}
    text = F.when(F.col("n") == 1, _filled(FIRST, **known))
    for rest, form in enumerate(OTHERS):
        text = text.when(F.col("k") % 3 == rest, _filled(form, **known))
    claim = F.struct("n", F.concat(F.lit("【請求項"), F.col("n").cast("string"), F.lit("】\n"), text, F.lit("\n")).alias("t"))
    listed = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(claim)), lambda c: c.t), "").alias("claims"))
    who = read(spark, d, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    field = _filled(FIELD, s=F.col("c_mktsegment"), d=F.col("c_custkey"))
    page = F.concat(F.coalesce(F.concat(F.lit("【特許請求の範囲】\n"), "claims"), F.lit("")), F.lit("【発明の詳細な説明】\n【技術分野】\n【0001】"), field, F.lit("\n"))
    return who.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), page.alias("text"))


CLAIMS = "c AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), s AS (SELECT *, n = 1 OR k % 3 = 2 AS independent FROM c)"


@query(
    f"""WITH {CLAIMS} SELECT doc_id, n::INTEGER AS number, CASE WHEN independent THEN 'independent' ELSE 'dependent' END AS type, CASE WHEN n = 1 OR k % 3 = 0 THEN 'apparatus' ELSE 'method' END AS category,
  CASE WHEN independent THEN '' WHEN k % 3 = 0 THEN '1' ELSE array_to_string(range(1, n), ',') END AS depends_on, CASE WHEN n = 1 THEN 2 ELSE 1 END AS elements,
  CASE WHEN n > 1 AND k % 3 = 1 THEN 'limitation' ELSE 'component' END AS first_element FROM s""",
    bound=False,
)
def claim_structures(spark, d):
    """Every claim with what it refers to, its category and its elements."""
    c = structure.structured_claims(pages(spark, d))
    return c.select("doc_id", F.col("number").cast("int").alias("number"), "type", "category", F.array_join(F.transform("depends_on", lambda n: n.cast("string")), ",").alias("depends_on"), F.size("elements").alias("elements"), F.col("elements")[0]["type"].alias("first_element"))


@query(f"WITH {CLAIMS} SELECT doc_id, count(*) AS claims, count(*) FILTER (independent) AS independent, sum(CASE WHEN n = 1 THEN 2 ELSE 1 END)::BIGINT AS elements FROM s GROUP BY 1", bound=False)
def claim_statistics(spark, d):
    """Claims, leading ones and elements of each document that has claims."""
    return structure.claim_statistics(structure.structured_claims(pages(spark, d)))


@query(f"WITH {CLAIMS} SELECT doc_id, n::INTEGER AS number FROM s WHERE independent", bound=False)
def leading_claims(spark, d):
    """The claims that scores may name."""
    return structure.lead_claims(structure.structured_claims(pages(spark, d))).select("doc_id", F.col("number").cast("int").alias("number"))


@query("SELECT c_custkey AS doc_id, '0001' AS paragraph_number, '本発明は' || c_mktsegment || 'の市場における装置' || c_custkey || 'に関する。' AS text, sha256('本発明は' || c_mktsegment || 'の市場における装置' || c_custkey || 'に関する。') AS sha256 FROM customer", bound=False)
def described_fields(spark, d):
    """The numbered paragraph of each document's technical field."""
    return structure.structured_paragraphs(pages(spark, d)).where("section = 'technical_field'").select("doc_id", "paragraph_number", "text", "sha256")


@query(
    f"""WITH {CLAIMS}, e AS (SELECT doc_id, sum(CASE WHEN NOT independent THEN 0 WHEN n = 1 THEN 2 ELSE 1 END)::INTEGER AS allowed, arg_max(independent, n) AS held, max(n)::INTEGER AS claim_number FROM s GROUP BY 1)
SELECT doc_id, allowed, claim_number, held AS verified, CASE WHEN NOT held THEN 'evidence_id_not_in_task_input' END AS reason, CASE WHEN NOT held THEN 'claim_number_not_in_scoring_input' END AS claim_reason,
  CASE WHEN claim_number = 1 THEN 1 WHEN held THEN 2 ELSE 1 END AS sources FROM e""",
    bound=False,
)
def cited_evidence(spark, d):
    """An answer for each document that cites its first and its last claim, and names the last one, against what its input holds."""
    own = cut(pages(spark, d), "pages")
    claims, paragraphs = cut(structure.structured_claims(own), "claims"), cut(structure.structured_paragraphs(own), "paragraphs")
    allowed = cut(references.allowed_ids(evidence.evidence_packs(paragraphs, claims, "装置")).where("task = 'similarity'"), "allowed")
    last = claims.groupBy("doc_id").agg(F.max("number").cast("int").alias("n"))
    cited = last.select("doc_id", F.lit("similarity").alias("task"), F.array(F.lit(" C1-E1 "), F.format_string("[C%d-E1 component]", "n")).alias("cited"), F.col("n").cast("string").alias("number"))
    checked = references.checked_references(cited, allowed)
    sources = references.verified_sources(checked, references.source_rows(paragraphs, claims)).groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").cast("int").alias("sources"))
    named = references.checked_claims(cited.select(F.col("doc_id"), F.col("number").alias("reported")), claims).select(F.col("doc_id").alias("_c"), "claim_number", F.col("reason").alias("claim_reason"))
    size = allowed.select(F.col("doc_id").alias("_a"), F.size("allowed").alias("allowed"))
    out = checked.join(size, F.col("doc_id") == F.col("_a")).join(named, F.col("doc_id") == F.col("_c")).join(sources, F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", "allowed", "claim_number", "verified", "reason", "claim_reason", "sources")


PACKED = """SELECT doc_id, task, claim_sources, 1 AS paragraph_sources, 'technical_field' AS sections, score, reasons FROM
  (SELECT c_custkey AS doc_id, coalesce(i, 0)::INTEGER AS claim_sources FROM customer LEFT JOIN (SELECT doc_id, count(*) FILTER (independent) AS i FROM s GROUP BY 1) x ON doc_id = c_custkey)
  CROSS JOIN (VALUES ('similarity', 29.5::DOUBLE, 'section:technical_field,role:component,company_overlap:1.000'), ('technology_summary', 12.5::DOUBLE, 'section:technical_field,role:component')) t(task, score, reasons)"""


@query(f"WITH {CLAIMS} {PACKED}", bound=False)
def evidence_reasons(spark, d):
    """What each document's packs hold of claims and paragraphs, and why the paragraph was taken."""
    own = cut(pages(spark, d), "pages")
    packs = evidence.evidence_packs(structure.structured_paragraphs(own), structure.structured_claims(own), "装置").where(F.col("task").isin("similarity", "technology_summary"))
    last = F.element_at("sources", -1)
    return packs.select("doc_id", "task", "claim_sources", "paragraph_sources", F.array_join(F.map_keys("selected_sections"), ",").alias("sections"), last["score"].alias("score"), F.array_join(last["reasons"], ",").alias("reasons"))

"""The reference queries over the binding, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import assembly, evidence, facets, finalize, grid, grounding, lifecycle, materials, registry, structure, trend, vectors
from ..operators.model import DocumentFilter
from ..sources import patent_list
from ..streaming.ingest import keep_latest, windowed_counts
from . import binding
from .binding import SQL, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, bound: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SQL}{sql}" if bound and sql.startswith(",") else f"WITH {SQL} {sql}" if bound else sql
        return f

    return add


SELECTED = DocumentFilter(year_from=1996, year_to=2000, statuses=["rights_acquired", "under_examination"])
CELL = DocumentFilter(similarity=4, concept_level=5)
ORGS = list(range(1, 21))
RULES = {"rights_acquired": ["F", "P"], "under_examination": ["O"]}
IN_SELECTED = "year BETWEEN 1996 AND 2000 AND legal IN ('rights_acquired', 'under_examination')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STATUS_COUNTS = "count(*) FILTER (WHERE {0} legal = 'rights_acquired') AS rights_acquired, count(*) FILTER (WHERE {0} legal = 'under_examination') AS under_examination, count(*) FILTER (WHERE {0} legal = 'published') AS published"


@query(f"""SELECT patent_id, title, applicant, category, year FROM docs WHERE ({" OR ".join(LOWER.format(c) + " LIKE '%mach_nery%'" for c in ("title", "applicant", "category"))}) AND {IN_SELECTED} ORDER BY position LIMIT 500""")
def document_search(spark, d):
    where = DocumentFilter(query="Mach_nery", year_from=1996, year_to=2000, statuses=SELECTED.statuses)
    return facets.document_page(binding.tables(spark, d), where, limit=500).select("patent_id", "title", "applicant", "category", "year")


@query("SELECT patent_id, year, state AS analysis_state FROM docs WHERE EXISTS (SELECT 1 FROM bridge b WHERE b.patent_id = docs.patent_id AND b.organization_id BETWEEN 1 AND 20) ORDER BY position, patent_id LIMIT 200 OFFSET 100")
def document_page_org_filter(spark, d):
    return facets.document_page(binding.tables(spark, d), DocumentFilter(organization_ids=ORGS), 200, 100).select("patent_id", "year", "analysis_state")


HEAD = "count(*) AS total, count(*) FILTER (WHERE state = 'ready') AS ready, count(*) FILTER (WHERE legal = 'rights_acquired') AS registered, count(*) FILTER (WHERE state = 'ready' AND similarity >= 4 AND concept_level >= 4) AS threat"


@query(f"SELECT {HEAD} FROM docs WHERE {IN_SELECTED}")
def headline_metrics(spark, d):
    return facets.headline(SELECTED.apply(binding.tables(spark, d)))


@query(f"SELECT similarity, concept_level, count(*) AS count FROM docs WHERE state = 'ready' AND {IN_SELECTED} GROUP BY ALL")
def threat_cells(spark, d):
    return facets.threat_cells(SELECTED.apply(binding.tables(spark, d)))


@query("SELECT s.s::INTEGER AS similarity, c.c::INTEGER AS concept_level, count(patent_id) AS count FROM generate_series(1, 5) s(s) CROSS JOIN generate_series(1, 5) c(c) LEFT JOIN docs ON similarity = s.s AND concept_level = c.c AND state = 'ready' AND category <> 'BUILDING' GROUP BY ALL")
def threat_cells_zero_filled(spark, d):
    return facets.threat_grid(binding.documents(spark, d).where("category <> 'BUILDING'"))


TECH_SQL = "SELECT tech::VARCHAR AS tech, problem::VARCHAR AS problem, max('T' || tech) AS tech_name, max('P' || problem) AS problem_name, count(*) AS count FROM docs WHERE state = 'ready' AND {} GROUP BY 1, 2"


@query(TECH_SQL.format(IN_SELECTED))
def technology_cells(spark, d):
    return facets.technology_cells(SELECTED.apply(binding.tables(spark, d)))


NARROW = DocumentFilter(year_from=1996, year_to=1997, statuses=["published"])
IN_NARROW = "year BETWEEN 1996 AND 1997 AND legal = 'published'"


@query(f", cells AS ({TECH_SQL.format(IN_NARROW)}) SELECT * FROM cells WHERE tech IN (SELECT tech FROM cells GROUP BY tech HAVING sum(count) >= 5) AND problem IN (SELECT problem FROM cells GROUP BY problem HAVING sum(count) >= 5)")
def technology_cells_min_size(spark, d):
    return facets.of_min_size(facets.technology_cells(NARROW.apply(binding.tables(spark, d))), 5)


ORG_EXISTS = "EXISTS (SELECT 1 FROM bridge b WHERE b.patent_id = docs.patent_id AND b.organization_id BETWEEN 1 AND 20)"


@query(f"SELECT 'aggregates' AS scope, {HEAD} FROM docs WHERE {IN_SELECTED} UNION ALL SELECT 'overlay', {HEAD} FROM docs WHERE {IN_SELECTED} AND {ORG_EXISTS} UNION ALL SELECT 'selection', {HEAD} FROM docs WHERE {IN_SELECTED} AND {ORG_EXISTS} AND similarity = 4 AND concept_level = 5")
def facet_scopes(spark, d):
    from dataclasses import replace

    return facets.facet_scopes(binding.tables(spark, d), replace(SELECTED, similarity=4, concept_level=5, organization_ids=ORGS))


@query(f", a AS ({TECH_SQL.format('year = 1996')}), b AS ({TECH_SQL.format(f'year = 1996 AND {ORG_EXISTS}')}) SELECT coalesce(a.tech, b.tech) AS tech, coalesce(a.problem, b.problem) AS problem, coalesce(a.count, 0) AS population, coalesce(b.count, 0) AS overlay FROM a FULL JOIN b ON a.tech = b.tech AND a.problem = b.problem")
def overlay_cells(spark, d):
    t = binding.tables(spark, d)
    where = DocumentFilter(year_from=1996, year_to=1996)
    from dataclasses import replace

    return facets.overlay_cells(facets.technology_cells(where.apply(t)), facets.technology_cells(replace(where, organization_ids=ORGS).apply(t)))


LINKED = f"bridge JOIN docs USING (patent_id) WHERE {IN_SELECTED}"


@query(f"SELECT organization_id, count(DISTINCT patent_id) AS count FROM {LINKED} GROUP BY 1")
def organization_counts(spark, d):
    t = binding.tables(spark, d)
    return facets.organization_counts(SELECTED.apply(t), t)


@query(f"SELECT organization_id, s_name AS name, count(*) AS count FROM bridge JOIN docs USING (patent_id) JOIN supplier ON s_suppkey = organization_id WHERE {IN_SELECTED} GROUP BY 1, 2 ORDER BY count DESC, name, organization_id LIMIT 10")
def organization_top10(spark, d):
    t = binding.tables(spark, d)
    return facets.organization_top(SELECTED.apply(t), t)


@query(f"SELECT organization_id % 10 AS group_id, count(*)::BIGINT AS count FROM {LINKED} GROUP BY 1")
def group_ranking_sum(spark, d):
    t = binding.tables(spark, d)
    return facets.group_ranking(SELECTED.apply(t), t, binding.groups(spark, d))


@query(f"SELECT organization_id % 10 AS group_id, count(DISTINCT patent_id) AS count FROM {LINKED} GROUP BY 1")
def group_ranking_distinct(spark, d):
    t = binding.tables(spark, d)
    return facets.group_ranking(SELECTED.apply(t), t, binding.groups(spark, d), distinct=True)


@query("SELECT coalesce(source_status, '') AS source_status, count(*) AS count FROM docs GROUP BY 1")
def source_status_counts(spark, d):
    return facets.source_status_counts(binding.documents(spark, d))


@query("SELECT CASE WHEN source_status IN ('F', 'P') THEN 'rights_acquired' WHEN source_status = 'O' THEN 'under_examination' ELSE 'published' END AS category, count(*)::BIGINT AS count FROM docs GROUP BY 1")
def legal_status_preview(spark, d):
    return facets.legal_status_preview(binding.documents(spark, d), RULES)


@query("SELECT unnest(generate_series(min(year), max(year)))::INTEGER AS year FROM docs")
def year_bounds_axis(spark, d):
    return trend.year_axis(binding.documents(spark, d))


@query("SELECT DISTINCT year FROM docs WHERE year IS NOT NULL")
def distinct_years(spark, d):
    return facets.distinct_years(binding.documents(spark, d))


@query("SELECT research_id, count(*) AS documents FROM docs GROUP BY 1")
def documents_per_research(spark, d):
    return facets.documents_per_research(binding.documents(spark, d))


AXIS = "axis AS (SELECT unnest(generate_series(min(year), max(year)))::INTEGER AS year FROM docs)"
IN_CELL = "similarity = 4 AND concept_level = 5"
SERIES = f", {AXIS}, s AS (SELECT year, count(*) FILTER (WHERE {IN_CELL}) AS cell, count(*) AS baseline, {STATUS_COUNTS.format(IN_CELL + ' AND')} FROM docs WHERE state = 'ready' AND year IS NOT NULL GROUP BY 1)"


@query(SERIES + " SELECT year, coalesce(cell, 0) AS cell, coalesce(baseline, 0) AS baseline, CASE WHEN coalesce(baseline, 0) > 0 THEN round_even(cell / baseline, 6) ELSE 0 END AS share FROM axis LEFT JOIN s USING (year)")
def trend_series(spark, d):
    return trend.cell_trend(binding.tables(spark, d), CELL).select("year", "cell", "baseline", "share")


@query(SERIES + " SELECT year, coalesce(rights_acquired, 0) AS rights_acquired, coalesce(under_examination, 0) AS under_examination, coalesce(published, 0) AS published FROM axis LEFT JOIN s USING (year)")
def trend_status_pivot(spark, d):
    return trend.cell_trend(binding.tables(spark, d), CELL).select("year", *trend.STATUSES)


def _direction_sql(cells: str) -> str:
    return f""", b AS (SELECT max(year) AS last FROM docs), n AS (SELECT {cells}, year, count(*) AS n FROM docs WHERE state = 'ready' GROUP BY ALL),
t AS (SELECT {cells}, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE year IS NOT NULL), 0)::BIGINT AS dated, min(year) AS first_year,
  arg_max(year, n * 10000 - year) FILTER (WHERE year IS NOT NULL) AS peak_year, coalesce(sum(n) FILTER (WHERE year BETWEEN last - 2 AND last), 0)::BIGINT AS recent,
  coalesce(sum(n) FILTER (WHERE year BETWEEN last - 5 AND last - 3), 0)::BIGINT AS previous, max(last) AS last FROM n, b GROUP BY ALL)
SELECT * EXCLUDE (last), CASE WHEN total = 0 THEN 'unobserved' WHEN dated = 0 THEN 'undated' WHEN dated < 3 THEN 'sparse' WHEN first_year >= last - 2 AND previous = 0 THEN 'emerging'
  WHEN recent >= 1.25 * previous AND recent - previous >= 2 THEN 'growing' WHEN previous >= 3 AND recent <= 0.75 * previous THEN 'declining' ELSE 'stable' END AS direction FROM t"""


@query(_direction_sql("similarity, concept_level"))
def trend_direction(spark, d):
    return trend.trend_directions(binding.documents(spark, d), ["similarity", "concept_level"])


@query(_direction_sql("tech, problem").replace("SELECT * EXCLUDE (last)", "SELECT tech AS tech_cluster_id, problem AS problem_cluster_id, * EXCLUDE (last, tech, problem)"))
def trend_direction_technology(spark, d):
    return trend.trend_directions(binding.documents(spark, d), ["tech_cluster_id", "problem_cluster_id"])


@query(f", c AS (SELECT * FROM docs WHERE state = 'ready' AND {IN_CELL} AND year BETWEEN 1996 AND 2000) SELECT organization_id, s_name AS name, count(*) AS count, {STATUS_COUNTS.format('')}, round_even(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c JOIN bridge USING (patent_id) JOIN supplier ON s_suppkey = organization_id GROUP BY 1, 2 ORDER BY count DESC, name, organization_id LIMIT 10")
def trend_organizations(spark, d):
    return trend.trend_organizations(binding.tables(spark, d), DocumentFilter(year_from=1996, year_to=2000, similarity=4, concept_level=5))


@query(f", g AS (SELECT year_source, count(*) AS count, count(*) FILTER (WHERE year >= 2000) AS late FROM docs WHERE state = 'ready' AND {IN_CELL} AND year IS NOT NULL GROUP BY 1) SELECT year_source, count, CASE WHEN (SELECT count(*) FROM g) = 1 AND year_source = 'application_date' THEN 'application_year' ELSE 'mixed_available_year' END AS year_basis, (SELECT sum(late) FROM g) > 0 AS provisional FROM g")
def trend_year_basis(spark, d):
    return trend.trend_year_basis(binding.tables(spark, d), CELL, as_of_year=2001)


@query(
    ", r AS (SELECT *, patent_id % 13 = 0 AS again FROM docs) SELECT count(*) AS total, count(*) FILTER (WHERE pdf_available) AS available, count(*) FILTER (WHERE NOT again AND state = 'ready') AS finalized, count(*) FILTER (WHERE CASE WHEN again THEN state IN ('ready', 'invalid', 'skipped') ELSE state = 'pending' END) AS pending, count(*) FILTER (WHERE NOT again AND state = 'skipped') AS skipped, count(*) FILTER (WHERE CASE WHEN again THEN state IN ('ready', 'pending', 'skipped') ELSE state = 'invalid' END) AS failed FROM r"
)
def pipeline_counts(spark, d):
    docs = binding.documents(spark, d)
    return lifecycle.pipeline_counts(docs, docs.where("patent_id % 13 = 0").select("patent_id"))


ART = ", art AS (SELECT patent_id, k AS artifact_type, run_id, CASE WHEN run_id = 'r2' THEN 2 WHEN patent_id % 5 = 0 THEN 3 ELSE 1 END AS updated_at FROM docs, unnest(['score', 'summaries', 'embedding'][1:(patent_id % 3 + 1)]) x(k), (VALUES ('r1'), ('r2')) v(run_id))"


@query(ART + " SELECT patent_id FROM art WHERE artifact_type IN ('score', 'summaries') GROUP BY 1 HAVING count(DISTINCT artifact_type) = 2")
def having_two_artifacts(spark, d):
    return lifecycle.having_all_artifacts(binding.artifacts(binding.documents(spark, d)), ["score", "summaries"])


@query(ART + " SELECT patent_id, artifact_type, run_id, updated_at FROM art QUALIFY row_number() OVER (PARTITION BY patent_id, artifact_type ORDER BY updated_at DESC, run_id DESC) = 1")
def latest_artifact(spark, d):
    return lifecycle.latest_artifact(binding.artifacts(binding.documents(spark, d)))


@query("SELECT vec_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)", bound=False)
def orphan_vectors(spark, d):
    docs = read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return lifecycle.orphans(read(spark, d, "embeddings").select("vec_id"), docs, ["vec_id"])


@query("SELECT count(*) AS count, max(len(embedding))::INTEGER AS max_dimensions, min(len(embedding))::INTEGER AS min_dimensions FROM embeddings WHERE embedding IS NOT NULL", bound=False)
def embedding_summary(spark, d):
    return lifecycle.embedding_summary(read(spark, d, "embeddings"), "embedding")


@query("SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'continued' END AS change FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) b ON a.k = b.k", bound=False)
def csv_diff(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return lifecycle.list_diff(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 3 <> 0"), "o_orderkey")


@query("WITH k AS (SELECT o_orderkey, 0 AS pr, o_orderkey % 2000 AS key FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey % 2000 FROM orders), h AS (SELECT DISTINCT o_orderkey, pr, p_name || '.pdf' AS pdf FROM k JOIN part ON p_partkey = key) SELECT o_orderkey, b.pdf, coalesce(n, 0) AS candidates FROM orders LEFT JOIN (SELECT o_orderkey, arg_min(pdf, {'pr': pr, 'pdf': pdf}) AS pdf, count(*) AS n FROM h GROUP BY 1) b USING (o_orderkey)", bound=False)
def number_match_priority(spark, d):
    o = read(spark, d, "orders")
    keys = F.array(*[F.struct(F.lit(i).alias("priority"), (F.col(c) % 2000).alias("key")) for i, c in enumerate(("o_orderkey", "o_custkey"))])
    wanted = o.select("o_orderkey", F.explode(keys).alias("k")).select("o_orderkey", "k.*")
    pool = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(".pdf")).alias("pdf"))
    return patent_list.match_priority(wanted, pool, "o_orderkey")


KEY_SQL = r"lower(regexp_replace(coalesce(text, ''), '[ \t\n\r.,;:()\[\]]+', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN k <> '' AND row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM (SELECT doc_id, {KEY_SQL} AS k FROM documents) WINDOW w AS (PARTITION BY k ORDER BY doc_id)", bound=False)
def duplicate_first_occurrence(spark, d):
    rows = read(spark, d, "documents").select("doc_id", structure.ascii_key(F.col("text")).alias("key"))
    return structure.first_occurrence(rows, [], "key", "doc_id", ["doc_id"]).select("doc_id", "duplicate_of")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), k AS (SELECT doc_id, i // 4 AS page, {KEY_SQL} AS key FROM l), n AS (SELECT doc_id, count(DISTINCT page) AS p FROM k GROUP BY 1 HAVING count(DISTINCT page) >= 3) SELECT doc_id, key, count(DISTINCT page) AS pages FROM k JOIN n USING (doc_id) WHERE length(key) BETWEEN 1 AND 80 GROUP BY doc_id, key, p HAVING count(DISTINCT page) >= greatest(2, ceil(p / 2))", bound=False)
def repeated_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return structure.repeated_page_lines(lines.select("doc_id", F.floor(F.col("i") / 4).alias("page"), structure.ascii_key(F.col("line")).alias("key")))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'unclassified') AS section FROM conversations", bound=False)
def section_forward_fill(spark, d):
    rows = read(spark, d, "conversations")
    return structure.forward_fill(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "unclassified", "section").select("conv_id", "turn", "section")


@query("WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM lineitem), s AS (SELECT *, lag(n) OVER (PARTITION BY l_suppkey ORDER BY p) AS b FROM n), i AS (SELECT *, sum(CASE WHEN n = 1 OR b IS NULL OR n <> b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM s), r AS (SELECT l_suppkey, g, min(p) AS run_start, count(*) AS run_length FROM i GROUP BY 1, 2 HAVING min(n) = 1) SELECT l_suppkey, arg_max(run_start, run_length * 10000000 - run_start) AS run_start, max(run_length) AS run_length FROM r GROUP BY 1", bound=False)
def claim_run_islands(spark, d):
    from pyspark.sql import Window

    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = read(spark, d, "lineitem").select("l_suppkey", *order)
    tasks = max(lines.count() // 1_000_000, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))  # a task sorts about a million lines, however many there are
    rows = lines.repartition(tasks, "l_suppkey").select("*", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long").alias("p"))
    return structure.longest_runs(rows, ["l_suppkey"], "p", "l_linenumber", order)


def _grams_sql(width: int, key: str = "k") -> str:
    return f"list_distinct(list_transform(range(1, greatest(0, length({key}) - {width - 1}) + 1), lambda i: substr({key}, i, {width})))"


@query(f"WITH c AS (SELECT {_grams_sql(2)} AS c FROM (SELECT {KEY_SQL} AS k FROM benchmark WHERE item_id = 0)), b AS (SELECT item_id, {_grams_sql(2)} AS g FROM (SELECT item_id, {KEY_SQL} AS k FROM benchmark)) SELECT item_id, CASE WHEN len(g) > 0 AND len(c) > 0 THEN round_even(len(list_intersect(g, c)) / len(c), 6) ELSE 0 END AS overlap FROM b, c", bound=False)
def char_ngram_overlap(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", evidence.char_ngrams(structure.ascii_key(F.col("text")), 2).alias("g"))
    company = rows.where("item_id = 0").select(F.col("g").alias("c"))  # one row
    return rows.crossJoin(F.broadcast(company)).select("item_id", F.bround(evidence.overlap(F.col("g"), F.col("c")), 6).alias("overlap"))


@query(f"WITH b AS (SELECT item_id, {_grams_sql(3)} AS g FROM (SELECT item_id, {KEY_SQL} AS k FROM benchmark)) SELECT a.item_id AS a, b.item_id AS b, round_even(len(list_intersect(a.g, b.g)) / greatest(1, len(list_distinct(list_concat(a.g, b.g)))), 6) AS jaccard FROM b a JOIN b ON b.item_id = a.item_id + 1", bound=False)
def ngram_jaccard(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", evidence.char_ngrams(structure.ascii_key(F.col("text")), 3).alias("g"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return rows.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.bround(evidence.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query()
def near_duplicate_pairs(spark, d):
    return evidence.near_duplicate_pairs(read(spark, d, "documents"), "doc_id", "text").withColumn("jaccard", F.bround("jaccard", 6))


def _paragraphs(spark, d):
    """Documents as paragraph rows: the source picks the section, words of the text its roles."""
    docs = read(spark, d, "documents")
    names = F.array(*[F.lit(s) for s in ("solution", "background", "problem", "embodiments", "summary")])
    pick = F.get(names, (F.col("doc_id") % 5).cast("int"))
    roles = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "control"), F.when(F.col("doc_id") % 3 == 0, "parameter")), lambda r: r.isNotNull())
    return docs.select("doc_id", pick.alias("section"), roles.alias("roles"), F.when(F.col("doc_id") % 7 == 0, "0001").alias("paragraph_number"), (F.col("doc_id") % 11 == 0).alias("boilerplate"), F.when(F.col("doc_id") % 13 == 0, "P0001-N0001").alias("duplicate_of"), F.col("source"))


@query("WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 1 THEN -100.0 ELSE [10, 0, 0, 4, 4][doc_id % 5 + 1] + CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE 0 END - CASE WHEN doc_id % 11 = 0 THEN 20 ELSE 0 END - CASE WHEN doc_id % 13 = 0 THEN 30 ELSE 0 END END::DOUBLE AS score FROM documents) SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5", bound=False)
def evidence_score_topk(spark, d):
    from pyspark.sql import Window

    rows = _paragraphs(spark, d).select("source", "doc_id", evidence.paragraph_score("similarity").alias("score"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("score").desc(), "doc_id"))
    return rows.withColumn("rank", rank).where("rank <= 5")


@query()
def paragraph_units(spark, d):
    pages = read(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return structure.structured_paragraphs(pages).select("doc_id", "paragraph_id", "section", "characters", "duplicate_of", "sha256")


@query()
def evidence_pack(spark, d):
    pages = read(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    packs = evidence.evidence_packs(structure.structured_paragraphs(pages), structure.structured_claims(pages), "制御装置と処理方法", pages)
    return packs.select("doc_id", "task", "maximum", F.length("rendered_text").alias("characters"), F.sha2("rendered_text", 256).alias("text_sha256"), F.size("sources").alias("sources"), "candidates", "near_duplicates")


CENTROID = "u AS (SELECT label, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x, unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY 1, 2), c AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM m)"


@query(f"WITH {CENTROID} SELECT a.label AS a, b.label AS b, round(1 - sum(a.value * b.value), 6) AS distance FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2", bound=False)
def cosine_pairs(spark, d):
    few = vectors.centroid_vectors(read(spark, d, "embeddings"), "label", "embedding")
    return vectors.cosine_pairs(few, "label", "centroid").withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings", bound=False)
def cosine_to_reference(spark, d):
    rows = read(spark, d, "embeddings")
    reference = rows.where("vec_id = 0").select(F.col("embedding").alias("_r"))  # one row
    return rows.crossJoin(F.broadcast(reference)).select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("_r")), 6).alias("distance"))


@query(f"WITH {CENTROID} SELECT label, dim, round(value, 6) AS value FROM c", bound=False)
def cluster_centroids(spark, d):
    return vectors.centroids(read(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


@query(f"WITH {CENTROID}, r AS (SELECT unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r FROM embeddings WHERE vec_id = 0), p AS (SELECT label, sum(value * r) AS s FROM c JOIN r USING (dim) GROUP BY 1) SELECT label, round_even(CASE WHEN (SELECT max(s) - min(s) FROM p) <= 1e-12 THEN 1 ELSE (s - (SELECT min(s) FROM p)) / (SELECT max(s) - min(s) FROM p) END, 6) AS relative_proximity FROM p", bound=False)
def relative_proximity(spark, d):
    rows = read(spark, d, "embeddings")
    reference = rows.where("vec_id = 0").select(F.posexplode(vectors.unit(F.col("embedding"))).alias("dim", "r"))
    near = vectors.centroids(rows, "label", "embedding").join(F.broadcast(reference), "dim").groupBy("label").agg(F.sum(F.col("value") * F.col("r")).alias("s"))
    return grid.relative_proximity(near, "s").select("label", "relative_proximity")


@query("WITH p AS (SELECT vec_id, list_transform(range(0, 16), lambda i: embedding[i * 4 + 1]::DOUBLE - embedding[i * 4 + 2]::DOUBLE + embedding[i * 4 + 3]::DOUBLE - embedding[i * 4 + 4]::DOUBLE) AS s FROM embeddings) SELECT vec_id, unnest(range(0, 16))::INTEGER AS dim, round(unnest(list_transform(s, lambda x: x / sqrt(list_dot_product(s, s)))), 6) AS value FROM p", bound=False)
def fixed_projection(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.fixed_projection(F.col("embedding"), 64, 16)).alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query()
def agglomerative_clusters(spark, d):
    return vectors.label_clusters(read(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query()
def minibatch_clusters(spark, d):
    return vectors.clusters(read(spark, d, "embeddings"), "vec_id", "embedding", k=12)


@query()
def semantic_order(spark, d):
    rows = read(spark, d, "embeddings")
    placed = finalize.axis(rows, rows.select("vec_id", F.col("label").alias("cluster")), "vec_id", "embedding")
    return placed.select(F.col("cluster").cast("string").alias("label"), "position")


GRID = f""", cells AS (SELECT tech::VARCHAR AS tech, problem::VARCHAR AS problem, count(*) AS count FROM docs WHERE state = 'ready' AND {IN_NARROW} GROUP BY 1, 2 HAVING count(*) >= 3),
xs AS (SELECT tech, row_number() OVER (ORDER BY tech) - 1 AS x FROM cells GROUP BY tech), ys AS (SELECT problem, row_number() OVER (ORDER BY problem) - 1 AS y FROM cells GROUP BY problem),
g AS (SELECT tech, problem, x, y, coalesce(count, 0) AS count FROM xs CROSS JOIN ys LEFT JOIN cells USING (tech, problem)),
t AS (SELECT *, sum(count) OVER (PARTITION BY tech) AS tt, sum(count) OVER (PARTITION BY problem) AS pt FROM g)"""


def _gaps(spark, d):
    return facets.technology_cells(NARROW.apply(binding.tables(spark, d))).where("count >= 3")


@query(GRID + """, s AS (SELECT tech, problem, x, y, pt / (SELECT max(pt) FROM t) AS demand, tt / (SELECT max(tt) FROM t) AS capability,
  (SELECT count(*) FILTER (WHERE n.count > 0) FROM g n WHERE abs(n.x - t.x) + abs(n.y - t.y) = 1) AS occupied_neighbours,
  (SELECT count(*) FILTER (WHERE n.count > 0) / count(*) FROM g n WHERE abs(n.x - t.x) + abs(n.y - t.y) = 1) AS adjacency FROM t WHERE count = 0)
SELECT tech, problem, occupied_neighbours, round(0.3 * demand + 0.25 * capability + 0.2 * adjacency, 6) AS opportunity, round(0.4 * capability + 0.3 * demand + 0.3 * adjacency, 6) AS bridge FROM s""")
def whitespace_scores(spark, d):
    out = grid.whitespace_scores(_gaps(spark, d))
    return out.select("tech", "problem", "occupied_neighbours", F.round("opportunity", 6).alias("opportunity"), F.round("bridge", 6).alias("bridge"))


@query("RECURSIVE" + GRID + """, e AS (SELECT tech, problem, x, y FROM g WHERE count = 0),
w AS (SELECT x, y, x AS x0, y AS y0 FROM e UNION SELECT e.x, e.y, w.x0, w.y0 FROM w JOIN e ON abs(e.x - w.x) + abs(e.y - w.y) = 1),
b AS (SELECT x, y, min(x0 * (SELECT count(*) FROM ys) + y0) AS block, count(*) AS block_size FROM w GROUP BY 1, 2)
SELECT tech, problem, block, block_size, CASE WHEN block_size >= greatest(4, ceil((SELECT count(*) FROM g) / 5)) THEN 'large' WHEN block_size > 1 THEN 'contiguous' ELSE 'isolated' END AS pattern FROM e JOIN b USING (x, y)""")
def whitespace_blocks(spark, d):
    return grid.whitespace_blocks(_gaps(spark, d))


ORACLES["whitespace_blocks"] = "WITH RECURSIVE " + SQL + ORACLES["whitespace_blocks"].split("RECURSIVE", 1)[1]
PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}, "additionalProperties": False}


@query("SELECT event_id, coalesce((props->>'k')::BIGINT BETWEEN 0 AND 50, false) AS ok FROM events", bound=False)
def schema_validation(spark, d):
    return read(spark, d, "events").select("event_id", grounding.validated(F.col("props"), PROPS).alias("v")).select("event_id", "v.ok")


@query("WITH c AS (SELECT event_type AS task, event_id % 3 <> 0 AS verified FROM events), g AS (SELECT task, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS invalid FROM c GROUP BY task UNION ALL SELECT 'all', count(*) FILTER (WHERE verified), count(*) FILTER (WHERE NOT verified) FROM c) SELECT task, verified, invalid, round_even(verified / (verified + invalid), 6) AS rate FROM g", bound=False)
def grounding_summary(spark, d):
    return grounding.validation_rates(read(spark, d, "events").select(F.col("event_type").alias("task"), (F.col("event_id") % 3 != 0).alias("verified")))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", bound=False)
def incremental_latest(spark, d):
    return keep_latest(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", bound=False)
def event_hourly_window(spark, d):
    out = windowed_counts(read(spark, d, "events"), "ts", ["event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT r_name AS research_id, r_regionkey % 2 = 0 AS kept, count(patent_id) AS documents FROM region LEFT JOIN docs ON research_id = r_name WHERE r_regionkey <> 3 GROUP BY 1, 2")
def list_researches(spark, d):
    rows = read(spark, d, "region").select(F.col("r_name").alias("research_id"), (F.col("r_regionkey") % 2 == 0).alias("kept"), F.when(F.col("r_regionkey") == 3, "archived").otherwise("active").alias("lifecycle_status"))
    return registry.list_researches(rows, binding.documents(spark, d)).select("research_id", "kept", "documents")


@query("SELECT count(*) AS vectors, count(*) FILTER (WHERE embedding IS NULL) AS missing, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = vec_id)) AS orphans FROM embeddings", bound=False)
def embedding_integrity(spark, d):
    vectors_ = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.lit(64).alias("dimensions"))
    return registry.embedding_integrity(vectors_, read(spark, d, "labels"), ["doc_id"])


@query("SELECT label AS cluster, vec_id AS key FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20", bound=False)
def cluster_first_members(spark, d):
    return registry.first_members(read(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("key")))


@query("SELECT count(*) FILTER (WHERE state <> 'skipped' AND patent_id % 4 > 1) AS valid, count(*) FILTER (WHERE state <> 'skipped' AND patent_id % 4 = 0) AS missing, count(*) FILTER (WHERE state <> 'skipped' AND patent_id % 4 = 1) AS invalid, count(*) FILTER (WHERE state = 'skipped') AS skipped FROM docs")
def structure_tallies(spark, d):
    docs = binding.documents(spark, d)
    structured = docs.where("patent_id % 4 <> 0").select("patent_id", (F.col("patent_id") % 4 > 1).alias("valid"))
    return registry.structure_tallies(docs, structured)


@query("SELECT patent_id FROM docs WHERE state <> 'ready' AND patent_id % 3 <> 0")
def open_work(spark, d):
    docs = binding.documents(spark, d).withColumn("skip_reason", F.lit(None).cast("string"))
    return registry.open_work(docs, docs.where("patent_id % 3 = 0"), ["patent_id"]).select("patent_id")


@query(f""", c AS (SELECT * FROM docs WHERE state = 'ready' AND {IN_CELL}), n AS (SELECT year, count(*) AS n FROM c WHERE year IS NOT NULL GROUP BY 1),
l AS (SELECT max(year) AS last FROM docs), t AS (SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c WHERE year BETWEEN 1996 AND 2000) AS selected_count,
  coalesce(sum(n), 0)::BIGINT AS dated_total, arg_max(year, n * 10000 - year) AS peak_year, coalesce(max(n), 0) AS peak_count, coalesce(sum(n) FILTER (WHERE year > last - 3), 0)::BIGINT AS recent_three_years,
  coalesce(sum(n) FILTER (WHERE year BETWEEN last - 5 AND last - 3), 0)::BIGINT AS previous_three_years, coalesce(max(year) >= 2000, false) AS provisional, min(year) AS f, max(last) AS l FROM l LEFT JOIN n ON true)
SELECT * EXCLUDE (f, l), total - dated_total AS undated, CASE WHEN total = 0 THEN 'unobserved' WHEN dated_total = 0 THEN 'undated' WHEN dated_total < 3 THEN 'sparse' WHEN f >= l - 2 AND previous_three_years = 0 THEN 'emerging'
  WHEN recent_three_years >= 1.25 * previous_three_years AND recent_three_years - previous_three_years >= 2 THEN 'growing' WHEN previous_three_years >= 3 AND recent_three_years <= 0.75 * previous_three_years THEN 'declining' ELSE 'stable' END AS direction FROM t""")
def trend_summary(spark, d):
    from dataclasses import replace

    return trend.trend_report(binding.tables(spark, d), replace(CELL, year_from=1996, year_to=2000), "threat", 2001)["summary"]


#: Numbers of documents made from an order's key: as written, with full-width digits and other hyphens, and as normalised.
_MADE = ("WO{y}/{n}", "特開{y}-{n}", "特許第{n}号", "特開平{h}-{n}", "JPB{n}", "資料{y}")
_MADE_SQL = "CASE o_orderkey % 6 " + " ".join("WHEN {} THEN '{}'".format(i, m.replace("{y}", "' || year(o_orderdate) || '").replace("{n}", "' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '").replace("{h}", "' || (o_orderkey % 40) || '")) for i, m in enumerate(_MADE)) + " END"


def _numbers(spark, d):
    part = {"{y}": F.year("o_orderdate").cast("string"), "{n}": F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), "{h}": (F.col("o_orderkey") % 40).cast("string")}
    number = F.lit(None).cast("string")
    for i, m in enumerate(_MADE):
        made = F.lit(m)
        for k, v in part.items():
            made = F.replace(made, F.lit(k), v)
        number = F.when(F.col("o_orderkey") % 6 == i, made).otherwise(number)
    written = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), F.translate(number, "0123456789-", "０１２３４５６７８９ー"))).otherwise(number)
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate", N.publication_number(written).alias("number"))


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderkey % 6 AS k, {_MADE_SQL} AS number, o_orderkey % 40 AS h, (o_orderkey % 1000000)::VARCHAR AS n, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, number, CASE k WHEN 0 THEN 'WO:' || y || ':' || n WHEN 1 THEN 'JP_A:' || y || ':' || n WHEN 2 THEN 'JP_B:' || n WHEN 3 THEN 'JP_A_H:' || h || ':' || n END AS match_key,
  CASE k WHEN 0 THEN y WHEN 1 THEN y WHEN 3 THEN CASE WHEN h BETWEEN 1 AND 31 THEN h + 1988 END WHEN 5 THEN y END::INTEGER AS inferred_year,
  CASE WHEN k IN (2, 4) THEN 'registered' WHEN k IN (0, 1, 3) THEN 'published' ELSE 'unknown' END AS inferred_status, CASE WHEN o_orderkey % 3 = 0 THEN y END::INTEGER AS application_year FROM o""",
    bound=False,
)
def document_numbers(spark, d):
    rows = _numbers(spark, d)
    number = F.col("number")
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yy/MM/dd"))
    return rows.select(
        "o_orderkey", "number", N.match_key(number).alias("match_key"), N.infer_year(number).alias("inferred_year"), N.infer_status(number).alias("inferred_status"), N.application_year(date).alias("application_year")
    )


@query("WITH l AS (SELECT l_orderkey, 'WO' || l_partkey AS a, 'JP' || l_suppkey AS b, strftime(l_shipdate, '%Y.%m.%d') AS day, l_linenumber AS n FROM lineitem) SELECT l_orderkey, n, number, CASE WHEN place = 0 OR n % 2 = 0 THEN replace(day, '.', '-') END AS date, CASE WHEN place = 0 THEN 'wo' ELSE 'domestic' END AS kind FROM (SELECT *, unnest([a, b]) AS number, unnest([0, 1]) AS place FROM l)", bound=False)
def publication_lists(spark, d):
    day = F.date_format("l_shipdate", "yyyy.MM.dd")
    numbers = F.concat(F.lit(" WO"), "l_partkey", F.lit(", ,JP"), "l_suppkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.explode(N.publications(numbers, F.when(F.col("l_linenumber") % 2 == 0, F.concat(day, F.lit(","), day)).otherwise(day))).alias("p"))
    return rows.select("l_orderkey", "n", "p.number", "p.date", "p.kind")


@query("WITH m AS (SELECT o_orderkey, (SELECT count(*) FROM (SELECT DISTINCT pr, key FROM (VALUES (0, o_orderkey % 2000), (1, o_custkey % 2000)) v(pr, key)) JOIN part ON p_partkey = key) AS n FROM orders) SELECT count(*) AS rows, count(*) FILTER (WHERE n > 0) AS matched_pdfs, count(*) FILTER (WHERE n = 0) AS missing_pdfs, count(*) FILTER (WHERE n > 1) AS multiple_candidates FROM m", bound=False)
def list_match_audit(spark, d):
    return assembly.match_audit(number_match_priority(spark, d))


@query("SELECT vec_id AS patent_id, position, len(embedding)::INTEGER AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings JOIN docs ON patent_id = vec_id WHERE state <> 'skipped'")
def embedding_scan(spark, d):
    rows = read(spark, d, "embeddings").withColumnRenamed("vec_id", "patent_id")
    got = materials.vector_scan(rows, binding.documents(spark, d), ["patent_id"], "embedding")
    return got.select("patent_id", "position", "dimensions", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings", bound=False)
def vector_blobs(spark, d):
    v = F.col("embedding").cast("array<float>")
    rows = read(spark, d, "embeddings").select("vec_id", v.alias("v"), materials.encode_vector(v).alias("blob"))
    return rows.select("vec_id", F.length("blob").cast("long").alias("bytes"), (materials.decode_vector(F.col("blob")) == F.col("v")).alias("same"))


STAGES = ("document_structure", "threat_score", "summaries", "analysis_complete")
_STAGED = ", staged AS (SELECT patent_id, 'document_structure' AS artifact_type FROM docs WHERE patent_id % 2 = 0 UNION ALL SELECT patent_id, 'threat_score' FROM docs WHERE patent_id % 3 = 0 UNION ALL SELECT patent_id, 'summaries' FROM docs WHERE patent_id % 4 = 0 UNION ALL SELECT patent_id, 'analysis_complete' FROM docs WHERE patent_id % 5 = 0)"


def _staged(docs):
    kinds = F.array_compact(F.array(*[F.when(F.col("patent_id") % (i + 2) == 0, k) for i, k in enumerate(STAGES)]))
    rows = docs.select("patent_id", F.explode(kinds).alias("artifact_type"))
    return rows.withColumn("run_id", F.when(F.col("patent_id") % 7 == 0, "r1").otherwise("")).withColumn("payload", F.concat("artifact_type", F.lit(":"), "patent_id"))


@query("SELECT patent_id, position, 'threat_score:' || patent_id AS threat_score, 'summaries:' || patent_id AS summaries FROM docs JOIN embeddings ON vec_id = patent_id WHERE state <> 'skipped' AND patent_id % 12 = 0 AND patent_id % 7 <> 0")
def analysis_materials(spark, d):
    docs = binding.documents(spark, d)
    return materials.analysis_materials(docs, read(spark, d, "embeddings").select(F.col("vec_id").alias("patent_id")), _staged(docs), ["patent_id"])


@query(_STAGED + """, r AS (SELECT *, patent_id % 13 = 0 AS again FROM docs), p AS (SELECT count(*) AS total, count(*) FILTER (WHERE pdf_available) AS available, count(*) FILTER (WHERE NOT again AND state = 'ready') AS finalized,
  count(*) FILTER (WHERE CASE WHEN again THEN state IN ('ready', 'invalid', 'skipped') ELSE state = 'pending' END) AS pending, count(*) FILTER (WHERE NOT again AND state = 'skipped') AS skipped, count(*) FILTER (WHERE CASE WHEN again THEN state IN ('ready', 'pending', 'skipped') ELSE state = 'invalid' END) AS failed FROM r)
SELECT p.*, (SELECT count(DISTINCT patent_id) FROM staged WHERE artifact_type = 'document_structure') AS prepared,
  (SELECT count(*) FROM (SELECT patent_id FROM staged WHERE artifact_type IN ('threat_score', 'summaries') AND patent_id % 13 <> 0 GROUP BY 1 HAVING count(*) = 2)) AS analyzed,
  greatest(0, pending - (SELECT count(*) FROM staged JOIN docs USING (patent_id) WHERE artifact_type = 'analysis_complete' AND state = 'pending')) AS llm_pending FROM p""")
def stage_counts(spark, d):
    docs = binding.documents(spark, d)
    return materials.stage_counts(docs, _staged(docs), docs.where("patent_id % 13 = 0").select("patent_id"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE patent_id % 2 = 0) AS prepared, count(*) FILTER (WHERE patent_id % 12 = 0 AND patent_id % 11 <> 0) AS analyzed, count(*) FILTER (WHERE state = 'ready') AS finalized, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'pending' AND patent_id % 5 <> 0) AS llm_pending, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state <> 'skipped' AND patent_id % 11 = 0) AS failed FROM docs")
def overview_counts(spark, d):
    docs = binding.documents(spark, d)
    return assembly.overview_counts(registry.stage_flags(docs, _staged(docs), list(STAGES)), docs.where("patent_id % 11 = 0"))


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'documents', count(*) FROM documents", bound=False)
def table_statistics(spark, d):
    return materials.table_statistics({name: read(spark, d, name) for name in ("orders", "embeddings", "documents")})


@query("SELECT research_id, count(*) AS documents, sha256(string_agg(coalesce(title, '') || chr(10), '' ORDER BY position)) AS fingerprint FROM docs GROUP BY 1")
def selection_fingerprint(spark, d):
    return materials.ordered_fingerprint(binding.documents(spark, d), "research_id", ["position"], "title")


@query("SELECT (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) = 0 AND (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)) = 0 AS same", bound=False)
def same_document_keys(spark, d):
    return materials.same_keys(read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not_json' WHEN 1 THEN 'similarity' WHEN 2 THEN 'similarity' WHEN 3 THEN 'concept_level' WHEN 4 THEN 'similarity_reason' WHEN 5 THEN 'concept_level_reason' END AS problem FROM events", bound=False)
def score_validation(spark, d):
    bodies = ("{", '{"similarity":true}', '{"similarity":6}', '{"similarity":5,"concept_level":"3"}', '{"similarity":1,"concept_level":3,"similarity_reason":" "}', '{"similarity":1,"concept_level":3,"similarity_reason":"a","concept_level_reason":7}', '{"similarity":1,"concept_level":5,"similarity_reason":"a","concept_level_reason":"b"}')
    body = F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("event_id") % 7).cast("int"))
    return read(spark, d, "events").select("event_id", materials.score_problem(body).alias("problem"))


@query("WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 9 <> 0 THEN user_id || ':' || event_type END AS k FROM events), s AS (SELECT k FROM e WHERE event_id % 4 = 0 AND k IS NOT NULL), n AS (SELECT * FROM e WHERE event_id % 4 <> 0) SELECT k AS idempotency_key, min(ts)::VARCHAR AS at FROM n WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM s) GROUP BY 1 UNION ALL SELECT NULL, ts::VARCHAR FROM n WHERE k IS NULL", bound=False)
def audit_append(spark, d):
    key = F.when(F.col("event_id") % 9 != 0, F.concat("user_id", F.lit(":"), "event_type"))
    rows = read(spark, d, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("action"), key.alias("idempotency_key"))
    got = materials.appended_audit(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 <> 0"))
    return got.select("idempotency_key", F.col("at").cast("string").alias("at"))


@query(f", t AS (SELECT s.s::INTEGER AS similarity, c.c::INTEGER AS concept_level, count(patent_id) AS count FROM generate_series(1, 5) s(s) CROSS JOIN generate_series(1, 5) c(c) LEFT JOIN docs ON similarity = s.s AND concept_level = c.c AND state = 'ready' AND {IN_NARROW} GROUP BY ALL) SELECT similarity, concept_level, round(CASE WHEN count = 0 THEN 0.04 ELSE 0.18 + 0.65 * count / (SELECT max(count) FROM t) END, 6)::DOUBLE AS alpha FROM t")
def cell_density(spark, d):
    cells = materials.cell_density(facets.threat_grid(NARROW.apply(binding.tables(spark, d))))
    return cells.select("similarity", "concept_level", F.round("alpha", 6).alias("alpha"))


@query(f", g AS (SELECT organization_id % 10 AS group_id, count(*)::BIGINT AS count FROM {LINKED} GROUP BY 1) SELECT group_id, count, floor(count * 100 / (SELECT count(*) FROM docs) + 0.5)::BIGINT AS percent, row_number() OVER (ORDER BY count DESC, group_id)::INTEGER AS rank FROM g")
def group_ranking_numbers(spark, d):
    t = binding.tables(spark, d)
    rows = facets.group_ranking(SELECTED.apply(t), t, binding.groups(spark, d)).crossJoin(F.broadcast(t.documents.agg(F.count("*").alias("_all"))))
    return materials.ranked(rows.withColumn("percent", materials.percent(F.col("count"), F.col("_all"))).drop("_all"), "count", "group_id")


@query("WITH r AS (SELECT o_orderkey, o_custkey % 9 AS research_id, ['list', 'manifest', 'legacy'][o_orderkey % 3 + 1] AS kind FROM orders), f AS (SELECT DISTINCT research_id, kind FROM r WHERE NOT (research_id % 3 = 0 AND kind = 'list') AND NOT (research_id % 2 = 0 AND kind = 'manifest')), c AS (SELECT research_id, arg_min(kind, list_position(['list', 'manifest', 'legacy'], kind)) AS kind FROM f GROUP BY 1) SELECT o_orderkey, research_id, kind FROM r SEMI JOIN c USING (research_id, kind)", bound=False)
def source_precedence(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in assembly.PRECEDENCE]), (F.col("o_orderkey") % 3).cast("int"))
    rows = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("research_id"), kind.alias("kind"))
    files = rows.select("research_id", "kind").distinct().where("not (research_id % 3 = 0 and kind = 'list') and not (research_id % 2 = 0 and kind = 'manifest')")
    return assembly.rows_by_precedence(rows, files).select("o_orderkey", "research_id", "kind")

"""Pages and facets over filtered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import DocumentFilter, Tables, high_threat, ready, registered

PAGE_DEFAULT, PAGE_MOST = 200, 500


def share(part: Column, whole: Column) -> Column:
    """part / whole to six digits, half to even; 0.0 of nothing."""
    return F.when(whole > 0, F.bround(part / whole, 6)).otherwise(F.lit(0.0))


def document_page(tables: Tables, where: DocumentFilter, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A page in the order of position, then key; the limit is clamped to 1 to 500."""
    rows = where.apply(tables).orderBy("position", "patent_id")
    return rows.offset(max(0, offset)).limit(min(PAGE_MOST, max(1, limit)))


def headline(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("total"),
        F.count_if(ready()).alias("ready"),
        F.count_if(registered()).alias("registered"),
        F.count_if(high_threat()).alias("threat"),
    )


def threat_cells(docs: DataFrame) -> DataFrame:
    inside = docs.where(ready() & F.col("similarity").between(1, 5) & F.col("concept_level").between(1, 5))
    return inside.groupBy("similarity", "concept_level").agg(F.count("*").alias("count"))


def threat_grid(docs: DataFrame) -> DataFrame:
    """All 25 cells, empty ones with 0."""
    spark = docs.sparkSession
    axes = spark.createDataFrame([(s, c) for s in range(1, 6) for c in range(1, 6)], "similarity int, concept_level int")
    return axes.join(threat_cells(docs), ["similarity", "concept_level"], "left").select("similarity", "concept_level", F.coalesce("count", F.lit(0)).alias("count"))


def technology_cells(docs: DataFrame) -> DataFrame:
    inside = docs.where(ready() & F.col("tech_cluster_id").isNotNull() & F.col("problem_cluster_id").isNotNull())
    return inside.groupBy(F.col("tech_cluster_id").cast("string").alias("tech"), F.col("problem_cluster_id").cast("string").alias("problem")).agg(
        F.max("tech_cluster").alias("tech_name"), F.max("problem_cluster").alias("problem_name"), F.count("*").alias("count")
    )


def of_min_size(cells: DataFrame, least: int) -> DataFrame:
    """Cells of which both axis clusters hold at least `least` documents."""
    tech = F.sum("count").over(Window.partitionBy("tech"))
    problem = F.sum("count").over(Window.partitionBy("problem"))
    return cells.withColumns({"_t": tech, "_p": problem}).where((F.col("_t") >= least) & (F.col("_p") >= least)).drop("_t", "_p")


def facet_scopes(tables: Tables, where: DocumentFilter) -> DataFrame:
    """Headline metrics for three scopes in one pass: aggregates (no cell, no organizations), overlay (no cell), selection.

    One scan of the widest scope; the narrower ones are flags, and organizations are looked up by a
    left join with the distinct matching keys.
    """
    base = where.without_cell().without_organizations().apply(tables)
    member = F.lit(True)
    if where.organization_ids is not None:
        keys = [c for c in ("research_id", "patent_id") if c in tables.document_organizations.columns]
        held = tables.document_organizations.where(F.col("organization_id").isin(list(where.organization_ids)))
        base = base.join(held.select(*keys).distinct().withColumn("_member", F.lit(True)), keys, "left")
        member = F.coalesce("_member", F.lit(False))
    cell = where.condition(tables.documents.columns)
    flags = {"aggregates": F.lit(True), "overlay": member, "selection": member & F.coalesce(cell, F.lit(False))}
    marked = base.select("*", *[f.alias(f"_in_{k}") for k, f in flags.items()])
    counts = []
    for scope in flags:
        inside = F.col(f"_in_{scope}")
        counts += [F.count_if(inside & c).alias(f"{scope}_{name}") for name, c in (("total", F.lit(True)), ("ready", ready()), ("registered", registered()), ("threat", high_threat()))]
    one = marked.agg(*counts)
    rows = [F.struct(F.lit(s).alias("scope"), *[F.col(f"{s}_{m}").alias(m) for m in ("total", "ready", "registered", "threat")]) for s in flags]
    return one.select(F.inline(F.array(*rows)))


def overlay_cells(population: DataFrame, overlay: DataFrame) -> DataFrame:
    """Population and overlay counts side by side; a missing side is 0."""
    a = population.select("tech", "problem", F.col("count").alias("population"))
    b = overlay.select("tech", "problem", F.col("count").alias("overlay"))
    return a.join(b, ["tech", "problem"], "full_outer").select("tech", "problem", F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("overlay", F.lit(0)).alias("overlay"))


def _links(docs: DataFrame, tables: Tables) -> DataFrame:
    keys = [c for c in ("research_id", "patent_id") if c in tables.document_organizations.columns]
    return tables.document_organizations.join(docs.select(*keys), keys, "left_semi")


def organization_counts(docs: DataFrame, tables: Tables) -> DataFrame:
    """Documents by organization. The bridge holds a pair once, so a plain count is a distinct one."""
    return _links(docs, tables).groupBy("organization_id").agg(F.count("*").alias("count"))


def organization_top(docs: DataFrame, tables: Tables, most: int = 10) -> DataFrame:
    named = organization_counts(docs, tables).join(tables.organizations, "organization_id")
    return named.orderBy(F.col("count").desc(), "name", "organization_id").limit(most).select("organization_id", "name", "count")


def group_ranking(docs: DataFrame, tables: Tables, groups: DataFrame, distinct: bool = False) -> DataFrame:
    """Documents by group (group_id, name, member_ids): a joint filing counts once a member, or once a group if distinct."""
    members = groups.select("group_id", F.explode("member_ids").alias("organization_id"))
    if distinct:
        hits = _links(docs, tables).join(members, "organization_id").select("group_id", "patent_id").distinct().groupBy("group_id").agg(F.count("*").alias("count"))
    else:
        hits = organization_counts(docs, tables).join(members, "organization_id").groupBy("group_id").agg(F.sum("count").alias("count"))
    return hits.where("count > 0").select("group_id", "count")


def source_status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("source_status", F.lit("")).alias("source_status")).agg(F.count("*").alias("count"))


def classify_status(status: Column, rules: dict[str, list[str]]) -> Column:
    """The legal status category of a source status under rules {category: statuses}; others are published."""
    out = F.lit("published")
    for category in ("under_examination", "rights_acquired"):
        out = F.when(status.isin(rules.get(category, [])), category).otherwise(out)
    return out


def legal_status_preview(docs: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """What the categories would count under draft rules, from the counts by source status."""
    counts = source_status_counts(docs)
    return counts.groupBy(classify_status(F.col("source_status"), rules).alias("category")).agg(F.sum("count").alias("count"))


def distinct_years(docs: DataFrame) -> DataFrame:
    return docs.where("year is not null").select("year").distinct()


def documents_per_research(docs: DataFrame, researches: DataFrame | None = None) -> DataFrame:
    counts = docs.groupBy("research_id").agg(F.count("*").alias("documents"))
    if researches is None:
        return counts
    return researches.join(counts, "research_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def axis_order(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Positions of the technology axis: the given order (tech, position) first, clusters it lacks after it by id."""
    seen = cells.select("tech").distinct().join(order, "tech", "left")
    last = F.coalesce(F.max("position").over(Window.partitionBy(F.lit(0))), F.lit(-1))
    extra = F.row_number().over(Window.partitionBy(F.col("position").isNull()).orderBy("tech"))
    return seen.select("tech", F.coalesce(F.col("position"), last + extra).cast("int").alias("position"))

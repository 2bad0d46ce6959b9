"""Yearly trends of map cells."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import _links, share
from .model import DocumentFilter, Tables, ready, registered

STATUSES = ("rights_acquired", "under_examination", "published")


def year_bounds(docs: DataFrame) -> DataFrame:
    return docs.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def year_axis(docs: DataFrame) -> DataFrame:
    """Every year from the first to the last of the documents, whatever filters hold."""
    return year_bounds(docs).where("year_min is not null").select(F.explode(F.sequence("year_min", "year_max")).alias("year"))


def status_category() -> Column:
    """Grouped by the derived category itself, so that equal categories are one row."""
    c = F.col("legal_status_category")
    return F.when(c.isin("rights_acquired", "under_examination"), c).otherwise("published")


def cell_condition(where: DocumentFilter) -> Column:
    """The cell of the filter alone."""
    return DocumentFilter(similarity=where.similarity, concept_level=where.concept_level, tech_cluster_id=where.tech_cluster_id, problem_cluster_id=where.problem_cluster_id).condition(())


def cell_trend(tables: Tables, where: DocumentFilter) -> DataFrame:
    """(year, cell, baseline, share, one column a status): the cell against all ready documents of the same filters.

    One scan: cell, baseline and statuses are conditional counts. Years of the filter do not cut the series.
    """
    base = where.without_cell().without_years().apply(tables).where(ready() & F.col("year").isNotNull())
    cell = F.coalesce(cell_condition(where), F.lit(False))
    by = base.groupBy("year").agg(
        F.count_if(cell).alias("cell"), F.count("*").alias("baseline"), *[F.count_if(cell & (status_category() == s)).alias(s) for s in STATUSES]
    )
    scope = tables.documents if where.research_id is None else tables.documents.where(F.col("research_id") == where.research_id)
    whole = year_axis(scope).join(by, "year", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("cell", "baseline", *STATUSES)]
    return whole.select("year", *zero).withColumn("share", share(F.col("cell"), F.col("baseline")))


def direction(total: Column, dated: Column, first_year: Column, last_year: Column, recent: Column, previous: Column) -> Column:
    """The label of a series; the rules hold in this order."""
    return (
        F.when(total == 0, "unobserved")
        .when(dated == 0, "undated")
        .when(dated < 3, "sparse")
        .when((first_year >= last_year - 2) & (previous == 0), "emerging")
        .when((recent >= previous * 1.25) & (recent - previous >= 2), "growing")
        .when((previous >= 3) & (recent <= previous * 0.75), "declining")
        .otherwise("stable")
    )


def trend_directions(docs: DataFrame, cell: list[str]) -> DataFrame:
    """One row per cell: totals, first and peak year, recent and previous three axis years, and the direction."""
    bounds = year_bounds(docs)
    inside = docs.where(ready())
    for c in cell:
        inside = inside.where(F.col(c).isNotNull())
    by = inside.groupBy(*cell, "year").agg(F.count("*").alias("n"))
    last = F.col("year_max")
    # one row, a bounded broadcast
    joined = by.crossJoin(F.broadcast(bounds))
    window = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("year").between(last - lo, last - hi), F.col("n"))), F.lit(0))
    out = joined.groupBy(*cell).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("year").isNotNull(), F.col("n"))), F.lit(0)).alias("dated"),
        F.min("year").alias("first_year"),
        F.max_by("year", F.when(F.col("year").isNotNull(), F.struct("n", (-F.col("year")).alias("y")))).alias("peak_year"),
        window(2, 0).alias("recent"),
        window(5, 3).alias("previous"),
        F.max("year_max").alias("last_year"),
    )
    label = direction(F.col("total"), F.col("dated"), F.col("first_year"), F.col("last_year"), F.col("recent"), F.col("previous"))
    return out.withColumn("direction", label).drop("last_year")


def trend_organizations(tables: Tables, where: DocumentFilter, most: int = 10) -> DataFrame:
    """The cell's organizations within the filter's years, by status, with their share of the cell's documents."""
    docs = where.apply(tables).where(ready())
    linked = _links(docs, tables).join(docs.select("patent_id", status_category().alias("_s")), "patent_id")
    by = linked.groupBy("organization_id").agg(F.count("*").alias("count"), *[F.count_if(F.col("_s") == s).alias(s) for s in STATUSES])
    total = docs.agg(F.count("*").alias("_total"))
    named = by.join(tables.organizations, "organization_id").crossJoin(F.broadcast(total))
    top = named.orderBy(F.col("count").desc(), "name", "organization_id").limit(most)
    return top.select("organization_id", "name", "count", *STATUSES, share(F.col("count"), F.col("_total")).alias("share"))


def trend_year_basis(tables: Tables, where: DocumentFilter, as_of_year: int) -> DataFrame:
    """Counts of dated documents by year source, whether application dates are the only one, and whether a year is still provisional."""
    docs = where.without_years().apply(tables).where(ready() & F.col("year").isNotNull())
    source = F.coalesce(F.nullif(F.col("year_source"), F.lit("")), F.lit("unknown"))
    by = docs.groupBy(source.alias("year_source")).agg(F.count("*").alias("count"), F.count_if(F.col("year") >= as_of_year - 1).alias("_late"))
    everything = Window.partitionBy(F.lit(0))
    only = (F.count("*").over(everything) == 1) & (F.col("year_source") == "application_date")
    return by.select(
        "year_source",
        "count",
        F.when(only, "application_year").otherwise("mixed_available_year").alias("year_basis"),
        (F.sum("_late").over(everything) > 0).alias("provisional"),
    )


def cell_of(where: DocumentFilter, kind: str) -> DocumentFilter:
    """The filter with the coordinates of one kind of cell alone; both must be given."""
    axes = {"threat": ("similarity", "concept_level"), "technology": ("tech_cluster_id", "problem_cluster_id")}
    if kind not in axes:
        raise ValueError(f"kind must be one of {', '.join(axes)}")
    if any(getattr(where, a) is None for a in axes[kind]):
        raise ValueError(f"a trend of kind {kind} takes {' and '.join(axes[kind])}")
    return replace(where.without_cell(), **{a: getattr(where, a) for a in axes[kind]})


def cell_summary(tables: Tables, where: DocumentFilter, as_of_year: int) -> DataFrame:
    """One row: all of the cell's documents, those within the filter's years, dated ones, peak, recent and previous three
    axis years, direction, and whether a year is still provisional. An empty cell is unobserved, with counts of 0."""
    scope = tables.documents if where.research_id is None else tables.documents.where(F.col("research_id") == where.research_id)
    inside = F.coalesce(DocumentFilter(year_from=where.year_from, year_to=where.year_to).condition(()), F.lit(False))
    docs = where.without_years().apply(tables).where(ready())
    by = docs.groupBy("year").agg(F.count("*").alias("n"), F.count_if(inside).alias("s"))
    last, n, dated = F.col("year_max"), F.col("n"), F.col("year").isNotNull()
    total = lambda test, of=n: F.coalesce(F.sum(F.when(test, of)), F.lit(0))
    # rows are years, bounds one row: a bounded broadcast
    out = by.crossJoin(F.broadcast(year_bounds(scope))).agg(
        total(F.lit(True)).alias("total"),
        total(F.lit(True), F.col("s")).alias("selected_count"),
        total(dated).alias("dated_total"),
        total(~dated).alias("undated"),
        F.max_by("year", F.when(dated, F.struct("n", (-F.col("year")).alias("y")))).alias("peak_year"),
        F.coalesce(F.max(F.when(dated, n)), F.lit(0)).alias("peak_count"),
        total(F.col("year").between(last - 2, last)).alias("recent_three_years"),
        total(F.col("year").between(last - 5, last - 3)).alias("previous_three_years"),
        F.coalesce(F.max("year") >= as_of_year - 1, F.lit(False)).alias("provisional"),
        F.min("year").alias("_first"),
        F.max("year_max").alias("_last"),
    )
    label = direction(F.col("total"), F.col("dated_total"), F.col("_first"), F.col("_last"), F.col("recent_three_years"), F.col("previous_three_years"))
    return out.withColumn("direction", label).drop("_first", "_last")


def trend_report(tables: Tables, where: DocumentFilter, kind: str, as_of_year: int) -> dict[str, DataFrame]:
    """The parts of a cell's trend, each lazy: series, summary, year basis and the leading organizations within the filter's years."""
    cell = cell_of(where, kind)
    return {
        "series": cell_trend(tables, cell),
        "summary": cell_summary(tables, cell, as_of_year),
        "year_basis": trend_year_basis(tables, cell, as_of_year),
        "organizations": trend_organizations(tables, cell),
    }

"""Pages to paragraphs and to claims, as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import text as T
from ..functions.vocabulary import BOILERPLATE, ROLES, SECTION_ROLES
from ..sources.shared import cut

PAGE = "units array<struct<key:string,opens:string,number:string,body:string,body_key:string>>, edges array<string>, headers int"
CLAIM = "number int, text string, type string, depends_on array<int>, category string, elements array<struct<element_id:string,text:string,type:string,limitations:array<string>,sha256:string>>"


#: So many pages or documents are Python objects at once; a batch of Spark's holds more.
AT_ONCE = 64


def _sliced(build: Callable[[str], object], returns: str) -> Callable[[Column], Column]:
    """A function of a text as a Column. Of a batch only AT_ONCE texts and results are Python objects, the rest stays Arrow."""
    type_ = to_arrow_type(DataType.fromDDL(returns))

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([build(t or "") for t in texts.slice(at, AT_ONCE).to_pylist()], type_) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], type_)

    return F.arrow_udf(run, returns)


def _read(pages: DataFrame) -> DataFrame:
    """(doc_id, page, nth, units, edges, headers): each page's logical lines. Pages of one number are told apart by `nth`, a hash of their text."""

    def one(text: str) -> dict:
        body, headers = T.without_page_headers(text)
        return {"units": [T.unit_parts(u) for u in T.units(body)], "edges": sorted(T.edge_keys(text)), "headers": headers}

    type_ = to_arrow_type(DataType.fromDDL(f"struct<{PAGE}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(at, AT_ONCE)
                read = pa.array([one(t or "") for t in few.column(3).to_pylist()], type_)
                yield pa.RecordBatch.from_arrays([*few.columns[:3], *read.flatten()], ["doc_id", "page", "nth", *(f.name for f in type_)])

    rows = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.xxhash64("text").alias("nth"), "text")
    return cut(rows.mapInArrow(run, f"doc_id long, page int, nth long, {PAGE}"), "units")


def _lines(read: DataFrame) -> DataFrame:
    """All logical lines with `repeated`: their key stands at the head or foot of half of three or more pages."""
    count = read.groupBy("doc_id").agg(F.count("*").alias("_pages")).where("_pages >= 3")
    seen = read.select("doc_id", F.explode("edges").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("_on"))
    often = seen.join(count, "doc_id").where(F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / 2)))
    lines = read.select("doc_id", "page", "nth", F.posexplode("units").alias("at", "u")).select("doc_id", "page", "nth", "at", "u.*")
    return lines.join(often.select("doc_id", "key", F.lit(True).alias("repeated")), ["doc_id", "key"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def _roles(text: Column, section: Column) -> Column:
    """Roles whose words the text holds, led by that of its section; context if there is none."""
    found = F.filter(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(k)) for k, p in ROLES.items()]), lambda r: r.isNotNull())
    own = reduce(lambda c, kv: c.when(section == kv[0], F.lit(kv[1])), SECTION_ROLES.items(), F.when(F.lit(False), F.lit("")))
    led = F.when(own.isNotNull() & ~F.coalesce(F.array_contains(found, own), F.lit(False)), F.concat(F.array(own), found)).otherwise(found)
    return F.when(F.size(led) > 0, led).otherwise(F.array(F.lit("context")))


def _paragraphs(lines: DataFrame) -> DataFrame:
    order = ["page", "nth", "at"]
    rows = forward_fill(lines.where("not repeated"), ["doc_id"], order, F.col("opens"), "unclassified", "section").where("body <> ''")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("nth", "at"))
    rows = rows.withColumns({"paragraph_id": F.format_string("P%04d-N%04d", "page", nth), "position": F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))})
    body = F.col("body")
    return first_occurrence(rows, ["doc_id"], "body_key", "paragraph_id", ["position"]).select(
        "doc_id", "paragraph_id", "page", "position", F.col("number").alias("paragraph_number"), "section", body.alias("text"),
        _roles(body, F.col("section")).alias("roles"), body.rlike("(?U)" + "|".join(BOILERPLATE)).alias("boilerplate"), "duplicate_of",
        F.length(body).alias("characters"), F.sha2(body, 256).alias("sha256"),
    )


def structured_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages (doc_id, page, text); sections and duplicates run across a document's pages.

    Python sees one page at a time. What runs along a document is a sorted window, which spills, whatever its length.
    A null text is an empty page; pages of one number are taken in the order of a hash of their texts.
    """
    return _paragraphs(_lines(_read(pages)))


def structured_claims(pages: DataFrame) -> DataFrame:
    """Claims of pages (doc_id, page, text), taken in the order of their numbers, then texts; a document bounds what is held together.

    Pages are gathered by Spark, so Python sees one text a document and is not called for each. Rows stay dealt by doc_id.
    """
    gathered = pages.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    whole = gathered.select("doc_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))
    found = _sliced(lambda t: T.enriched(T.claims(t)[0]), f"array<struct<{CLAIM}>>")(F.col("text"))
    return whole.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def structure_statistics(pages: DataFrame) -> DataFrame:
    """One row a document: its pages, blank ones too, its paragraphs by kind, and what was removed."""
    read = _read(pages)
    lines = _lines(read)
    by_page = read.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("headers").alias("removed_page_headers"))
    removed = lines.groupBy("doc_id").agg(F.count_if("repeated").alias("removed_repeated"))
    counts = _paragraphs(lines).groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"), F.count_if(F.col("duplicate_of").isNull()).alias("unique"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate"),
        F.count_if("boilerplate").alias("boilerplate"), F.sum("characters").alias("characters"),
    )
    return by_page.join(removed, "doc_id", "left").join(counts, "doc_id", "left").fillna(0)


def claim_statistics(claims: DataFrame) -> DataFrame:
    return claims.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("type") == "independent").alias("independent"), F.sum(F.size("elements")).alias("elements"))


def with_lead(claims: DataFrame) -> DataFrame:
    """Adds `lead`: whether a claim is independent, or the first claim of a document without such a one."""
    w = Window.partitionBy("doc_id")
    some = F.max((F.col("type") == "independent").cast("int")).over(w)
    first = F.min("number").over(w)
    lead = (F.col("type") == "independent") | ((F.col("_some") == 0) & (F.col("number") == F.col("_first")))
    return claims.withColumns({"_some": some, "_first": first}).withColumn("lead", F.coalesce(lead, F.lit(False))).drop("_some", "_first")


def lead_claims(claims: DataFrame) -> DataFrame:
    """Independent claims; the first claim of a document without one."""
    return with_lead(claims).where("lead").drop("lead")


# The same steps over rows, where the order of lines is a column and keys are ASCII


def ascii_key(text: Column) -> Column:
    """A key for equal texts that needs no NFKC: lower case without white space and marks."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r.,;:()\[\]]+", ""))


def first_occurrence(rows: DataFrame, by: list[str], key: str, id_col: str, order: list[str]) -> DataFrame:
    """Adds duplicate_of, the id of the first row with the same key; null for it and for empty keys."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    first = F.first(id_col).over(w)
    return rows.withColumn("duplicate_of", F.when((F.col(key) != "") & (F.row_number().over(w) > 1), first))


def forward_fill(rows: DataFrame, by: list[str], order: list[str], value: Column, default: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def longest_runs(rows: DataFrame, by: list[str], order: str, number: str, sorted_by: list[str] | None = None) -> DataFrame:
    """(by, run_start, run_length): the longest run 1, 2, 3, ... of each group; the earliest of equals.

    sorted_by are the columns that `order` numbers the rows of a group by, if it was made by a window: a task then sorts once.
    """
    w = Window.partitionBy(*by).orderBy(*(sorted_by or [order]))
    n = F.col(number)
    starts = F.when((n == 1) | F.lag(number).over(w).isNull() | (n != F.lag(number).over(w) + 1), 1).otherwise(0)
    marked = rows.withColumn("_s", starts).withColumn("_island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = marked.groupBy(*by, "_island").agg(F.min(number).alias("_first"), F.min(order).alias("run_start"), F.count("*").alias("run_length")).where("_first = 1")
    best = islands.groupBy(*by).agg(F.max(F.struct("run_length", (-F.col("run_start")).alias("s"))).alias("b"))
    return best.select(*by, (-F.col("b.s")).alias("run_start"), F.col("b.run_length").alias("run_length"))


def repeated_page_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, key, pages) of keys on at least half of a document's pages, for documents of three pages and more; lines are (doc_id, page, key)."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages")).where("_pages >= 3")
    seen = lines.where((F.length("key") > 0) & (F.length("key") <= 80)).groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    return seen.join(pages, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / 2))).select("doc_id", "key", "pages")

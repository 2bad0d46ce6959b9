"""What later stages read: vectors and artifacts of documents, texts of pages, logs, digests and counts of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lifecycle

#: Fixed value: documents with fewer characters are passed over with this reason.
LEAST_CHARACTERS = 500
TOO_SHORT = "image_only_or_insufficient_text"


def encode_vector(vector: Column) -> Column:
    """The numbers as little-endian float32 in a row, null if the vector is null; a null number is NaN."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return F.pandas_udf(run, "binary")(vector)


def decode_vector(blob: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.frombuffer(v, dtype="<f4"))

    return F.pandas_udf(run, "array<float>")(blob)


def vector_scan(vectors: DataFrame, documents: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, position, dimensions, vector) of one kind of vector, of documents that are not skipped, in their order."""
    inside = documents.where(F.col("analysis_state") != "skipped").select(*keys, "position")
    return vectors.join(inside, keys).select(*keys, "position", F.size(kind).alias("dimensions"), F.col(kind).alias("vector")).orderBy("position", *keys)


def analysis_materials(documents: DataFrame, vectors: DataFrame, artifacts: DataFrame, keys: list[str], types: tuple[str, ...] = ("threat_score", "summaries")) -> DataFrame:
    """(keys, position, one payload a type) of documents, not skipped, with a vector and a current artifact (run '') of every type.

    One aggregation turns artifact rows into columns, in the place of a join a type.
    """
    current = artifacts.where((F.col("run_id") == "") & F.col("artifact_type").isin(*types))
    wide = current.groupBy(*keys).agg(*[F.max(F.when(F.col("artifact_type") == t, F.col("payload"))).alias(t) for t in types])
    whole = wide.dropna(subset=list(types))
    inside = documents.where(F.col("analysis_state") != "skipped").select(*keys, "position")
    return inside.join(whole, keys).join(vectors.select(*keys), keys, "left_semi").select(*keys, "position", *types).orderBy("position", *keys)


def point(rows: DataFrame, **key) -> DataFrame:
    """The row of a key, or none; the key reaches the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows.limit(1)


def document_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, text, characters, skip_reason) of pages (doc_id, page, text).

    Pages are cleaned, joined by an empty line in the order of their numbers and cleaned again; null pages are empty. A
    text of fewer than 500 characters has a reason to be passed over. A document bounds each group.
    """
    clean = F.udf(lambda v: T.clean(v or ""), "string", useArrow=True)
    rows = pages.select("doc_id", "page", clean("text").alias("text"))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    texts = whole.select("doc_id", F.size("p").alias("pages"), clean(F.array_join("p.text", "\n\n")).alias("text"))
    size = F.length("text")
    return texts.select("doc_id", "pages", "text", size.alias("characters"), F.when(size < LEAST_CHARACTERS, TOO_SHORT).alias("skip_reason"))


def missing_extractions(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, content or sha256) whose content is not in the cache (sha256): each content once, of equal ones the first path."""
    keyed = files if "sha256" in files.columns else files.withColumn("sha256", F.sha2("content", 256))
    return lifecycle.latest(keyed.join(cache.select("sha256"), "sha256", "left_anti"), ["sha256"], [F.col("path")])


def extraction_index(texts: DataFrame, by: list[str]) -> DataFrame:
    """Documents, pages and characters, and those passed over, by run or research."""
    return texts.groupBy(*by).agg(
        F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("characters").alias("characters"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped")
    )


def appended_audit(log: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new (at, action, idempotency_key, ...) that the log still lacks: of one key the earliest, rows without a key always."""
    keyed = lifecycle.latest(new.where("idempotency_key is not null"), ["idempotency_key"], [F.col("at"), F.xxhash64(*new.columns)])
    fresh = keyed.join(log.where("idempotency_key is not null").select("idempotency_key"), "idempotency_key", "left_anti").select(*new.columns)
    return fresh.unionByName(new.where("idempotency_key is null"))


def ordered_fingerprint(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, documents, fingerprint): SHA-256 over each group's values in order, a line feed after each; nulls are empty.

    Rows come sorted, and a group's digest is carried from batch to batch, so no group is ever held as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, state = None, 0, None
        out: list[tuple] = []
        for batch in batches:
            for k, v in zip(batch["k"], batch["v"]):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, n, state.hexdigest()))
                    key, n, state = k, 0, hashlib.sha256()
                state.update((v or "").encode() + b"\n")
                n += 1
            yield pd.DataFrame(out, columns=["k", "documents", "fingerprint"])
            out = []
        if state is not None:
            yield pd.DataFrame([(key, n, state.hexdigest())], columns=["k", "documents", "fingerprint"])

    keyed = rows.select(F.col(by).cast("string").alias("k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("string").alias("v"))
    dealt = keyed.repartition("k").sortWithinPartitions("k", *[f"_o{i}" for i in range(len(order))])
    return dealt.select("k", "v").mapInPandas(run, "k string, documents long, fingerprint string").withColumnRenamed("k", by)


def source_signature(files: DataFrame, by: str) -> DataFrame:
    """(by, signature): changes when a file of a group (by, path, sha256) comes, goes or changes. A group has a few files."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("path"), F.coalesce("sha256", F.lit("")))))
    return files.groupBy(by).agg(F.sha2(F.to_json(listed), 256).alias("signature"))


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows): the rows of each table."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_counts(documents: DataFrame, artifacts: DataFrame, retry: DataFrame | None = None, key: str = "patent_id") -> DataFrame:
    """`pipeline_counts` with, last, prepared, analyzed and llm_pending.

    Prepared documents have a structure, analyzed ones a score and summaries and are not to be retried; llm_pending are
    the pending ones after the move of retried documents, less those that were pending before it and have a checkpoint.
    """
    flag = lambda t: F.bool_or(F.col("artifact_type") == t)
    held = artifacts.groupBy(key).agg(flag("document_structure").alias("s"), (flag("threat_score") & flag("summaries")).alias("a"), flag("analysis_complete").alias("c"))
    again = F.lit(None).cast("boolean")
    if retry is not None:
        held = held.join(retry.select(key).distinct().withColumn("_again", F.lit(True)), key, "left")
        again = F.col("_again")
    open_ = documents.where("analysis_state = 'pending'").select(key, F.lit(True).alias("_open"))
    stages = held.join(open_, key, "left").agg(
        F.count_if("s").alias("prepared"), F.count_if(F.col("a") & again.isNull()).alias("analyzed"), F.count_if(F.col("c") & F.col("_open")).alias("_done")
    )
    counts = lifecycle.pipeline_counts(documents, retry, key)
    # one row each
    return counts.crossJoin(stages).withColumn("llm_pending", F.greatest(F.lit(0), F.col("pending") - F.col("_done"))).drop("_done")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(same): whether two tables hold the same keys."""
    change = lifecycle.list_diff(a, b, key).where("change <> 'continued'")
    return change.agg((F.count("*") == 0).alias("same"))


def score_problem(payload: Column) -> Column:
    """Why the JSON text of a score can't be kept (null if it can): two whole numbers of 1 to 5, two reasons that are not blank."""
    v = F.try_parse_json(payload)
    out = F.when(v.isNull(), "not_json")
    for field in ("similarity", "concept_level"):
        number = F.try_variant_get(v, f"$.{field}", "variant")
        whole = F.coalesce(F.schema_of_variant(number) == "BIGINT", F.lit(False))
        out = out.when(~whole | ~F.coalesce(F.try_variant_get(v, f"$.{field}", "long").between(1, 5), F.lit(False)), field)
    for field in ("similarity_reason", "concept_level_reason"):
        reason = F.try_variant_get(v, f"$.{field}", "variant")
        text = F.when(F.schema_of_variant(reason) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
        out = out.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), field)
    return out


def split_values(cell: Column) -> Column:
    """Values of a cell, cut at commas, line ends and the ideographic comma, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(cell, r"[,\n、]"), lambda v: F.trim(v)), lambda v: v != "")


def cell_density(cells: DataFrame, count: str = "count") -> DataFrame:
    """cells with `alpha`, the strength of their colour: 0.04 of none, else 0.18 and up to 0.65 more by the greatest count."""
    top = F.max(count).over(Window.partitionBy(F.lit(0)))  # a map's few cells
    return cells.withColumn("alpha", F.when(F.col(count) == 0, F.lit(0.04)).otherwise(0.18 + 0.65 * F.col(count) / top))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in full percent, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(F.lit(0)).cast("long")


def ranked(rows: DataFrame, count: str, name: str) -> DataFrame:
    """rows with `rank`, from 1, by the greatest count and then the name; for rankings of a few groups."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(count).desc(), F.col(name))))

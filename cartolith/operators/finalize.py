"""The last step of a research: clusters of both kinds of vectors, their names, order and nearness to a company, result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import grid, materials, registry, vectors
from .grounding import generate

KINDS = ("technology", "problem")
#: Clusters of an axis at most: their centroids, at most 256 numbers each, are sent to all tasks that look for the nearest.
MOST_CLUSTERS = 50_000
# How a result's reasons are written, names of the map's methods.
REASONS = ("類似度: ", "\n権利範囲の広さ: ")
ORDERING, SCALE = "average-linkage-cosine-leaf-seriation", "research-relative-minmax"
NAME = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}}}


def company_reference(technology: str, problem: str, embed: Callable[[list[str]], list[list[float]]]) -> dict[str, list[float]]:
    """A company's two vectors by kind; blank summaries and vectors of two lengths, or not finite, are errors."""
    texts = [(t or "").strip() for t in (technology, problem)]
    if not all(texts):
        raise ValueError("a company needs a technology and a problem summary")
    got = embed(texts)
    if len(got) != 2 or len(got[0]) != len(got[1]) or not got[0] or not all(abs(float(x)) < float("inf") for v in got for x in v):
        raise ValueError("a company's vectors are two of one length, with finite numbers")
    return dict(zip(KINDS, got))


def clusters_from_blobs(rows: DataFrame, id_col: str, blob_col: str, k: int | None = None) -> DataFrame:
    """(id, cluster) of vectors stored as float32 in a row."""
    return vectors.clusters(rows.select(id_col, materials.decode_vector(F.col(blob_col)).alias("_vector")), id_col, "_vector", k)


def cluster_names(assignments: DataFrame, summaries: DataFrame, id_col: str, kind: str, call: Callable[[str, str], dict]) -> DataFrame:
    """(cluster, members, name, error): a model names each cluster by the summaries (id, summary) of its first 20 members.

    A name that is blank or can't be had is null, with the error beside it.
    """
    keyed = assignments.select("cluster", F.col(id_col).alias("key"))
    told = registry.first_members(keyed).join(summaries.select(F.col(id_col).alias("key"), "summary"), "key", "left")
    few = told.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("patent_id"), "summary"))).alias("summaries"))
    asked = few.join(keyed.groupBy("cluster").agg(F.count("*").alias("members")), "cluster")
    prompt = F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("cluster").alias("cluster_id"), F.col("members").alias("member_count"), "summaries"))
    inputs = asked.select(F.col("cluster").cast("long").alias("doc_id"), F.lit("cluster_name").alias("task"), prompt.alias("prompt"))
    answers = cut(generate(inputs, call, NAME), "names")
    name = F.nullif(F.trim(F.get_json_object("response", "$.name")), F.lit(""))
    named = answers.select(F.col("doc_id").cast("int").alias("cluster"), name.alias("name"), F.coalesce("error", F.when(name.isNull(), "name is blank")).alias("error"))
    return asked.select("cluster", "members").join(named, "cluster")


def nearest_runs(rows: DataFrame, ids: list[str], x: np.ndarray) -> dict[str, tuple[float, str]]:
    """Of each run its nearest other one, as (distance, id): tasks take some of the runs each, against all in one product."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, x.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, all_ = sent.value
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = [place[n] for n in batch["id"][at : at + 256]]
                far = np.round(1 - (all_[own] @ all_.T).astype(np.float64), 6)
                far[np.arange(len(own)), own] = np.inf
                low = far.min(1)
                best = [min(names[j] for j in np.flatnonzero(row == d)) for row, d in zip(far, low)]
                yield pd.DataFrame({"id": [names[i] for i in own], "distance": low, "near": best})

    found = rows.sparkSession.createDataFrame([(i,) for i in ids], "id string").repartition(8).mapInPandas(run, "id string, distance double, near string")
    return {r["id"]: (r["distance"], r["near"]) for r in found.collect()}  # at most MOST_CLUSTERS rows


def merged_order(rows: DataFrame, ids: list[str], x: np.ndarray) -> list[str]:
    """An order of many clusters: runs that are nearest to each other are joined, end to nearest end, until EXACT_MOST are left.

    Those are put in semantic order by their centroids, each turned so that it begins near where the last one ended. Every
    round at least the nearest pair of all joins, and mostly a good share of the runs does.
    """
    unit = {i: v / n if (n := float(np.linalg.norm(v))) else v for i, v in zip(ids, np.asarray(x, dtype=np.float64))}
    runs, centre, size = {i: [i] for i in ids}, dict(unit), dict.fromkeys(ids, 1)

    def apart(a: str, b: str) -> float:
        return round(float(1 - unit[a] @ unit[b]), 9)

    while len(runs) > vectors.EXACT_MOST:
        names = sorted(runs)
        near = nearest_runs(rows, names, np.array([centre[n] for n in names]))
        joined = [(a, b) for a, (_, b) in near.items() if a < b and near[b][1] == a]
        if not joined:  # ties in a circle: the first of the nearest pairs
            distance, a, b = min((d, min(a, b), max(a, b)) for a, (d, b) in near.items())
            joined = [(a, b)]
        for a, b in joined:
            left, right = runs[a], runs.pop(b)
            turns = [(apart(p[-1], q[0]), p, q) for p in (left, left[::-1]) for q in (right, right[::-1])]
            _, p, q = min(turns)
            runs[a] = p + q
            total = centre[a] * size[a] + centre.pop(b) * size[b]
            centre[a], size[a] = (total / n if (n := float(np.linalg.norm(total))) else total), size[a] + size.pop(b)
    names = sorted(runs)
    out: list[str] = []
    for name in vectors.semantic_order(names, np.array([centre[n] for n in names])):
        run = runs[name]
        out += run[::-1] if out and apart(out[-1], run[-1]) < apart(out[-1], run[0]) else run
    return out


def placed(rows: DataFrame, few: list, reference: list[float] | None) -> DataFrame:
    """(cluster, position, proximity, cosine_similarity) of (cluster, centroid) rows, see `axis`."""
    ids = [str(r["cluster"]) for r in few]
    near: dict = {}
    if not ids:
        order = []
    elif len(ids) > vectors.EXACT_MOST:
        order = merged_order(rows, ids, np.array([r["centroid"] for r in few]))
    else:
        order = vectors.semantic_order(ids, [r["centroid"] for r in few])
    if reference is not None and ids:
        ref = F.array(*[F.lit(float(x)) for x in reference])
        made = rows.sparkSession.createDataFrame([(i, [float(v) for v in r["centroid"]]) for i, r in zip(ids, few)], "cluster string, centroid array<double>")
        scored = grid.relative_proximity(made.select("cluster", (1 - vectors.cosine_distance(F.col("centroid"), ref)).alias("s")), "s")
        near = {r["cluster"]: (r["relative_proximity"], r["s"]) for r in scored.collect()}
        order = vectors.oriented(order, {i: s for i, (_, s) in near.items()})
    made = [(int(i), p, *near.get(i, (None, None))) for p, i in enumerate(order)]
    return rows.sparkSession.createDataFrame(made, "cluster int, position int, proximity double, cosine_similarity double")


def few_centroids(rows: DataFrame, vector_col: str) -> list:
    """(cluster, centroid) rows on the driver: means of unit vectors, from partial sums; more than MOST_CLUSTERS are an error."""
    few = vectors.centroid_vectors(rows, "cluster", vector_col).orderBy("cluster").limit(MOST_CLUSTERS + 1).collect()
    if len(few) > MOST_CLUSTERS:
        raise ValueError(f"an axis has at most {MOST_CLUSTERS} clusters")
    return few


def axis(rows: DataFrame, assignments: DataFrame, id_col: str, vector_col: str, reference: list[float] | None = None) -> DataFrame:
    """(cluster, position, proximity, cosine_similarity): clusters in semantic order; with a reference vector the nearness to it,
    as it is and relative to all clusters, and the nearer end first. Above EXACT_MOST clusters the order comes from merged runs."""
    held = rows.where(F.size(vector_col) > 0).join(assignments, id_col)
    return placed(rows, few_centroids(held, vector_col), reference)


@dataclass(frozen=True)
class Finalized:
    """results, one row a document; clusters (kind, cluster, members, name, position, ...); map, one row for the research."""

    results: DataFrame
    clusters: DataFrame
    map: DataFrame


def _assigned(folded: DataFrame, id_col: str, k: int | None) -> DataFrame:
    """(id, cluster) of folded vectors: exact linkage up to EXACT_MOST of them, k-means on all executors above."""
    n = folded.count()
    if n <= vectors.EXACT_MOST:
        return vectors.clusters(folded, id_col, "vector", k)
    return vectors.clusters_distributed(folded, id_col, "vector", vectors.cluster_count(n, k))


def finalized(
    embeddings: DataFrame, artifacts: DataFrame, summaries_call: Callable[[str, str], dict], run_id: str, id_col: str = "doc_id",
    k: int | None = None, reference: dict[str, list[float]] | None = None,
) -> Finalized:
    """Clusters, names, axes and result rows of a research, from its stored vectors and artifacts.

    embeddings (id, technology, problem) and artifacts (id, threat_score, summaries as JSON, as `analysis.assembled` gives
    them) count for the ids that both have. Vectors of a kind are folded to at most 256 numbers once; assignments, centroids,
    order and nearness all come from the folded ones, and the reference is folded likewise. A cluster without a name is a
    ValueError, as a map without names is none; so are vectors of different lengths. Ids are integers. Without a document all
    three tables are empty but for the map's one row.
    """
    spark = embeddings.sparkSession
    held = embeddings.where(F.col("technology").isNotNull() & F.col("problem").isNotNull()).join(artifacts.select(id_col), id_col, "left_semi")
    sizes = held.agg(*[f(F.size(kind)).alias(f"{n}_{kind}") for kind in KINDS for n, f in (("low", F.min), ("high", F.max))]).first()
    if any(sizes[f"low_{kind}"] != sizes[f"high_{kind}"] for kind in KINDS):
        raise ValueError("vectors of one kind have one length")
    dims = {kind: sizes[f"low_{kind}"] or 1 for kind in KINDS}
    folded = cut(held.select(id_col, *[vectors.fixed_projection(F.col(kind), dims[kind]).alias(kind) for kind in KINDS]), "folded")
    told = artifacts.join(folded.select(id_col), id_col, "left_semi")
    short = dict(zip(KINDS, ("tech", "problem"), strict=True))
    assigned, parts = {}, []
    for kind in KINDS:
        own = folded.select(id_col, F.col(kind).alias("vector"))
        found = assigned[kind] = cut(_assigned(own, id_col, k), "assigned")
        texts = told.select(id_col, F.get_json_object("summaries", f"$.{short[kind]}_summary").alias("summary"))
        names = cut(cluster_names(found, texts, id_col, kind, summaries_call), "names")
        if bad := names.where("name IS NULL").select("cluster", "error").limit(3).collect():
            raise ValueError(f"{kind} clusters without a name: " + "; ".join(f"{r['cluster']}: {r['error']}" for r in bad))
        near = None
        if reference is not None:
            ref = spark.createDataFrame([([float(x) for x in reference[kind]],)], "v array<double>")
            near = ref.select(vectors.fixed_projection(F.col("v"), len(reference[kind])).alias("v")).first()["v"]
        order = placed(own, few_centroids(own.join(found, id_col), "vector"), near)
        parts.append(names.drop("error").join(order, "cluster").select(F.lit(kind).alias("kind"), "cluster", "members", "name", "position", "proximity", "cosine_similarity"))
    clusters = cut(parts[0].unionByName(parts[1]), "clusters")
    named = {kind: clusters.where(F.col("kind") == kind) for kind in KINDS}
    get = lambda c, field: F.get_json_object(c, f"$.{field}")
    rows = told.select(
        id_col,
        get("threat_score", "similarity").cast("int").alias("similarity"),
        get("threat_score", "concept_level").cast("int").alias("concept_level"),
        get("summaries", "tech_summary").alias("tech_summary"),
        get("summaries", "problem_summary").alias("problem_summary"),
        F.concat(F.lit(REASONS[0]), get("threat_score", "similarity_reason"), F.lit(REASONS[1]), get("threat_score", "concept_level_reason")).alias("reasoning"),
        F.coalesce(get("threat_score", "claim_traceability"), F.lit("{}")).alias("claim_traceability"),
        F.coalesce(get("threat_score", "evidence_traceability"), F.lit("{}")).alias("evidence_traceability"),
    )
    return Finalized(result_rows(rows, assigned, named, id_col), clusters, technology_map(clusters, run_id))


def technology_map(clusters: DataFrame, run_id: str) -> DataFrame:
    """(run_id, algorithm, proximity_scale, technology_order, problem_order, technology_clusters, problem_clusters): one row of a few clusters."""

    def of(kind: str) -> tuple[Column, Column]:
        mine = F.when(F.col("kind") == kind, F.struct("position", F.col("cluster").cast("string").alias("id"), F.struct("name", "cosine_similarity", F.col("proximity").alias("relative_strength")).alias("about")))
        ordered = F.array_sort(F.collect_list(mine))
        return F.transform(ordered, lambda x: x.id).alias(f"{kind}_order"), F.map_from_arrays(F.transform(ordered, lambda x: x.id), F.transform(ordered, lambda x: x.about)).alias(f"{kind}_clusters")

    orders, maps = zip(*[of(kind) for kind in KINDS], strict=True)
    return clusters.agg(*orders, *maps).select(F.lit(run_id).alias("run_id"), F.lit(ORDERING).alias("algorithm"), F.lit(SCALE).alias("proximity_scale"), "*")


def map_axis(cells: DataFrame, kind: str, stored: DataFrame, least: int = 1) -> DataFrame:
    """(id, position, name, count, proximity) of one axis of a map: cells (tech, tech_name, problem, problem_name, count), stored as in `clusters`.

    Clusters with `least` documents are shown: first those of the stored order, then the others by id. The stored name comes
    first, then the cells' own, then the id. An axis is a few clusters.
    """
    column = dict(zip(KINDS, ("tech", "problem"), strict=True))[kind]
    seen = cells.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("id")).agg(F.sum("count").alias("count"), F.max(f"{column}_name").alias("_own")).where(F.col("count") >= least)
    known = stored.where(F.col("kind") == kind).select(F.col("cluster").cast("string").alias("id"), F.col("position").alias("_at"), F.col("name").alias("_name"), "proximity")
    both = seen.join(known, "id", "left")
    place = F.row_number().over(Window.orderBy(F.col("_at").asc_nulls_last(), "id")) - 1
    name = F.coalesce(F.nullif("_name", F.lit("")), F.nullif("_own", F.lit("")), F.col("id"))
    return both.select("id", place.cast("int").alias("position"), name.alias("name"), "count", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("proximity", F.lit(0.0)))).alias("proximity"))


def result_rows(found: DataFrame, assignments: dict[str, DataFrame], names: dict[str, DataFrame], id_col: str) -> DataFrame:
    """found (id, ...) with the id and name of its cluster of each kind; a document without one has null there."""
    out = found
    for kind, short in zip(KINDS, ("tech", "problem")):
        named = names[kind].select("cluster", F.col("name").alias(f"{short}_cluster"))
        of = assignments[kind].join(named, "cluster", "left").withColumnRenamed("cluster", f"{short}_cluster_id")
        out = out.join(of, id_col, "left")
    return out


def checked_kinds(technology: DataFrame, problem: DataFrame, id_col: str) -> None:
    """An error unless both kinds of vectors are of the same documents."""
    if not materials.same_keys(technology, problem, id_col).first()["same"]:
        raise ValueError("technology and problem vectors are not of the same documents")

"""Vector operators; arithmetic is in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_MOST = 500
LEAST_DIMENSIONS = 128


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1.0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: what a lambda only refers to is computed anew for each of its elements."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    scaled = lambda a, n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    return bound(v, lambda a: bound(norm(a), lambda n: scaled(a, n)))


def cosine_to_reference(vectors: DataFrame, id_col: str, vector_col: str, reference: list[float]) -> DataFrame:
    """One literal vector against all: a projection without a join."""
    ref = F.array(*[F.lit(float(x)) for x in reference])
    return vectors.select(id_col, cosine_distance(F.col(vector_col), ref).alias("distance"))


def cosine_pairs(few: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """All pairs a < b of a few vectors, such as centroids; at most EXACT_MOST, which is checked."""
    if few.limit(EXACT_MOST + 1).count() > EXACT_MOST:
        raise ValueError(f"pairs are for at most {EXACT_MOST} vectors")
    a = few.select(F.col(id_col).alias("a"), F.col(vector_col).alias("_va"))
    b = few.select(F.col(id_col).alias("b"), F.col(vector_col).alias("_vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", cosine_distance(F.col("_va"), F.col("_vb")).alias("distance"))


def centroids(vectors: DataFrame, label: str, vector_col: str) -> DataFrame:
    """(label, dim, value): mean of unit vectors by label, normalised again. Partial sums per dimension, so no group is gathered."""
    parts = vectors.select(label, F.posexplode(unit(F.col(vector_col))).alias("dim", "x"))
    mean = parts.groupBy(label, "dim").agg(F.avg("x").alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(label)))
    return mean.select(label, "dim", F.when(length == 0, F.col("m")).otherwise(F.col("m") / length).alias("value"))


def centroid_vectors(vectors: DataFrame, label: str, vector_col: str) -> DataFrame:
    """(label, centroid): the centroids as one row and array a label."""
    parts = centroids(vectors, label, vector_col).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
    return parts.select(label, F.col("_p.value").alias("centroid"))


def fixed_projection(v: Column, dims: int, target: int = 256) -> Column:
    """Folds a vector of `dims` numbers to `target`: slices of equal width with alternating signs, summed, then normalised."""
    t = min(target, dims)
    width = -(-dims // t)
    padded = F.concat(doubles(v), F.array_repeat(F.lit(0.0), t * width - dims)) if t * width > dims else doubles(v)
    signed = F.transform(padded, lambda x, k: F.when(k % width % 2 == 0, x).otherwise(-x))
    fold = lambda a: F.transform(F.sequence(F.lit(0), F.lit(t - 1)), lambda i: F.aggregate(F.slice(a, i * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x))
    return unit(bound(signed, fold))


def invalid_vectors(vectors: DataFrame, vector_col: str, dims: int, least: int = LEAST_DIMENSIONS) -> DataFrame:
    """Rows whose vector is missing, shorter than `least`, of another dimension, or not all finite."""
    v = F.col(vector_col)
    bad = v.isNull() | (F.size(v) < least) | (F.size(v) != dims) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.coalesce(bad, F.lit(True)))


def cluster_count(n: int, k: int | None = None) -> int:
    return min(n, k or max(1, round(math.sqrt(n))))


def agglomerate(keys: list[str], x: np.ndarray, k: int | None = None) -> dict[str, int]:
    """Average-linkage clusters by cosine distance; ties go to the merge whose members sort first. Ids by sorted members."""
    x = np.asarray(x, dtype=np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    apart = 1 - u @ u.T
    apart[(length[:, 0] == 0), :] = 1.0
    apart[:, (length[:, 0] == 0)] = 1.0
    groups: dict[int, list[int]] = {i: [i] for i in range(len(keys))}
    sums = apart.copy()  # sums of distances between groups, which add up when groups merge
    size = np.ones(len(keys))
    open_ = np.triu(np.ones_like(apart, dtype=bool), 1)
    for _ in range(len(keys) - cluster_count(len(keys), k)):
        mean = np.where(open_, sums / np.outer(size, size), np.inf)
        ties = np.argwhere(mean <= mean.min() + 5e-13)
        i, j = min(((sorted(keys[m] for m in groups[a] + groups[b]), a, b) for a, b in ties.tolist()))[1:]
        groups[i] += groups.pop(j)
        sums[i, :] += sums[j, :]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        open_[j, :] = open_[:, j] = False
    order = sorted(groups.values(), key=lambda m: sorted(keys[v] for v in m))
    return {keys[v]: c for c, members in enumerate(order) for v in members}


def mini_batch(keys: list[str], x: np.ndarray, k: int | None = None, epochs: int = 8) -> dict[str, int]:
    """Spherical mini-batch k-means with a fixed seed: batches in the order of the keys, centres as running means, all normalised after a batch."""
    n = len(keys)
    k = cluster_count(n, k)
    x = np.asarray(x, dtype=np.float32)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))
    centres = x[np.sort(np.random.default_rng(0).choice(n, k, replace=False))]
    held = np.zeros((k, 1), dtype=np.int64)
    batch = min(1024, max(128, n // k))
    for at in list(range(0, n, batch)) * epochs:
        rows = x[at : at + batch]
        member = (rows @ centres.T).argmax(1)[None, :] == np.arange(k)[:, None]
        new = member.sum(1, keepdims=True)
        mean = (centres * held + member.astype(np.float32) @ rows) / np.maximum(held + new, 1)
        centres = np.where(new > 0, mean, centres).astype(np.float32)
        held += new
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), np.float32(1e-12))
    return dict(zip(keys, (x @ centres.T).argmax(1).tolist()))


def clusters(vectors: DataFrame, id_col: str, vector_col: str, k: int | None = None) -> DataFrame:
    """(id, cluster): exact linkage up to EXACT_MOST vectors, mini-batches above; one task owns the order-dependent loop.

    Vectors are folded to at most 256 numbers before they meet there, which bounds the matrix to n * 1 KB. For more than
    a few million vectors use `clusters_distributed`.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_id")
        keys = [str(v) for v in pdf["_id"]]
        x = np.stack(pdf["_v"].to_numpy())
        found = (agglomerate if len(keys) <= EXACT_MOST else mini_batch)(keys, x, k)
        return pd.DataFrame({"_id": pdf["_id"], "cluster": [found[v] for v in keys]})

    first = vectors.select(F.size(vector_col).alias("n")).where("n > 0").first()
    dims = first["n"] if first else 1
    small = vectors.where(F.size(vector_col) == dims).select(F.col(id_col).cast("long").alias("_id"), fixed_projection(F.col(vector_col), dims).alias("_v"))
    return small.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "_id long, cluster int").withColumnRenamed("_id", id_col)


def label_clusters(vectors: DataFrame, id_col: str, label: str, vector_col: str, k: int | None = None) -> DataFrame:
    """(id, cluster) of every vector: exact linkage over the centroids of all labels; a vector takes its label's cluster.

    Labels are integers; at most EXACT_MOST of them, which is checked.
    """
    rows = vectors.where(F.size(vector_col) > 0)
    few = centroid_vectors(rows, label, vector_col)
    if few.limit(EXACT_MOST + 1).count() > EXACT_MOST:
        raise ValueError(f"exact linkage is for at most {EXACT_MOST} labels")
    found = clusters(few, label, "centroid", k).withColumnRenamed(label, "_label")
    return rows.join(F.broadcast(found), F.col(label).eqNullSafe(F.col("_label"))).select(id_col, "cluster")


def clusters_distributed(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """k-means by cosine on all executors: for any number of vectors, with other assignments than the loop above."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(id_col, array_to_vector(doubles(F.col(vector_col))).alias("features"))
    return KMeans(k=k, seed=0, distanceMeasure="cosine").fit(rows).transform(rows).select(id_col, F.col("prediction").alias("cluster"))


def semantic_order(ids: list[str], x: np.ndarray) -> list[str]:
    """Order of a few centroids: an average-linkage tree, whose branches are turned so that neighbours at each joint are near."""
    x = np.asarray(x, dtype=np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    apart = 1 - u @ u.T
    runs = {i: [i] for i in range(len(ids))}
    while len(runs) > 1:
        pairs = []
        names = sorted(runs)
        for p, i in enumerate(names):
            for j in names[p + 1 :]:
                mean = apart[np.ix_(runs[i], runs[j])].mean()
                pairs.append((round(float(mean), 12), sorted(ids[v] for v in runs[i] + runs[j]), i, j))
        _, _, i, j = min(pairs)
        a, b = runs[i], runs.pop(j)
        turns = []
        for left in (a, a[::-1]):
            for right in (b, b[::-1]):
                for joined in (left + right, right + left):
                    cost = sum(apart[p, q] for p, q in zip(joined, joined[1:]))
                    turns.append((round(float(cost), 12), [ids[v] for v in joined], joined))
        runs[i] = min(turns)[2]
    return [ids[v] for v in next(iter(runs.values()), [])]


def oriented(order: list[str], proximity: dict[str, float]) -> list[str]:
    """The order, turned round if its last cluster is nearer to the reference than its first."""
    return order[::-1] if len(order) > 1 and proximity.get(order[-1], 0) > proximity.get(order[0], 0) else order

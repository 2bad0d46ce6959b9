"""Approximate nearest neighbours by a permutation index with pivot inverted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, uniform

#: Pivots (a sample of the vectors, by a hash of their ids), and how many nearest ones order a vector.
PIVOTS, NEAREST = 256, 96
#: Share of a block, and least number of its vectors, that the footrule passes on to exact distances.
RERANK_SHARE, RERANK_LEAST = 0.10, 128
#: Queries sent out at a time (the bound of what is broadcast), and vectors in a block of the index.
QUERY_ROWS, BLOCK_ROWS = 4096, 8192


def usable(vector: Column) -> Column:
    """True where the vector is not null or zero and all its components are finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & whole & some, F.lit(False))


def permutation(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each row's nearest pivots in order (ties: the pivot of lower number)."""
    d = (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :nearest].astype(np.int32)


def inverted(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivot inverted files of a block: starts by pivot, and posted rows with the pivot's position in them."""
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(pivots + 1))
    return starts, order // perm.shape[1], (order % perm.shape[1]).astype(np.int32)


def footrule(starts: np.ndarray, posted: np.ndarray, at: np.ndarray, rows: int, query: np.ndarray, nearest: int) -> np.ndarray:
    """Spearman footrule between the query's and each row's ordering; a pivot missing in one stands at `nearest`.

    Summed over the query's posting lists: every list entry replaces the cost of a missing pivot in both.
    """
    # without common pivots each side pays for all its own
    most = 2 * int((nearest - np.arange(nearest)).sum())
    gain = np.zeros(rows, dtype=np.int64)
    for pos, p in enumerate(query.tolist()):
        a, b = starts[p], starts[p + 1]
        # a row lists a pivot once, so plain indexing adds right
        gain[posted[a:b]] += (nearest - pos) + (nearest - at[a:b]) - np.abs(at[a:b] - pos)
    return most - gain


def build_index(rows: DataFrame, points: np.ndarray, nearest: int) -> DataFrame:
    """(n, ids, vectors, starts, posted, at), a row for each block of at most BLOCK_ROWS of `rows` (id, v double or float).

    A block holds its rows in the order of their ids and its own pivot inverted files, so no pivot's list is in
    one place, every row is indexed, and a lost block is built again from its rows.
    """
    dims = points.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(k, BLOCK_ROWS)
                ids = piece.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)[order]
                files = inverted(permutation(x, points, nearest), len(points))
                columns = [ids[order].astype("<i8"), x.astype("<f8"), *(f.astype("<i4") for f in files)]
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["n", "ids", "vectors", "starts", "posted", "at"])

    return rows.select("id", "v").mapInArrow(run, "n int, ids binary, vectors binary, starts binary, posted binary, at binary")


def search_index(index: DataFrame, points: np.ndarray, queries: tuple[np.ndarray, np.ndarray], k: int, nearest: int, share: float) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of each block for each query (ids, vectors), which are sent to the blocks."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, xq = sent.value
        perm_q = permutation(xq, points, nearest)
        for batch in parts:
            for block in batch.to_pylist():
                ids, x = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["vectors"], "<f8").reshape(block["n"], -1)
                files = [np.frombuffer(block[c], "<i4") for c in ("starts", "posted", "at")]
                take = min(len(ids), max(RERANK_LEAST, int(np.ceil(share * len(ids)))))
                out: list[list[np.ndarray]] = [[], [], []]
                for q in range(len(ids_q)):
                    far = footrule(*files, len(ids), perm_q[q], nearest)
                    # all rows up to the `take`-th footrule, with those that equal it
                    close = np.flatnonzero((far <= np.partition(far, take - 1)[take - 1]) & (ids != ids_q[q]))
                    d = np.sqrt(((x[close] - xq[q]) ** 2).sum(1))
                    best = np.lexsort((ids[close], d))[:k]
                    out[0].append(np.full(len(best), ids_q[q]))
                    out[1].append(ids[close][best])
                    out[2].append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_rows(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, nearest: int = NEAREST, share: float = RERANK_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k nearest found rows other than itself, by Euclidean distance.

    `queries` are rows of df. Distances are taken on the original vectors in double precision; ties go to the
    smaller id. Null ids take no part, nor do null and zero vectors and such with null or non-finite components. Vectors
    of different dimensions have no distance, so a query is answered from those of its own. Queries of one id are one
    query, that of the smallest vector; repeated rows are candidates each by itself, but no row with the query's id is.
    An empty table gives an empty result; other columns, whatever their names, are ignored.

    The index is written once for each dimension and holds every row. Pivots are a sample of at most `pivots` rows. The
    driver holds one batch of at most QUERY_ROWS queries at a time, and a batch's answers are written before the next.
    """
    spark = df.sparkSession
    kept = Scratch(spark, "neighbours")
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = kept.cut(asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("u", uniform(F.col("id"), "batch")), "queries")
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dims, n in sorted((r["d"], r["n"]) for r in asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        some = base.where(F.size("v") == dims)
        chosen = some.orderBy(uniform(F.col("id"), "pivot"), "id", "v").limit(pivots).collect()
        points = np.array([r["v"] for r in chosen], dtype=np.float64)
        few = min(nearest, len(points))
        index = kept.cut(build_index(some, points, few), "index")
        # batches by a hash of the id are even; 3 / 4 leaves room for what they are not
        batches = max(1, -(-n // (QUERY_ROWS * 3 // 4)))
        for b in range(batches):
            part = asked.where((F.size("v") == dims) & (F.col("u") >= b / batches) & (F.col("u") < (b + 1) / batches)).select("id", "v").collect()
            if not part:
                continue
            batch = (np.array([r["id"] for r in part], dtype=np.int64), np.array([r["v"] for r in part], dtype=np.float64))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
            best = search_index(index, points, batch, k, few, share).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
            found = found.unionByName(cut(best, "neighbours"))
    kept.clear()
    return found

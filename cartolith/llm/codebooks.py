"""Product codes for vectors, learned by a Lloyd iteration that keeps its sums by differences.

Vectors lie in blocks of whole numbers. A round assigns every part of every vector to an entry of the codebook of its
position and writes the block with its new assignments and with what changed: minus the part at its old entry, plus
the part at its new one, already added up in the block. Only these differences are shuffled, and added to the sums
and counts of the rounds before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and a step's distances (vectors x entries) that are held at once.
BLOCK_ROWS, STEP = 4096, 512
#: Sums of errors by label are broadcast up to so many labels.
FEW_LABELS = 50_000
DELTA = "array<struct<part:int,entry:int,n:long,sums:array<long>>>"


def whole_numbers(rows: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """rows with _v, the floors of scale * component; without vectors that are null or hold a null, NaN or infinite component."""
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(vec_col).isNotNull() & finite).withColumn("_v", F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of `part` from each entry, in the type of both."""
    return (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)[None, :]


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, summed squared distance) of each vector; books is parts x entries x width. Ties go to the lower entry."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(vectors), parts), np.uint8 if books.shape[1] <= 256 else np.int32), np.zeros(len(vectors), np.int64)
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(books).max(initial=0)))
    exact = np.float64 if 4 * most * most * width < 1 << 53 else np.int64  # both are exact; doubles are faster
    for at in range(0, len(vectors), STEP):
        step = vectors[at : at + STEP].astype(exact)
        for p in range(parts):
            far = _distances(step[:, p * width : (p + 1) * width], books[p].astype(exact))
            best = far.argmin(1)
            codes[at : at + STEP, p] = best
            errors[at : at + STEP] += far[np.arange(len(best)), best].astype(np.int64)
    return codes, errors


def changes(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[dict]:
    """Sums and counts to add for each (part, entry) that a changed part has left or joined."""
    out, width = [], vectors.shape[1] // new.shape[1]
    for p in range(new.shape[1]):
        moved = np.arange(len(vectors)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        own = vectors[moved, p * width : (p + 1) * width]
        sums, n = np.zeros((entries, width), np.int64), np.zeros(entries, np.int64)
        np.add.at(sums, new[moved, p], own)
        np.add.at(n, new[moved, p], 1)
        touched = set(new[moved, p].tolist())
        if old is not None:
            np.subtract.at(sums, old[moved, p], own)
            np.subtract.at(n, old[moved, p], 1)
            touched |= set(old[moved, p].tolist())
        out += [{"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()} for e in sorted(touched)]
    return out


def _blocks(kept: DataFrame, id_type: str, dim: int) -> DataFrame:
    """Blocks (ids, labels, vectors) of rows (_id, _label, _v): ids and labels as lists, vectors as one packed matrix of int64."""
    label_type = kept.schema["_label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                packed = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed])], ["ids", "labels", "vectors"])

    return kept.select("_id", "_label", "_v").mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, vectors binary")


def _round(blocks: DataFrame, books: np.ndarray, dim: int, first: bool) -> DataFrame:
    """The blocks with new assignments and their differences from the ones they carry (from none in the first round)."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in ("ids", "labels", "vectors"))
    delta = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i8").reshape(-1, dim)
                new, _ = assigned(vectors, books)
                old = None if first else np.frombuffer(batch.column("codes")[i].as_buffer(), new.dtype).reshape(new.shape)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("labels"), one.column("vectors"), pa.array([new.tobytes()]), pa.array([changes(vectors, old, new, books.shape[1])], delta)], ["ids", "labels", "vectors", "codes", "delta"])

    return blocks.mapInArrow(run, f"{schema}, codes binary, delta {DELTA}")


def learned(blocks: DataFrame, books: np.ndarray, dim: int, rounds: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame]:
    """(final codebooks, the blocks with the last round's assignments); entries without a part stay as they are."""
    parts, entries, width = books.shape
    sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), object)
    for k in range(rounds):
        blocks = scratch.cut(_round(blocks, books, dim, k == 0), f"round{k}")
        own = blocks.select(F.explode("delta").alias("d")).select("d.*")
        added = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        for r in added.collect():  # at most parts x entries rows
            counts[r["part"], r["entry"]] += r["n"]
            for j in range(width):
                sums[r["part"], r["entry"], j] += r[f"s{j}"]
        books = np.array([[[s // n for s in own] if n else old.tolist() for own, n, old in zip(*row, strict=True)] for row in zip(sums, counts, books, strict=True)], np.int64).reshape(parts, entries, width)
    return books, blocks


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every vector that takes part, the final codebooks as parts x entries x width).

    Vectors that are null or hold a null, NaN or infinite component take no part. Codebooks begin as the parts of the
    `entries` smallest ids (null ids last, repeated ids by their components); with fewer vectors a codebook is smaller.
    code has two hex digits for each part (so at most 256 entries). Repeated rows each count. All vectors must be of one
    length that `parts` divides, and small enough for their errors to fit 63 bits, else a ValueError says so. An empty
    table gives an empty result and no codebooks. Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is written as two hex digits")
    spark = rows.sparkSession
    own = whole_numbers(rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_e")), "_e", scale).drop("_e")
    id_type, label_type = (own.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    size = own.agg(F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high"), F.max(F.array_max("_v")).alias("top"), F.min(F.array_min("_v")).alias("bottom")).first()
    if size["low"] is None:
        empty = spark.createDataFrame([], f"id {id_type}, label {label_type}, code string, error long")
        return empty.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), np.zeros((parts, 0, 0), np.int64)
    dim = size["low"]
    if size["high"] != dim or dim % parts or not dim:
        raise ValueError(f"vectors have {dim} to {size['high']} components; all must have one number of them that {parts} divides")
    if 4 * max(abs(size["top"]), abs(size["bottom"])) ** 2 * dim >= 1 << 63:
        raise ValueError("components are too large for errors of 63 bits")
    scratch = Scratch(spark, "codes")
    least = own.orderBy(F.col("_id").asc_nulls_last(), F.col("_v")).limit(entries).select("_v").collect()
    books = np.array([r["_v"] for r in least], np.int64).reshape(len(least), parts, dim // parts).transpose(1, 0, 2)
    blocks = scratch.cut(_blocks(own, id_type, dim), "blocks")
    books, blocks = learned(blocks, books, dim, rounds, scratch)
    sent = spark.sparkContext.broadcast(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, errors = assigned(np.frombuffer(batch.column(2)[i].as_buffer(), "<i8").reshape(-1, dim), sent.value)
                names = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(names, pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    out = blocks.select("ids", "labels", "vectors").mapInArrow(finish, f"id {id_type}, label {label_type}, code string, error long")
    out = cut(out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), "coded")
    scratch.clear()
    return out, books


def with_label_error(rows: DataFrame, label_col: str = "label", error_col: str = "error", name: str = "label_error") -> DataFrame:
    """rows with the sum of errors over equal labels, null labels together.

    Sums come from partial aggregates. A few labels are broadcast; more are joined, where a hot label's rows can be
    split, as its sum is one row.
    """
    sums = cut(rows.groupBy(F.col(label_col).alias("_l")).agg(F.sum(error_col).cast("long").alias("_sum")), "label_sums")
    small = F.broadcast(sums) if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS else sums
    return rows.join(small, F.col(label_col).eqNullSafe(F.col("_l"))).withColumn(name, F.col("_sum")).drop("_l", "_sum")

"""Importance resampling towards a target text by an external sort-count of hashed features.

The texts are read once. Each becomes a packed stream of uint16 buckets, and streams of many documents are written
as blocks with the documents' offsets. Counts come from sorting each block and encoding its runs by length; runs of
equal buckets are added up across blocks. Weights are gathered from the blocks: the gains at a block's buckets,
summed between offsets by np.add.reduceat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, shuffle_partitions

BUCKETS = 10_000
#: A block is closed at so many features or documents.
BLOCK_FEATURES, BLOCK_DOCS = 1 << 21, 4096
#: A text is split into words this many bytes at a time; the bound of what a task remembers of words.
SLICE, REMEMBERED = 1 << 20, 200_000
#: A-Z become a-z; digits, a-z and every byte of a non-ASCII character stay; all else ends a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = "starts array<long>, words array<long>, stream binary"


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about SLICE bytes; never cut inside a word."""
    at = 0
    while at < len(text):
        part = text[at : at + SLICE].translate(FOLD)
        end = at + len(part)
        if end < len(text) and not part.endswith(b" "):
            cut_at = part.rfind(b" ") + 1
            if not cut_at:  # one word fills the slice: take all of it
                while end < len(text) and FOLD[text[end]] != 32:
                    end += 1
                part = text[at:end].translate(FOLD)
            else:
                end, part = at + cut_at, part[:cut_at]
        at = end
        if words := part.split():
            yield words


class Hashed(dict):
    """A feature's bucket by its bytes; forgets all of it when it holds too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[feature] = zlib.crc32(feature) % self.buckets
        return got


def _stream(text: bytes | None, hashed: Hashed, longest: int) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to `longest` words) of one text."""
    words, parts, tail = 0, [np.empty(0, np.uint16)], []
    for own in word_slices(text or b""):
        words += len(own)
        parts.append(np.fromiter(map(hashed.__getitem__, own), np.uint16, len(own)))
        if longest > 1:
            joined = tail + own
            for n in range(2, longest + 1):  # runs that end in this slice
                first = max(0, len(tail) - n + 1)
                runs = [b" ".join(joined[i : i + n]) for i in range(first, len(joined) - n + 1)]
                parts.append(np.fromiter(map(hashed.__getitem__, runs), np.uint16, len(runs)))
            tail = joined[1 - longest :]
    return words, np.concatenate(parts)


def packed_streams(docs: DataFrame, id_col: str, text_col: str, buckets: int, longest: int) -> DataFrame:
    """Blocks (ids, starts, words, stream): documents' ids, where each begins in the stream, its words, and the packed buckets.

    A document's features end where the next one's begin, the last one's at the stream's end.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is packed into 16 bits")
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(buckets)
        ids, starts, words, parts, size = [], [], [], [], 0
        kind = pa.int64()

        def block() -> pa.RecordBatch:
            stream = np.concatenate(parts).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([stream], pa.binary())], ["ids", "starts", "words", "stream"])

        for batch in batches:
            kind = batch.schema[0].type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, got = _stream(text.as_py(), hashed, longest)
                ids.append(doc_id)
                starts.append(size)
                words.append(n)
                parts.append(got)
                size += len(got)
                if size >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, starts, words, parts, size = [], [], [], [], 0
        if ids:
            yield block()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"ids array<{id_type}>, {BLOCK}")


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all blocks' streams; at most `buckets` rows reach the driver."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
                lengths = np.diff(np.r_[at, len(ordered)])
                yield pa.RecordBatch.from_arrays([pa.array(ordered[at].astype(np.int32)), pa.array(lengths.astype(np.int64))], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    size, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    each = ((float(t) + 1) * (all_raw + size) / ((float(s) + 1) * (all_target + size)) for s, t in zip(raw, target, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in each], np.int64)


def gathered(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_features, n_words, weight) of every document of the blocks."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, starts, words = (batch.column(k)[i].values for k in range(3))
                stream = np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")
                at = starts.to_numpy(zero_copy_only=False)
                n = np.diff(np.r_[at, len(stream)])
                weight = np.zeros(len(at), np.int64)
                full = n > 0  # reduceat gives an empty stretch the value that follows it
                if full.any():
                    weight[full] = np.add.reduceat(gain[stream], at[full])
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), words, pa.array(weight)], ["id", "n_features", "n_words", "weight"])

    return blocks.select("ids", "starts", "words", "stream").mapInArrow(run, f"id {id_type}, n_features long, n_words long, weight long")


def noise(key: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) where u comes from the first 32 bits of sha256(seed:key); a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """rows with `name`, 1 to k for the first k rows by `order` and null for the rest; no task holds them all.

    Rows are dealt into ranges by sampled splitters and written, so that a range is fixed; ranges are counted, and a
    row is numbered inside its range. Rows that are equal in all of `order` take their places in any order.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, F.col("_row").asc())
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row for each range
    before, bases = 0, []
    for number, n in counts:
        bases.append((number, before))
        before += n
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "_range int, _before long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, F.col("_row").asc()))
    at = dealt.join(base, "_range").withColumn("_at", F.col("_before") + within)
    return at.select(*rows.columns, F.when(F.col("_at") <= k, F.col("_at")).cast("long").alias(name))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: str = "2024",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; ranks are those of the drawn rows.

    Features are runs of 1 to `longest` words. A word is a run of digits, ASCII letters (upper case folded) and all
    non-ASCII characters. Of the documents with at least `least_words` words, floor(percent / 100) of their number are
    drawn by the greatest score, the weight plus Gumbel noise that depends on the id alone; ties go to the smaller id,
    null ids last. A null or empty text has no features and a weight of 0. Repeated rows are rows of their own: they
    tie, and take neighbouring ranks. An empty table gives an empty result; an empty target gives gains from smoothing
    alone. Columns of other names are ignored, whatever these are.
    """
    kept = Scratch(docs.sparkSession, "streams")
    blocks = kept.cut(packed_streams(docs, id_col, text_col, buckets, longest), "docs")
    wanted = target.select(F.lit(0).cast("long").alias("id"), F.col(target_col).alias("text"))
    aim = bucket_counts(kept.cut(packed_streams(wanted, "id", "text", buckets, longest), "target"), buckets)
    weighed = gathered(blocks, gains(bucket_counts(blocks, buckets), aim)).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    weighed = cut(weighed, "weights")
    kept.clear()
    able = weighed.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    drawn = ranked(able, [F.col("score").desc(), F.col("id").asc_nulls_last()], k, "rank")
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

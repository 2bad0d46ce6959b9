"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty, uniform

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Buckets of hashed words and word pairs, and pseudo-counts of a bucket.
BUCKETS, SMOOTH = 1 << 16, 1.0
#: Target texts that the target model is fitted on at most (a sample by a hash of the id), whole texts each.
TARGET_ROWS = 20_000
#: Bins of a pass of the search for the k-th greatest key, and rows of a bin that are sorted on the driver.
BINS, FEW = 4096, 10_000


class Features:
    """Buckets of a text's words and word pairs."""

    def __init__(self, buckets: int = BUCKETS):
        import xxhash

        self.hash, self.known, self.buckets = xxhash.xxh3_64_intdigest, {}, np.uint64(buckets)

    def __call__(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self.hash(w)
        one = np.array([known[w] for w in words], dtype=np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)
        return np.concatenate((one % self.buckets, two % self.buckets)).astype(np.int64)


def model(rows: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket, of rows (_id, _text). Raw counts cover all of them.

    target_ids (_id) is a bounded sample, which bounds its broadcast; a partition sends one row of counts for a bucket, and the
    driver adds up BUCKETS numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(features(text), minlength=BUCKETS)
                sums[0] += got
                if target:
                    sums[1] += got
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["b", "raw", "target"])

    marked = rows.join(F.broadcast(target_ids.select("_id", F.lit(True).alias("_target")).distinct()), "_id", "left")
    marked = marked.select(text_or_empty(F.col("_text")), F.coalesce("_target", F.lit(False)))
    sums = marked.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # at most BUCKETS rows
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    # the raw model is the prior of the target model, so buckets that the sample does not hold are near 0
    raw = (raw + SMOOTH) / (raw + SMOOTH).sum()
    pseudo = SMOOTH * BUCKETS
    target = (target + pseudo * raw) / (target.sum() + pseudo)
    return np.log(target) - np.log(raw)


def log_weights(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(_id, _log, _mean) of rows (_id, _text): the text's log importance, and the same for a feature."""
    sent = rows.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))

    @F.pandas_udf("total double, mean double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, table = Features(), sent.value
        for texts in batches:
            total, mean = [], []
            for text in texts:
                got = table[features(text or "")]
                total.append(float(got.sum()))
                mean.append(float(got.mean()) if len(got) else 0.0)
            yield pd.DataFrame({"total": total, "mean": mean})

    out = rows.select("_id", weigh.asNondeterministic()(text_or_empty(F.col("_text"))).alias("_w"))
    return out.select("_id", F.col("_w.total").alias("_log"), F.col("_w.mean").alias("_mean"))


def _kth(df: DataFrame, key: Column, k: int) -> tuple[float, int]:
    """The k-th greatest value of `key` (a double, not null) and how many rows are above it.

    It is closed in on by histograms of BINS bins, each a count by bin, until a bin holds one value or FEW rows, which
    are then sorted; no row but their counts, and at most FEW values, goes to the driver.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    above, inside = 0, df.select(key.alias("x"))
    while low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("x") - low) / width)) if width > 0 and low + width > low else (F.col("x") > low).cast("int")
        inside = inside.where((F.col("x") >= low) & (F.col("x") <= high))
        bins = {r["b"]: r for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                break
            above += bins[b]["n"]
        low, high = bins[b]["lo"], bins[b]["hi"]
        if bins[b]["n"] <= FEW:
            values = sorted((r["x"] for r in inside.where((F.col("x") >= low) & (F.col("x") <= high)).collect()), reverse=True)
            x = values[k - above - 1]
            return x, above + sum(v > x for v in values)
    return low, above


def top_k(df: DataFrame, key: str, k: int, tie: str, name: str = "_selected") -> DataFrame:
    """df with `name`: whether a row is among the k of the greatest key, ties to the smaller number `tie` (null last).

    Rows that agree in both are selected alike, so a few more than k may be. Ties of any number are settled by a second
    search, over `tie`, so that no task holds all rows of a key. A null key is never selected.
    """
    known = df.where(F.col(key).isNotNull())
    n = known.count() if k > 0 else 0
    if n <= k:
        return df.withColumn(name, F.col(key).isNotNull() & F.lit(k > 0))
    edge, above = _kth(known, F.col(key).cast("double"), k)
    order = F.coalesce(-F.col(tie).cast("double"), F.lit(float("-inf")))
    last, _ = _kth(known.where(F.col(key) == edge), order, k - above)
    return df.withColumn(name, F.coalesce((F.col(key) > edge) | ((F.col(key) == edge) & (order >= last)), F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float | None = None, per_feature: bool = False, temperature: float = 1.0) -> DataFrame:
    """(id, log_weight, mean_log_weight, gumbel_key, selected) of every row of docs.

    The target is text labelled 1; an id whose labels contradict each other counts as labelled 0, and one that is repeated
    counts once. Of n rows round(keep * n) are selected, those with the greatest log weight, the log of the ratio of the
    two generative models' probabilities of the text, plus Gumbel noise times `temperature`: at 1, a sample without
    replacement in proportion to the weights. With `per_feature` the mean log weight of a feature takes the sum's place,
    which does not favour long texts. keep defaults to the share of 1 among the labels (1 without any). The noise depends
    on the id alone, so rows with equal ids and texts tie and are selected alike. A text without tokens (null, empty) has
    a weight of 0. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    n = known.agg(F.count("*").alias("n"), F.sum("_y").alias("good")).first()
    good = int(n["good"] or 0)
    target = known.where("_y = 1").where(uniform(F.col("_id"), "target") < F.lit(min(1.0, TARGET_ROWS / max(1, good)))).select("_id")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    weighed = log_weights(rows, model(rows, target))
    noise = -F.log(-F.log(F.greatest(uniform(F.col("_id"), "gumbel"), F.lit(1e-16))))
    base = F.col("_mean") if per_feature else F.col("_log")
    keyed = cut(weighed.select(F.col("_id").alias(id_col), F.col("_log").alias("log_weight"), F.col("_mean").alias("mean_log_weight"), (base + F.lit(temperature) * noise).alias("gumbel_key")), "weights")
    share = keep if keep is not None else (good / n["n"] if n["n"] else 1.0)
    return top_k(keyed, "gumbel_key", math.floor(share * keyed.count() + 0.5), id_col, "selected")

"""Toxic passages by maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, give_back, text_or_empty, uniform

WORD = re.compile(r"\w+")
#: Lengths of the prefixes that stand for words too rare to count.
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that the model is fitted on at most (a sample by a hash of the id), whole texts each.
TRAIN_ROWS = 20_000
#: Texts a token must be in, and log-odds it must reach before shrinkage, to be kept.
LEAST_TEXTS, LEAST_ODDS = 4, 0.7
#: Dirichlet pseudo-texts, taken from the parent's odds, and the drift that makes a token's expected score negative.
PRIOR, DRIFT = 4.0, 1.6
#: A passage is significant if chance brings fewer than so many as good in a text of its length.
SIGNIFICANT = 0.05


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]  # words as they are, prefixes with a trailing *
    rate: float = 1.0  # Karlin and Altschul's lambda
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def token(self, word: str) -> float:
        got = self.odds.get(word)
        if got is None:
            for k in reversed(PREFIXES):
                if len(word) >= k and (got := self.odds.get(word[:k] + "*")) is not None:
                    break
        return (got or 0.0) - DRIFT


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of the sequence, in linear time (Ruzzo and Tompa 1999)."""
    found: list[list] = []  # start, end, sum before, sum after, index of the last candidate with a smaller sum before
    total = 0.0
    for i, x in enumerate(scores):
        if x > 0:
            new = [i, i + 1, total, total + x, -1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j = found[j][4]
                new[4] = j
                if j < 0 or found[j][3] >= new[3]:
                    found.append(new)
                    break
                new = [found[j][0], new[1], found[j][2], new[3], -1]
                del found[j:]
        total += x
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def keys(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def shrink(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of a key's share of toxic and of clean texts, each with a Dirichlet prior at its next shorter prefix.

    Keys whose odds are near those of their nearest kept prefix are left out, as the prefix stands for them.
    """
    odds: dict[str, float] = {}
    order = sorted(counts, key=lambda k: (not k.endswith("*"), len(k), k))
    base = toxic / max(1, clean)
    for key in order:
        word = key.rstrip("*")
        above = next((odds[word[:k] + "*"] for k in reversed(PREFIXES) if (k < len(word) or not key.endswith("*") and k <= len(word)) and word[:k] + "*" in odds), 0.0)
        share = math.exp(above) * base / (1 + math.exp(above) * base)
        y1, y0 = counts[key]
        value = math.log((y1 + PRIOR * share) / max(1, toxic)) - math.log((y0 + PRIOR * (1 - share)) / max(1, clean))
        if abs(value - above) > 0.2:
            odds[key] = value
    return odds


def evidence(model: Model, text: str, memo: dict[str, float]) -> tuple[float, float, int, list[tuple[int, int, float]]]:
    """(evidence, best score, words, significant segments of words) of a text.

    A segment of score S in n words has exp(log_k - rate * S) * n equals by chance; the evidence adds up the
    logs by which the significant ones are below one, or takes the best one's if none is.
    """
    words = WORD.findall(text.lower())
    scores = []
    for w in words:
        s = memo.get(w)
        if s is None:
            s = memo[w] = model.token(w)
        scores.append(s)
    n = max(1, len(words))
    found = segments(scores) if scores and max(scores) > 0 else []
    best = max((s for _, _, s in found), default=0.0)
    chance = model.log_k + math.log(n)
    passages = [x for x in found if chance - model.rate * x[2] <= math.log(SIGNIFICANT)]
    total = sum(model.rate * s - chance for _, _, s in passages) if passages else model.rate * best - chance
    return total, best, n, passages


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(_text, _y, _cal) of labelled rows outside the held-out fold, equal texts once; at most about `most` rows.

    The label table is cut down to `most` rows first, which bounds the broadcast to the documents.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0)).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    known = known.where(uniform(F.col("_id"), "train") < F.lit(min(1.0, most / max(1, n))))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text")).join(F.broadcast(known), "_id")
    once = rows.groupBy(F.xxhash64("_text").alias("_h")).agg(F.min("_id").alias("_id"))
    return rows.join(F.broadcast(once), "_id").select("_text", "_y", (fold(F.col("_id")) == 4).alias("_cal"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """Learns odds on folds 1 to 4 of 5, and the calibration on fold 4 with odds of folds 1 to 3; fold 0 is held out.

    Without labels of both kinds the model is empty and scores every text alike. What reaches the driver is
    bounded by the sample: counts of keys in at least LEAST_TEXTS texts with odds, two numbers a text in each of two
    passes over all its segments, and a count for each tenth of a token's score.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter() for _ in range(4)]  # toxic and clean, then those of fold 4
        for batch in batches:
            for text, y, cal in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[(0 if y else 1) + 2 * cal].update(keys(set(WORD.findall(text.lower()))) | {""})
        names = list(set().union(*sums))
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[x] for x in part], pa.int64()) for s in sums)], ["k", "y1", "y0", "c1", "c0"])
        del sums, names
        give_back()

    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    four = ("y1", "y0", "c1", "c0")
    sums = rows.select("_text", "_y", "_cal").mapInArrow(count, "k string, y1 long, y0 long, c1 long, c0 long").groupBy("k").agg(*[F.sum(c).alias(c) for c in four])
    seen1, seen0 = F.col("y1") + F.col("c1"), F.col("y0") + F.col("c0")
    sums = cut(sums.where(seen1 + seen0 >= LEAST_TEXTS), "counts")
    tot = sums.where("k = ''").select(*four).first() or (0, 0, 0, 0)
    toxic, clean, cal1, cal0 = (int(v) for v in tot)
    if not toxic + cal1 or not clean + cal0:
        return Model({})
    ratio = F.log((seen1 + 0.5) / (toxic + cal1 + 1)) - F.log((seen0 + 0.5) / (clean + cal0 + 1))
    got = sums.where((F.col("k") != "") & (F.abs(ratio) >= LEAST_ODDS)).collect()
    model = Model(shrink({r["k"]: (r["y1"] + r["c1"], r["y0"] + r["c0"]) for r in got}, toxic + cal1, clean + cal0))
    if not toxic or not clean:
        return model
    first = Model(shrink({r["k"]: (r["y1"], r["y0"]) for r in got if r["y1"] + r["y0"]}, toxic, clean))

    def scored(texts: list[str], memo: dict[str, float]) -> Iterator[tuple[list[float], list[float]]]:
        """Scores of each text's words, and of all its segments."""
        for text in texts:
            scores = [memo[w] if w in memo else memo.setdefault(w, first.token(w)) for w in WORD.findall(text.lower())]
            yield scores, [s for _, _, s in segments(scores)] if scores and max(scores) > 0 else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            out: list[list] = [batch.column(1).to_pylist(), [], [], []]
            for y, (scores, found) in zip(out[0], scored(batch.column(0).to_pylist(), memo)):
                hist = Counter(round(s, 1) for s in scores) if not y else {}
                out[1].append(max(1, len(scores)))
                out[2].append(max(found, default=0.0))
                out[3].append([float(v) for kv in hist.items() for v in kv])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.float64()))], ["y", "n", "best", "hist"])

    held = cut(rows.where("_cal").select("_text", "_y"), "calibration")
    got = held.mapInArrow(measure, "y int, n long, best double, hist array<double>").collect()
    if len({r["y"] for r in got}) < 2:
        return model
    hist: Counter = Counter()
    for r in got:
        for s, c in zip(r["hist"][::2], r["hist"][1::2]):
            hist[s] += c
    rate = _rate(hist)
    clean_rows = [r for r in got if not r["y"]]
    # the mean of a Gumbel variable is its location plus Euler's constant
    log_k = float(np.mean([rate * r["best"] - math.log(r["n"]) for r in clean_rows])) - 0.5772156649015329

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            t = []
            for scores, found in scored(batch.column(0).to_pylist(), memo):
                chance = log_k + math.log(max(1, len(scores)))
                good = [rate * s - chance for s in found if rate * s - chance >= -math.log(SIGNIFICANT)]
                t.append(sum(good) if good else rate * max(found, default=0.0) - chance)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(t, pa.float64())], ["y", "t"])

    got = held.mapInArrow(judge, "y int, t double").collect()
    slope, shift = _logistic(np.array([r["t"] for r in got]), np.array([r["y"] for r in got], dtype=float))
    return Model(model.odds, rate, log_k, slope, shift)


def _rate(hist: Counter) -> float:
    """The positive root of sum p(s) exp(rate * s) = 1 over the scores of clean tokens."""
    s, p = np.array(list(hist)), np.array(list(hist.values()), dtype=float)
    if not len(s) or s.max() <= 0:
        return 1.0
    p /= p.sum()
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float((p * np.exp(np.minimum(mid * s, 500))).sum()) < 1 else (low, mid)
    return low


def _logistic(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over squashed evidence: damped Newton steps with Platt's smoothed targets.

    The slope is drawn towards 1, so a handful of labels, or ones that evidence splits without fault, give a
    finite curve that rises.
    """
    x = squash(t)
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])

    def loss(w):
        z = w[0] * x + w[1]
        return float((np.logaddexp(0, z) - goal * z).sum() + (w[0] - 1) ** 2 / 2 + w[1] ** 2 / 200)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - goal) * x).sum() + at[0] - 1, (p - goal).sum() + at[1] / 100])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-6 and loss(at - scale * step) > loss(at):
            scale /= 2
        at = at - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return max(1e-3, float(at[0])), float(at[1])


def squash(t):
    return np.sign(t) * np.log1p(np.abs(t))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with, last, a struct `_tox` (with underscores added where docs has that name): score (0 to 1), evidence and
    passages, the significant ones.

    A passage gives its words' positions (from, below) and its score. The whole text is scored; null counts as
    empty. A text without words has no passage and the score of no evidence. No label, language, source or id
    enters a score, so equal texts score alike. An empty table gives an empty result; columns of docs stay as they are.
    """

    @F.pandas_udf("score double, evidence double, passages array<struct<start:int,end:int,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for texts in batches:
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for text in texts:
                total, _, _, passages = evidence(model, text or "", memo)
                z = model.slope * float(squash(total)) + model.shift
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if model.odds else 0.0
                out.append((p, total, [{"start": a, "end": b, "score": s} for a, b, s in passages]))
            yield pd.DataFrame(out, columns=["score", "evidence", "passages"])
        memo.clear()
        give_back()

    # nondeterministic, so that it is not run again for each use of a field
    return docs.withColumn(free_name(docs, "_tox"), judge.asNondeterministic()(text_or_empty(F.col(text_col))))

"""Stupid-backoff language-model scores from n-gram counts of the whole corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, text_or_empty

WORD = re.compile(r"\w+")
BACKOFF = 0.4
ORDER = 3
#: Bits of an n-gram's hash. Of 10**13 different n-grams, one in 7,000 shares its hash with another.
HASH_BITS = 56
#: Characters of text that are dealt with together, and n-grams counted in one group.
CHUNK_CHARS, GROUP_GRAMS = 8_000_000, 2_000_000


def _grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams ending at each word, for n = 1 to order; 0 where a text has too few words before."""
    from .near_dedup import _scramble

    words = np.where(words == 0, np.uint64(1), words)
    out = [words]
    place = np.arange(len(words)) - starts
    for n in range(2, order + 1):
        shifted = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))[: len(words)]
        g = _scramble(shifted * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(n))
        out.append(np.where(place >= n - 1, np.where(g == 0, np.uint64(1), g), np.uint64(0)))
    top = np.uint64(64 - HASH_BITS)
    return [np.where(g == 0, g, np.maximum(g >> top, np.uint64(1))) for g in out]


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, the text each is of, and where that text starts."""
    import xxhash

    known: dict[str, int] = {}
    parts, counts = [], []
    for text in texts:
        words = WORD.findall((text or "").lower())
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        parts.append(np.array([known[w] for w in words], dtype=np.uint64))
        counts.append(len(words))
    count = np.array(counts, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    starts = np.repeat(np.cumsum(count) - count, count)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), owner, starts


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit numbers as differences in a columnar byte layout."""
    import zstandard

    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(gaps).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    gaps = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    import zstandard

    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _uncounted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(grams[grams != 0], return_counts=True)
    return keys, counts.astype(np.int64)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, tokens, log_score, mean_log_score, backoffs) of every row.

    The model is all of df; a text is scored with its own n-grams' counts taken off, so that it is not praised
    for having been seen. A word's score is the relative frequency of its longest n-gram that other texts
    hold, times BACKOFF for each word of context given up; a word that no other text holds counts as seen
    once. A text without words (null, empty) has 0 tokens, a log_score of 0 and a null mean. Copies of a text
    count as other texts. Ids are carried along only: repeated or null ids are rows like others (rows that repeat an id
    and its text are dealt to one chunk). An empty table gives an empty result; other columns, whatever their names, are
    ignored.

    Counts never come together in one place: each chunk of texts sends the distinct n-grams it holds with
    their counts to groups by hash, a group adds the counts up, and the sums go back to the chunks that asked.
    So a frequent n-gram is one entry a chunk, however many texts hold it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(chars / CHUNK_CHARS))
    groups = max(shuffle_partitions(spark), math.ceil(chars / 5 / GROUP_GRAMS) * order)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(chunks)).cast("int"))

    # groups are ranges of hashes, so that a chunk's sorted n-grams are dealt in order and lie close together
    splits = np.array([(1 << HASH_BITS) * k // groups for k in range(groups)] + [1 << HASH_BITS], dtype=np.uint64)

    def ask(group):
        import pandas as pd

        words, _, starts = _read(group["text"].tolist())
        out = []
        for n, g in enumerate(_grams(words, starts, order), 1):
            keys, counts = _uncounted(g)
            edges = np.searchsorted(keys, splits)
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    out.append((k, n, group["chunk"].iloc[0], pack_sorted(keys[a:b]), pack_counts(counts[a:b])))
        return pd.DataFrame(out, columns=["part", "n", "chunk", "keys", "counts"])

    asked = dealt.groupBy("chunk").applyInPandas(ask, "part int, n int, chunk int, keys binary, counts binary")

    def add(group):
        import pandas as pd

        keys = [unpack_sorted(b) for b in group["keys"]]
        flat = np.concatenate(keys)
        distinct, at = np.unique(flat, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack_counts(b) for b in group["counts"]]), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        sums = [total[at[e - len(k) : e]] for e, k in zip(ends, keys)]
        return pd.DataFrame({"chunk": group["chunk"], "n": group["n"], "part": group["part"], "counts": [pack_counts(s) for s in sums]})

    told = asked.groupBy("part", "n").applyInPandas(add, "chunk int, n int, part int, counts binary")

    def judge(key, texts, told):
        import pandas as pd

        words, owner, starts = _read(texts["text"].tolist())
        lists = texts["id"].tolist()
        tokens = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        grams = _grams(words, starts, order)
        seen, context = [], []
        for n, g in enumerate(grams, 1):
            # the answers in the order of groups are in the order of the sorted n-grams that were asked for
            mine = told[told["n"] == n].sort_values("part")
            sums = np.concatenate([unpack_counts(b) for b in mine["counts"]]) if len(mine) else np.empty(0, np.int64)
            if not len(g):
                seen.append(np.zeros(0, np.int64))
                continue
            # texts follow each other, so a stable sort puts each n-gram's places in the order of their texts
            by = np.argsort(g, kind="stable")
            near, whose = g[by], owner[by]
            new = np.concatenate(([True], near[1:] != near[:-1]))
            own = np.cumsum(new | np.concatenate(([True], whose[1:] != whose[:-1]))) - 1
            rank = np.cumsum(new) - 1
            if near[0] == 0:  # places without an n-gram come first
                sums = np.concatenate((np.zeros(1, np.int64), sums))
            rest = np.empty(len(g), np.int64)
            rest[by] = np.where(near != 0, sums[rank] - np.bincount(own)[own], 0)
            seen.append(rest)
        best = np.full(len(words), np.nan)
        lost = np.zeros(len(words), np.int64)
        for n in range(order, 1, -1):
            before = np.concatenate((np.zeros(1, np.int64), seen[n - 2][:-1]))[: len(words)]
            hit = np.isnan(best) & (seen[n - 1] > 0) & (before > 0)
            best[hit] = np.log(seen[n - 1][hit] / before[hit])
            lost[np.isnan(best)] += 1
        rest = np.isnan(best)  # the corpus' size is taken off these in the end
        best[rest] = np.log(np.maximum(seen[0][rest], 1))
        single = np.bincount(owner, weights=rest, minlength=len(texts)).astype(np.int64)
        per = np.bincount(owner, weights=best + lost * math.log(BACKOFF), minlength=len(texts))
        backs = np.bincount(owner, weights=lost, minlength=len(texts)).astype(np.int64)
        return pd.DataFrame({"id": pd.Series(lists, dtype=texts["id"].dtype), "tokens": tokens, "score": per, "single": single, "backoffs": backs})

    out = cut(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(judge, f"id {kind}, tokens long, score double, single long, backoffs long"), "scores")
    total = out.agg(F.sum("tokens")).first()[0] or 1
    log_score = F.col("score") - F.col("single") * F.lit(math.log(total))
    return out.select(F.col("id").alias(id_col), "tokens", log_score.alias("log_score"), F.when(F.col("tokens") > 0, log_score / F.col("tokens")).alias("mean_log_score"), "backoffs")

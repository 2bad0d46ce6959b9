"""Queries over whole tables: what a filter, a prefix or a subset would leave out."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cartolith.functions import text as T
from cartolith.operators import vectors
from cartolith.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@needs_tables
def test_number_match_takes_all_orders(spark):
    got = catalogue.number_match_priority(spark, SF).select("o_orderkey", "pdf", "candidates")
    want = duckdb.sql(f"""WITH o AS (SELECT * FROM '{SF}/orders.parquet'), k AS (SELECT o_orderkey, 0 AS pr, o_orderkey % 2000 AS key FROM o UNION ALL SELECT o_orderkey, 1, o_custkey % 2000 FROM o),
        h AS (SELECT DISTINCT o_orderkey, pr, p_name || '.pdf' AS pdf FROM k JOIN '{SF}/part.parquet' ON p_partkey = key)
        SELECT o.o_orderkey, arg_min(pdf, (pr, pdf)) AS pdf, count(pdf) AS candidates FROM o LEFT JOIN h USING (o_orderkey) GROUP BY 1""").fetchall()
    assert len(want) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert rows(got) == sorted(want, key=str)


def test_sections_differ_after_20_characters(spark, tmp_path):
    turns = [(1, 0, "assistant", "hello"), (1, 1, "user", "x" * 20 + " one"), (1, 2, "assistant", "a"), (1, 3, "user", "x" * 20 + " two"), (1, 4, "assistant", "b")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r["section"] for r in catalogue.section_forward_fill(spark, str(tmp_path)).orderBy("turn").collect()]
    assert got == ["unclassified", turns[1][3], turns[1][3], turns[3][3], turns[3][3]]


def linkage(u, k):
    """Average linkage by the definition: mean distance over all pairs of members, searched anew for each merge."""
    groups = [[i] for i in range(len(u))]
    while len(groups) > k:
        mean = {(a, b): np.mean([1 - u[p] @ u[q] for p in groups[a] for q in groups[b]]) for a in range(len(groups)) for b in range(a)}
        a, b = min(mean, key=mean.get)
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def test_linkage_matches_brute_force():
    x = np.random.default_rng(4).normal(size=(60, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in (None, 3, 25):
        found = vectors.agglomerate([f"{i:02}" for i in range(60)], x, k)
        got = {frozenset(int(i) for i, c in found.items() if c == cluster) for cluster in found.values()}
        assert got == linkage(u, vectors.cluster_count(60, k))


@needs_tables
def test_agglomerative_clusters_hold_every_vector(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = dict(map(tuple, catalogue.agglomerative_clusters(spark, SF).collect()))
    assert sorted(got) == sorted(rows["vec_id"])
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = sorted(set(rows["label"]))
    mean = np.stack([x[rows["label"] == n].mean(0) for n in names])
    want = linkage(mean / np.linalg.norm(mean, axis=1, keepdims=True), vectors.cluster_count(len(names)))
    by = {}
    for v, label in zip(rows["vec_id"], rows["label"]):
        by.setdefault(got[v], set()).add(names.index(label))
    assert {frozenset(m) for m in by.values()} == want


def test_near_duplicate_pairs_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "ab", "abc", "abc", "ABC."]
    for n in (3, 8, 20, 60, 150):
        for _ in range(12):
            words = ["".join(rng.choice("aeiounrst") for _ in range(4)) for _ in range(n)]
            texts.append(" ".join(words))
            for _ in range(3):
                words = [w if rng.random() > 0.04 else "q" + w for w in words]
                texts.append(" ".join(words))
    ids = rng.sample(range(10_000), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams, want = [T.ngrams(t or "", 3) for t in texts], {}
    for i in range(len(texts)):
        for j in range(i):
            if grams[i] and len(grams[i] & grams[j]) >= 0.82 * len(grams[i] | grams[j]):
                want[min(ids[i], ids[j]), max(ids[i], ids[j])] = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    first = {i: min(ids[j] for j in range(len(texts)) if grams[j] == grams[i]) for i in range(len(texts)) if grams[i]}  # a text's copies are pairs with its first row only
    of = {ids[i]: f for i, f in first.items()}
    want = {(a, b): v for (a, b), v in want.items() if of[a] == a and (of[b] == b or of[b] == a)}
    got = catalogue.near_duplicate_pairs(spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 50 and {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(want, abs=1e-6)


@needs_tables
def test_cosine_pairs_read_every_vector(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = {n: x[rows["label"] == n].mean(0) for n in set(rows["label"])}
    got = catalogue.cosine_pairs(spark, SF).collect()
    assert len(got) == len(mean) * (len(mean) - 1) // 2
    for r in got:
        a, b = mean[r["a"]], mean[r["b"]]
        assert abs(r["distance"] - (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))) < 2e-6
